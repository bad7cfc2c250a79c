"""Main text of web pages by wrapper induction.

The pages of a host are aligned by simple tree matching (``alignment``): the frequent skeletons of a host grow into templates, every page votes on
the slots of the template that it matches best, and the votes say which slot is the content region: the one that holds most of the text that varies. Slots
outside of it (menus, adverts, footers, whatever they are called) go. Then, within and without, constants go: an element is known by its place
(the block elements above it and its own class and id) and its text, and what most pages with different text repeat at the same place, of the host or of one
layout (equal containers and language), is template (inside an article element only if most pages of the host do). So is what a smaller share
of the host's pages repeats, outside of article elements, unless it is the larger part of a page's remaining text: then it may be an article
that the host shows several times. Pages of equal text count once.

What tags and labels say (navigation, advert, comments ...) only breaks ties: it decides on slots that vary inside the content region, and on pages that no
template fits, as of hosts of fewer than three different pages.

All pages of a host vote, whole. Of a host's skeletons the ``SEEDS`` most frequent make its templates; a page unlike them all is judged by itself. Wrappers are
small, some hundred bytes a template and 8 a constant: they are broadcast if their measured size is within ``BROADCAST_BYTES``, else joined to the pages by
host, over ``SALTS`` copies so that a large host is many tasks.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import alignment as A
from quire.llm.shared import Scratch

#: Wrappers that a worker keeps.
KEPT = 1024
#: Levels of a tree.
DEEPEST = 150
BROADCAST_BYTES = 32 << 20
#: Skeletons of a host that templates are grown from, and copies of a wrapper that its host's pages are dealt over.
SEEDS, SALTS = 8, 8
#: Share of the pages of a host or layout that must repeat an element at its place, share that makes it a weak constant, and their least number besides the page itself.
CONSTANT_SHARE, WEAK_SHARE, CONSTANT_PAGES = 0.6, 0.1, 2
#: Shares of a page's text above which a form, or an element whose label names another region, is the page's body.
BULK_FORM, BULK = 0.5, 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that show no text, or none of the page's.
UNSEEN = frozenset("audio button canvas datalist embed head iframe input map meta noscript object option script select style svg template textarea title video".split())
#: Elements that by their meaning don't hold the article.
DROPPED = UNSEEN | frozenset("aside dialog footer form label menu nav".split())
#: Elements that are slots of a skeleton.
SLOTS = frozenset("html body article aside center dialog div dl footer form header main menu nav ol section table tbody td tr ul".split())
_CLOSES_P = BLOCKS - {"html", "body"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words that name a region, and words that only say where or how it stands.
_REGION = r"ads?|advert(?:s|isements?|ising)?|adsense|banner|sponsor(?:s|ed)?|promos?|promotions?|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widgets?|related|recommend(?:ed|ations?)|share|sharing|social|cookies?|consent|gdpr|newsletter|subscri(?:be|ptions?)|sign-?up|log-?in|popup|modal|overlay|comments?|respond|replies|disqus|pagination|pager|toolbar|copyright|disclaimer|hidden"
_PLACE = r"site|page|global|main|top|bottom|left|right|primary|secondary|mobile|user|google|cookie|legal|privacy|social|share|ad|nav|menu|footer|sidebar|comments?|newsletter|related"
_PART = r"bar|box|block|area|wrap|wrapper|container|section|list|links?|buttons?|icons?|inner|notice|message|posts?|articles?|stories|items?|slot|unit|form|thread|popup|modal|banner|menu|nav"
#: A whole class or id that names such a region; "no-sidebar", "has-menu", "overflow-hidden" or "entry-header" name none.
_LABEL = re.compile(rf"(?:(?:{_PLACE})[_-])?(?:{_REGION})(?:[_-](?:{_PART}))?(?:[_-]?\d+)?|skip-(?:links?|nav|to-content)", re.I)
#: A class or id that names the article beside another one.
_BODY = re.compile(r"(?:(?:post|entry|article|story|page|main|site)[_-])?(?:content|body)|article|story|post|entry|hentry", re.I)


class Node:
    __slots__ = ("tag", "label", "parts", "_never")

    def __init__(self, tag: str, label: str = ""):
        self.tag, self.label = tag, label
        self.parts: list = []  # nodes and strings in order
        self._never = None

    @property
    def children(self) -> list[Node]:
        return [p for p in self.parts if p.__class__ is Node]

    def never_content(self) -> bool:
        if self._never is None:
            self._never = self.tag in DROPPED or bool(self.label) and _names_region(self.label) and self.tag not in ("html", "body", "article", "main")
        return self._never


def _names_region(label: str) -> bool:
    tokens = label.split()
    return any(map(_LABEL.fullmatch, tokens)) and not any(map(_BODY.fullmatch, tokens))


#: Comments; tags, with quoted values that may hold ">"; tags whose quotes don't close; other declarations.
_MARKUP = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}


class _Builder:
    """A forgiving tree builder: void elements, implied ends, stray end tags."""

    def __init__(self):
        self.root = Node("#root")
        # open elements: tag, node that takes their content (above the bound the element itself), its level
        self.stack = [("#root", self.root, 1)]
        self.open: defaultdict[str, list[int]] = defaultdict(list)  # where the open elements of a tag stand on the stack

    def _end(self, tags: set | frozenset, scope: set | frozenset) -> None:
        at = max((self.open[t][-1] for t in tags if self.open[t]), default=0)
        above = len(self.stack) - 1 - at
        if not at or above and scope and (any(s[0] in scope for s in self.stack[at + 1 :]) if above < 64 else any(self.open[t] and self.open[t][-1] > at for t in scope)):
            return
        for tag, _, _ in self.stack[at:]:
            self.open[tag].pop()
        del self.stack[at:]

    def start(self, tag: str, attributes: str) -> None:
        if tag in _CLOSES_P:
            self._end(_P, _P_SCOPE)
        if tag in _CLOSED_BY:
            for _ in range(2):
                self._end(_CLOSED_BY[tag], _SCOPES[tag])
        label = ""
        if "=" in attributes or "hidden" in attributes:
            own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            label = " ".join(filter(None, (own.get("class"), own.get("id"))))
            if tag == "html":
                label = own.get("lang", "").lower()
            if own.get("role", "").lower() in _ROLES or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
                label += " hidden"
        node = Node(tag, label)
        _, parent, level = self.stack[-1]
        parent.parts.append(node)
        # below DEEPEST an element's content goes to its parent, below twice that even if it is none of the article
        deep = level > DEEPEST and (level > 2 * DEEPEST or not node.never_content())
        if tag not in VOID and not (attributes.endswith("/") and tag in _FOREIGN):
            self.stack.append((tag, parent, level) if deep else (tag, node, level + 1))
            self.open[tag].append(len(self.stack) - 1)

    def end(self, tag: str) -> None:
        if tag not in VOID:
            self._end({tag}, _NOTHING if tag in BLOCKS else _INLINE_SCOPE)

    def feed(self, html: str) -> None:
        at = 0
        while True:
            m = _MARKUP.search(html, at)
            text = html[at : m.start() if m else len(html)]
            if text:
                self.stack[-1][1].parts.append(unescape(text) if "&" in text else text)
            if not m:
                return
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.end(tag)
                continue
            self.start(tag, m[3] or m[6] or "")
            if tag in _RAW:  # text that isn't markup; none of it is content
                close = _RAW[tag].search(html, at)
                at = close.start() if close else len(html)
                close = _MARKUP.match(html, at)
                if close:
                    self.end(tag)
                    at = close.end()


#: Elements that a template drops whole; constant words within a sentence and single items of a varying list or table stay.
_WHOLE = BLOCKS - frozenset("html body li dd dt td th tr".split())
#: Elements whose places make a layout, and levels of them.
_CONTAINERS = frozenset("html body div section main article center table".split())
LAYOUT_LEVELS = 6
_DIGITS = re.compile(r"\d+")
_P, _NOTHING = frozenset({"p"}), frozenset()
_P_SCOPE = BLOCKS - _P
_INLINE_SCOPE = frozenset("td th table article section main body".split())
_FOREIGN = frozenset("svg path circle rect use line polygon polyline ellipse g".split())


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    _release(builder.root)
    return builder.root


def _release(root: Node) -> None:
    """Keeps what is dropped by a label, or as a form, but holds the page's article or main elements, or most of its text."""
    judged, kept, letters = [], False, 0  # nodes to judge; whether an article or main stands outside of them; text outside
    wait = [root]
    while wait:
        node = wait.pop()
        if node.never_content():
            if node.tag == "form" or node.tag not in DROPPED:
                judged.append(node)
            continue
        kept = kept or node.tag in ("article", "main")
        for p in node.parts:
            if p.__class__ is Node:
                wait.append(p)
            else:
                letters += len(p.strip())
    if not judged:
        return
    held = [_held_text(n) for n in judged]
    whole = letters + sum(n for n, _ in held)
    freed = [n for n, (size, article) in zip(judged, held, strict=True) if article and not kept or size > (BULK_FORM if n.tag == "form" else BULK) * whole]
    for node in freed:
        node._never = False
    if freed:
        _release(root)  # what they hold is judged now


def _held_text(node: Node) -> tuple[int, bool]:
    """Letters below a node outside of elements that never hold the article, and whether an article or main element is there."""
    size, article, wait = 0, False, [node]
    while wait:
        for p in wait.pop().parts:
            if p.__class__ is not Node:
                size += len(p.strip())
            elif not p.never_content() or p.tag == "form":
                article = article or p.tag in ("article", "main")
                wait.append(p)
    return size, article


def _hash(*parts: bytes) -> bytes:
    return blake2b(b"\0".join(parts), digest_size=8).digest()


class Survey:
    """A page's elements by place and text: ``marks`` (element, key, letters, whether it stands in an article), the hash of all its text and of its layout."""

    def __init__(self, root: Node):
        self.marks: list[tuple[Node, int, int, bool]] = []
        self._containers: set[bytes] = set()
        whole, self.letters = self._walk(root, b"", 0, False)
        self.text = int.from_bytes(whole or b"", "big", signed=True)
        # 0 stands for the host
        self.layout = int.from_bytes(_hash(*sorted(self._containers)), "big", signed=True) or 1

    def _walk(self, block: Node, path: bytes, depth: int, article: bool) -> tuple[bytes | None, int]:
        """Hash of the text of a block element and its letters; None without text."""
        units, run, letters = [], [], 0

        def close() -> None:
            nonlocal letters
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                units.append(_hash(text.encode("utf-8", "replace")))
                letters += len(text)

        def add(node: Node) -> None:
            nonlocal letters
            for p in node.parts:
                if p.__class__ is not Node:
                    run.append(p)
                elif p.tag == "br":
                    run.append(" ")
                elif p.tag not in BLOCKS:
                    if not p.never_content():
                        add(p)
                else:
                    close()
                    if not p.never_content():
                        below, size = self._walk(p, here, depth + 1, inside)
                        if below:
                            units.append(below)
                            letters += size

        label = _DIGITS.sub("0", block.label).encode("utf-8", "replace")
        here = path if block.tag in ("#root", "html", "body") else _hash(path, block.tag.encode("utf-8", "replace"))
        inside = article or block.tag == "article"
        if block.tag in _CONTAINERS and depth <= LAYOUT_LEVELS and not article:
            self._containers.add(_hash(here, label if block.tag != "body" else b""))
        add(block)
        close()
        if not units:
            return None, 0
        whole = _hash(*units)
        if block.tag in _WHOLE:
            self.marks.append((block, int.from_bytes(_hash(here, label, whole), "big", signed=True), letters, article))
        return whole, letters

    def keys(self) -> list[int]:
        return sorted({m[1] for m in self.marks})


def _constants(surveys: list[Survey]) -> dict[int, tuple[list[int], list[int]]]:
    """``constants_of`` for the pages of one host."""
    counts: Counter[tuple[int, int | None]] = Counter()
    for own in {s.text: s for s in surveys}.values():
        for group in (0, own.layout):
            counts.update((group, k) for k in (None, *own.keys()))
    out: dict[int, tuple[list[int], list[int]]] = {}
    for (group, key), n in counts.items():
        if key is not None and n > CONSTANT_PAGES:
            share = n / counts[group, None]
            if share >= CONSTANT_SHARE or group == 0 and share >= WEAK_SHARE:
                out.setdefault(group, ([], []))[share < CONSTANT_SHARE].append(key)
    return out


class Outline:
    """A page's skeleton with what its slots hold: letters, letters in links, whether there is a first heading, and a hash of the text. ``at`` gives the slot of an element."""

    def __init__(self, root: Node):
        self.skeleton = A.Skeleton()
        self.letters, self.linked, self.titled, self.at = [], [], [], {}
        self._texts: list[list[bytes]] = []
        self._slots: dict[tuple[int, str], int] = {}
        self._walk(root, self._slot("#root", -1), False)
        for i in range(len(self.letters) - 1, 0, -1):
            up = self.skeleton.parents[i]
            self.letters[up] += self.letters[i]
            self.linked[up] += self.linked[i]
            self.titled[up] |= self.titled[i]
            self._texts[up].append(_hash(*self._texts[i]))
        self.hashes = [int.from_bytes(_hash(*t), "big", signed=True) for t in self._texts]

    def _slot(self, key: str, parent: int) -> int:
        at = self._slots.get((parent, key))
        if at is None:
            at = self._slots[parent, key] = self.skeleton.add(key, parent)
            for column in (self.letters, self.linked, self.titled):
                column.append(0)
            self._texts.append([])
        return at

    def _walk(self, node: Node, slot: int, link: bool) -> None:
        self.at[id(node)] = slot
        for p in node.parts:
            if p.__class__ is not Node:
                text = p.strip()
                if text:
                    self.letters[slot] += len(text)
                    self.linked[slot] += len(text) * link
                    self._texts[slot].append(text.encode("utf-8", "replace"))
            elif p.tag not in UNSEEN:
                self.titled[slot] |= p.tag == "h1"
                below = slot
                if p.tag in SLOTS:
                    label = "" if p.tag in ("html", "body") else " ".join(_DIGITS.sub("0", p.label).split())
                    below = self._slot(f"{p.tag} {label}".rstrip(), slot)
                self._walk(p, below, link or p.tag == "a")


def _induced(outlines: list[Outline], texts: list[int]) -> list[tuple[A.Skeleton, str]]:
    """The templates of some pages of one host, of those texts, with their decisions, as the tables of ``main_text`` give them."""
    once = dict(zip(texts, outlines, strict=True)).values()
    counts = Counter(o.skeleton.encoded() for o in once)
    found = A.templates([A.Skeleton.decoded(k) for k, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:SEEDS]])
    votes, hashes = [[A.Votes() for _ in t.keys] for t in found], defaultdict(Counter)
    for o in once:
        at, pairs = A.placed(o.skeleton, found)
        for i, t in pairs.items():
            own = votes[at][t]
            own.pages, own.letters, own.linked, own.titled = own.pages + 1, own.letters + o.letters[i], own.linked + o.linked[i], own.titled + o.titled[i]
            hashes[at, t][o.hashes[i]] += 1
    for (at, t), n in hashes.items():
        votes[at][t].same = max(n.values())
    return [(t, A.decided(t, v, v[0].pages)) for t, v in zip(found, votes, strict=True)]


class Wrapper:
    """What is known of a host: its templates with their decisions, and its constants, strict and weak ones of the whole host (0) and of each layout."""

    def __init__(self, constants: dict[int, tuple[Iterable[int], Iterable[int]]] | list[str], templates: list[tuple[A.Skeleton, str]] = ()):
        """From keys by group and templates, or from pages, by the rules of ``main_text``."""
        if not isinstance(constants, dict):
            roots = [parse(p) for p in constants]
            surveys = [Survey(r) for r in roots]
            templates, constants = _induced([Outline(r) for r in roots], [s.text for s in surveys]), _constants(surveys)
        self.constants = {group: (frozenset(strict), frozenset(weak)) for group, (strict, weak) in constants.items()}
        self.templates = list(templates)
        self._shown: dict[str, list[str] | None] = {}

    def region(self, root: Node) -> tuple[list[Node], set[int]] | None:
        """The page's elements that hold the content, and identities of those in them that don't; None if no template fits, or none of its content slots is there."""
        if not any(d for _, d in self.templates):
            return None
        own = Outline(root)
        key = own.skeleton.encoded()
        if key not in self._shown:
            if len(self._shown) >= KEPT:
                self._shown.clear()
            self._shown[key] = A.shown(own.skeleton, self.templates)
        letters = self._shown[key]
        if letters is None:
            return None
        scope, gone, wait = [], set(), [(root, False)]
        while wait:
            node, inside = wait.pop()
            letter = letters[own.at[id(node)]]
            if letter == A.DROPPED:
                gone.add(id(node))
                continue
            if letter == A.CONTENT and not inside:
                scope.append(node)
                inside = True
            wait += [(c, inside) for c in reversed(node.children) if id(c) in own.at]
        return (scope, gone) if scope else None

    def template(self, page: Node) -> set[int]:
        """Identities of the page's nodes that are constants of the host."""
        if not self.constants:
            return set()
        own = Survey(page)
        host, weak = self.constants.get(0, ((), ()))
        layout, _ = self.constants.get(own.layout, ((), ()))
        # a line that the few articles of a layout share is no template
        strict = {id(m[0]) for m in own.marks if m[1] in host or m[1] in layout and not m[3]}
        also = {id(m[0]) for m in own.marks if m[1] in weak and not m[3]} - strict
        if also:
            size = {id(m[0]): m[2] for m in own.marks}
            sure = sum(size[k] for k in _topmost(page, strict))
            repeated = sum(size[k] for k in _topmost(page, strict | also)) - sure
            if 2 * repeated < own.letters - sure:
                return strict | also
        return strict


def _topmost(node: Node, marked: set[int]) -> set[int]:
    """Those of the marked elements that stand in no other one."""
    out, wait = set(), [node]
    while wait:
        for c in wait.pop().children:
            if id(c) in marked:
                out.add(id(c))
            elif not c.never_content():
                wait.append(c)
    return out


def _blocks(node: Node, template: set[int], out: list[str], run: list[str]) -> None:
    """Appends finished blocks to ``out``; ``run`` holds the block that is open."""
    block = node.tag in BLOCKS
    if block:
        _flush(out, run)
    for p in node.parts:
        if p.__class__ is not Node:
            run.append(p)
        elif p.tag == "br":
            run.append(" ")
        elif not p.never_content() and id(p) not in template:
            _blocks(p, template, out, run)
        elif p.tag in BLOCKS:
            _flush(out, run)
    if block:
        _flush(out, run)


def _flush(out: list[str], run: list[str]) -> None:
    text = " ".join("".join(run).split())
    run.clear()
    if text:
        out.append(text)


def _find(node: Node, tag: str, template: set[int] | frozenset = frozenset()) -> list[Node]:
    found = []
    for c in node.children:
        if id(c) in template:
            continue
        if c.tag == tag:
            found.append(c)
        elif not c.never_content():
            found += _find(c, tag, template)
    return found


def extract(html: str | None, wrapper: Wrapper | None) -> str:
    """The main text, without template and boilerplate: of the wrapper's content region; where there is none, of the smallest scope (the article elements, the main element, the whole page) that holds at least half of what is left of the page."""
    if not html:
        return ""
    root = parse(html)
    template = wrapper.template(root) if wrapper else set()
    region = wrapper.region(root) if wrapper else None
    if region:
        template |= region[1]
        scope = region[0]
        if not any(A.whole_page(node.tag) for node in scope):
            return "\n\n".join(_left(scope, template))
    articles, mains = _find(root, "article", template), _find(root, "main", template)
    inside = {id(h) for node in articles for h in _find(node, "header")}
    # a header inside an article is its heading; elsewhere it is the site's
    template |= {id(h) for h in _find(root, "header")} - inside
    whole = _left([root], template)
    size = sum(map(len, whole))
    for scope in (articles, mains):
        if scope:
            out = _left(scope, template)
            if out and 2 * sum(map(len, out)) >= size:
                return "\n\n".join(out)
    return "\n\n".join(whole)


def _left(scope: list[Node], template: set[int]) -> list[str]:
    """Blocks of the elements of a scope that are no template."""
    out: list[str] = []
    for node in scope:
        if id(node) not in template:
            _blocks(node, template, out, [])
    return out


_held: dict[tuple[str, str], Wrapper | None] = {}
_schema = T.StructType().add("text", "string").add("n_chars", "long")
_SURVEYED = "_host string, _text long, _layout long, _keys array<long>, _shape string, _letters array<int>, _linked array<int>, _titled array<int>, _hashes array<long>"
_TEMPLATES = T.ArrayType(T.StructType().add("skeleton", "string").add("decisions", "string"))


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SURVEYED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64())]
    for batch in batches:
        rows = []
        for html in batch.column(1).to_pylist():
            root = parse(html)
            own, slots = Survey(root), Outline(root)
            rows.append((own.text, own.layout, own.keys(), slots.skeleton.encoded(), slots.letters, slots.linked, [*map(int, slots.titled)], slots.hashes))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)


def surveyed(pages: DataFrame) -> DataFrame:
    """What every page says, from (_host, html); of a host's pages with equal text the least counts."""
    found = pages.where("length(html) > 0").select("_host", "html").mapInArrow(_surveyed, _SURVEYED)
    rest = [c for c in found.columns if c not in ("_host", "_text")]
    return found.groupBy("_host", "_text").agg(F.min(F.struct(*rest)).alias("_s")).select("_host", "_text", "_s.*")


def repeated(once: DataFrame) -> DataFrame:
    """(_host, _group, _key, _n): how many pages of each host (group 0) and of each of its layouts have an element, if enough have; a null key stands for all pages.

    Elements are counted with partial aggregates, so a large host is no large task.
    """
    by_group = once.select("_host", F.explode(F.array(F.lit(0).cast("long"), "_layout")).alias("_group"), "_keys")
    spots = by_group.select("_host", "_group", F.explode(F.concat(F.array(F.lit(None).cast("long")), "_keys")).alias("_key"))
    return spots.groupBy("_host", "_group", "_key").agg(F.count("*").alias("_n")).where(F.col("_n") > CONSTANT_PAGES)


def constants_of(counts: DataFrame) -> DataFrame:
    """(_host, _group, _strict, _weak): the keys of the constants of each host and layout, from what ``repeated`` gives."""
    totals = counts.where("_key is null").select("_host", "_group", F.col("_n").alias("_of"))
    share = F.col("_n") / F.col("_of")
    kept = counts.where("_key is not null").join(totals, ["_host", "_group"]).where((share >= CONSTANT_SHARE) | (F.col("_group") == 0) & (share >= WEAK_SHARE))
    strict = share >= CONSTANT_SHARE
    return kept.groupBy("_host", "_group").agg(F.sort_array(F.collect_list(F.when(strict, F.col("_key")))).alias("_strict"), F.sort_array(F.collect_list(F.when(~strict, F.col("_key")))).alias("_weak"))


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[t.encoded() for t in A.templates([A.Skeleton.decoded(r["_shape"]) for r in sorted(rows, key=lambda r: r["_rank"])])] for rows in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["_host", "_grown"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, slots = [], []
        for shape, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = A.Skeleton.decoded(shape)
            k, pairs = A.placed(own, [A.Skeleton.decoded(t) for t in found])
            at.append(k)
            slots.append([pairs.get(i, -1) for i in range(len(own.keys))])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array(slots, pa.list_(pa.int32()))], names=["_host", "_shape", "_at", "_slots"])


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for found, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept = [A.Skeleton.decoded(t) for t in found]
            votes = [[A.Votes() for _ in t.keys] for t in kept]
            for r in rows:
                votes[r["_at"]][r["_slot"]] = A.Votes(r["pages"], r["letters"], r["linked"], r["titled"], r["same"])
            out.append([{"skeleton": text, "decisions": A.decided(t, v, v[0].pages)} for text, t, v in zip(found, kept, votes, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("skeleton", pa.string()), ("decisions", pa.string())])))], names=["_host", "_templates"])


def templates_of(once: DataFrame, scratch: Scratch) -> DataFrame:
    """(_host, _templates): each host's templates with their decisions. All pages vote, by partial aggregates; a host's templates, at most ``SEEDS``, are one row."""
    counts = once.groupBy("_host", "_shape").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("_host").orderBy(F.desc("_n"), "_shape")
    frequent = counts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= SEEDS)
    grown = scratch.save(frequent.groupBy("_host").agg(F.collect_list(F.struct("_rank", "_shape")).alias("_rows")).mapInArrow(_grown, "_host string, _grown array<string>"), "grown")
    placed = counts.select("_host", "_shape").join(grown, "_host").select("_host", "_shape", "_grown").mapInArrow(_aligned, "_host string, _shape string, _at int, _slots array<int>")
    placed = scratch.save(placed.where("_at >= 0"), "placed").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = once.withColumn("_salt", F.pmod("_text", F.lit(SALTS)).cast("int")).join(placed, ["_host", "_shape", "_salt"])
    spots = dealt.select("_host", "_at", F.explode(F.arrays_zip("_slots", "_letters", "_linked", "_titled", "_hashes")).alias("v")).where("v._slots >= 0")
    by_text = spots.groupBy("_host", "_at", F.col("v._slots").alias("_slot"), "v._hashes").agg(F.count("*").alias("n"), *[F.sum(f"v._{c}").alias(c) for c in ("letters", "linked", "titled")])
    votes = by_text.groupBy("_host", "_at", "_slot").agg(F.sum("n").alias("pages"), *[F.sum(c).alias(c) for c in ("letters", "linked", "titled")], F.max("n").alias("same"))
    rows = votes.groupBy("_host").agg(F.collect_list(F.struct("_at", "_slot", "pages", "letters", "linked", "titled", "same")).alias("_rows"))
    return grown.join(rows, "_host").select("_host", "_grown", "_rows").mapInArrow(_voted, T.StructType().add("_host", "string").add("_templates", _TEMPLATES))


def _read(templates: list | None) -> list[tuple[A.Skeleton, str]]:
    return [(A.Skeleton.decoded(t["skeleton"]), t["decisions"]) for t in templates or ()]


def main_text(pages: DataFrame, keep: list | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``keep`` (default page_id, url) of every page with text and n_chars (its code points).

    A null or empty html gives an empty text; a url without host, or a null one, belongs to the host ''. Pages are read whole, whatever their
    length. Rows that repeat are each extracted and vote once. Skeletons that are equally frequent stand in order of their text, so reruns agree. Without pages there are no rows; columns of
    other names, clashing ones too, stay out.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark)
    keep = keep or ["page_id", "url"]
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    own = pages.withColumn("_host", host)
    once = scratch.save(surveyed(own), "once")
    constants = scratch.save(constants_of(scratch.save(repeated(once), "counts")), "constants")
    templates = scratch.save(templates_of(once, scratch), "templates")
    scratch.drop("once", "counts", "grown", "placed")
    size = (constants.agg(F.sum(64 + 8 * (F.size("_strict") + F.size("_weak")))).first()[0] or 0) + (templates.agg(F.sum(F.aggregate("_templates", F.lit(64).cast("long"), lambda n, t: n + 2 * F.length(t["skeleton"]) + F.length(t["decisions"])))).first()[0] or 0)
    call = uuid.uuid4().hex
    picked = [*keep, "_host", F.col("html").alias("_html")]
    fields = own.select(*keep).schema.fields
    n = len(fields)
    if size <= BROADCAST_BYTES:
        held: dict[str, tuple[dict, list]] = {}
        for r in constants.toLocalIterator():
            held.setdefault(r["_host"], ({}, []))[0][r["_group"]] = (array("q", r["_strict"]), array("q", r["_weak"]))
        for r in templates.toLocalIterator():
            held.setdefault(r["_host"], ({}, []))[1].extend((t["skeleton"], t["decisions"]) for t in r["_templates"])
        shared = spark.sparkContext.broadcast(held)
        source = own.select(*picked)
    else:  # each page gets the templates of its host and the constants of its host and of its own layout
        shared = None

        def with_layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                layouts = [Survey(parse(html)).layout if html else None for html in batch.column(n + 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(layouts, pa.int64())], names=[*batch.schema.names, "_group"])

        named = own.select(*picked)
        source = named.mapInArrow(with_layout, T.StructType([*named.schema.fields, T.StructField("_group", T.LongType())]))
        source = source.withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int"))
        copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        by_host = templates.join(constants.where("_group = 0").select("_host", F.col("_strict").alias("_s0"), F.col("_weak").alias("_w0")), "_host", "full").select("_host", "_s0", "_w0", "_templates", copies)
        by_layout = constants.where("_group <> 0").select("_host", "_group", F.col("_strict").alias("_s1"), copies)
        source = source.join(by_layout, ["_host", "_group", "_salt"], "left").join(by_host, ["_host", "_salt"], "left")
        source = source.select(*[f.name for f in fields], "_host", "_html", "_group", "_s0", "_w0", "_s1", "_templates")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, texts = batch.column(n).to_pylist(), []
            for k, name in enumerate(hosts):
                if shared is None:
                    group, *keys, found = (batch.column(i)[k].as_py() for i in range(n + 2, n + 7))
                    own_wrapper = Wrapper({0: (keys[0] or (), keys[1] or ()), group: (keys[2] or (), ())}, _read(found))
                else:
                    if (call, name) not in _held:
                        if len(_held) >= KEPT:
                            _held.clear()
                        got = shared.value.get(name)
                        _held[call, name] = Wrapper(got[0], [(A.Skeleton.decoded(t), d) for t, d in got[1]]) if got else None
                    own_wrapper = _held[call, name]
                texts.append(extract(batch.column(n + 1)[k].as_py(), own_wrapper))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], names=[*[f.name for f in fields], "text", "n_chars"])

    return source.mapInArrow(apply, T.StructType([*fields, *_schema.fields]))
