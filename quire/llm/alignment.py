"""Alignment of page skeletons by simple tree matching, and what the slots of the aligned pages hold.

A skeleton is a page's tree of containers; siblings of the same tag and label are one slot. Two skeletons are aligned by simple tree matching (Yang,
1991): roots of one key match, and among their children the matching in order that covers most nodes. Siblings have distinct keys, so a child has one possible
partner and the best matching in order is the heaviest increasing sequence: the same optimum as the quadratic table, in n log n.

The frequent skeletons of a host grow into templates by partial alignment (Zhai and Liu, 2005): what a similar skeleton has more is inserted where its
neighbours stand. Votes of all pages then say of each slot whether its text is constant, how long it is and how much of it is links; ``decided`` finds the
content region from them.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

#: Share of the nodes of two skeletons that must match for one template, and for a page to be read by it.
SAME_TEMPLATE, READABLE = 0.6, 0.5
#: Pages of different text that a template needs, share of them that repeat a slot's text if it is constant, share of the plain text that the content region holds of its parent's, and share of links that makes a list of links.
PAGES, CONSTANT, DOMINANT, LINKED = 3, 0.6, 0.6, 0.5
CONTENT, DROPPED, OUTSIDE = "c", "d", "o"


@dataclass
class Skeleton:
    """Nodes, parents before their children and siblings in order: keys, and the parent of each (the root's is -1)."""

    keys: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)

    def add(self, key: str, parent: int) -> int:
        self.keys.append(key)
        self.parents.append(parent)
        return len(self.keys) - 1

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.keys]
        for i, p in enumerate(self.parents):
            if p >= 0:
                out[p].append(i)
        return out

    def encoded(self) -> str:
        return "\n".join(f"{p} {k}" for p, k in zip(self.parents, self.keys, strict=True))

    @classmethod
    def decoded(cls, text: str) -> Skeleton:
        rows = [line.split(" ", 1) for line in text.split("\n")]
        return cls([k for _, k in rows], [int(p) for p, _ in rows])


def _heaviest(pairs: list[tuple[int, int]], weights: list[int]) -> list[int]:
    """Which of the pairs (in order of their first number) make the heaviest sequence whose second numbers increase."""
    ends, totals, tails, before = [], [], [], []
    for k, ((_, j), w) in enumerate(zip(pairs, weights, strict=True)):
        at = bisect_left(ends, j)
        total = w + (totals[at - 1] if at else 0)
        before.append(tails[at - 1] if at else -1)
        while at < len(ends) and totals[at] <= total:
            del ends[at], totals[at], tails[at]
        if at == len(ends) or ends[at] != j:
            ends.insert(at, j)
            totals.insert(at, total)
            tails.insert(at, k)
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def matched(a: Skeleton, b: Skeleton) -> dict[int, int]:
    """Simple tree matching: node of ``a`` to node of ``b``, as many as an alignment in order has."""
    below_a, below_b = a.children(), b.children()
    # possible partners: nodes whose keys agree all the way up
    partner = {0: 0} if a.keys and b.keys and a.keys[0] == b.keys[0] else {}
    named = [{b.keys[j]: n for n, j in enumerate(own)} for own in below_b]
    for i in range(1, len(a.keys)):
        up = partner.get(a.parents[i])
        at = named[up].get(a.keys[i]) if up is not None else None
        if at is not None:
            partner[i] = below_b[up][at]
    weight, chosen = {}, {}
    for i in range(len(a.keys) - 1, -1, -1):  # children come after their parents
        if i not in partner:
            continue
        held = [c for c in below_a[i] if c in partner]
        best = _heaviest([(n, named[partner[i]][a.keys[c]]) for n, c in enumerate(held)], [weight[c] for c in held])
        chosen[i] = [held[k] for k in best]
        weight[i] = 1 + sum(weight[c] for c in chosen[i])
    out, wait = {}, [0] if partner else []
    while wait:
        i = wait.pop()
        out[i] = partner[i]
        wait += chosen[i]
    return out


def similarity(a: Skeleton, b: Skeleton, pairs: dict[int, int]) -> float:
    return 2 * len(pairs) / (len(a.keys) + len(b.keys)) if a.keys or b.keys else 1.0


def merged(template: Skeleton, own: Skeleton, pairs: dict[int, int]) -> Skeleton:
    """The template with the nodes that only ``own`` has, each after the sibling before it; what stands in another order is left out. ``pairs``: node of own to node of the template."""
    below_t, below_o = template.children(), own.children()
    out = Skeleton()

    def copy(source: Skeleton, below: list[list[int]], i: int, parent: int) -> None:
        at = out.add(source.keys[i], parent)
        for c in below[i]:
            copy(source, below, c, at)

    back = {t: o for o, t in pairs.items()}

    def grow(t: int, parent: int) -> None:
        at = out.add(template.keys[t], parent)
        o = back.get(t)
        after: dict[int, list[int]] = {}
        if o is not None:
            held, last = {template.keys[c] for c in below_t[t]}, -1
            for c in below_o[o]:
                if c in pairs:
                    last = pairs[c]
                elif own.keys[c] not in held:
                    after.setdefault(last, []).append(c)
        for c in after.get(-1, ()):
            copy(own, below_o, c, at)
        for c in below_t[t]:
            grow(c, at)
            for d in after.get(c, ()):
                copy(own, below_o, d, at)

    grow(0, -1)
    return out


def templates(frequent: list[Skeleton]) -> list[Skeleton]:
    """Templates from a host's skeletons, the most frequent first."""
    out: list[Skeleton] = []
    for own in frequent:
        found = [(similarity(own, t, matched(own, t)), -k) for k, t in enumerate(out)]
        score, k = max(found, default=(0.0, 0))
        if score >= SAME_TEMPLATE:
            out[-k] = merged(out[-k], own, matched(own, out[-k]))
        else:
            out.append(own)
    return out


def placed(own: Skeleton, found: list[Skeleton]) -> tuple[int, dict[int, int]]:
    """The template that a skeleton matches best and the alignment with it; -1 if none is like it."""
    best, at, pairs = 0.0, -1, {}
    for k, t in enumerate(found):
        now = matched(own, t)
        score = len(now) / max(1, len(own.keys))  # a template holds more than each of its pages
        if score > best:
            best, at, pairs = score, k, now
    return (at, pairs) if best >= READABLE else (-1, {})


@dataclass
class Votes:
    """What all pages have in a slot: pages, letters, letters in links, pages with a first heading there, pages of its most frequent text."""

    pages: int = 0
    letters: int = 0
    linked: int = 0
    titled: int = 0
    same: int = 0


def whole_page(key: str) -> bool:
    """Whether a slot is the page itself."""
    return key in ("#root", "html", "body")


def decided(template: Skeleton, votes: list[Votes], pages: int) -> str:
    """A letter for each node: content, dropped, or outside (holds the content region, and no content of its own). Empty if too few pages vote.

    Constant slots are template. From the root the region is the child that holds most of the plain text that varies, as long as there is one. A slot
    with a first heading before a region that has none is its title. Where no child of the whole page dominates, what varies is content but for lists of links.
    """
    if pages < PAGES:
        return ""
    below = template.children()
    constant = [v.letters > 0 and v.pages >= PAGES and v.same >= CONSTANT * v.pages for v in votes]
    plain = [0 if constant[i] else v.letters - v.linked for i, v in enumerate(votes)]
    out = [DROPPED] * len(votes)

    def keep(i: int) -> None:
        wait = [i]
        while wait:
            k = wait.pop()
            if not constant[k]:
                out[k] = CONTENT
                wait += below[k]

    at, titles = 0, []
    while True:
        child = max(below[at], key=lambda c: plain[c], default=None)
        # a constant child is no part of what varies
        varying = plain[at] - sum(votes[c].letters - votes[c].linked for c in below[at] if constant[c])
        if child is None or not plain[child] or plain[child] < DOMINANT * varying:
            break
        out[at] = OUTSIDE
        titles = [] if 2 * votes[child].titled >= votes[child].pages else titles + [c for c in below[at] if c < child and not constant[c] and 2 * votes[c].titled >= votes[c].pages]
        at = child
    keep(at)
    for c in titles:
        keep(c)
    if whole_page(template.keys[at]):
        for c in below[at]:
            if votes[c].linked >= LINKED * votes[c].letters > 0:
                out[c] = DROPPED
    return "".join(out)


def shown(own: Skeleton, found: list[tuple[Skeleton, str]]) -> list[str] | None:
    """A letter for each node of a page's skeleton, by the template that it matches best; a node that the template lacks is as its parent is. None if no template fits."""
    at, pairs = placed(own, [t for t, _ in found])
    if at < 0 or not found[at][1]:
        return None
    out: list[str] = []
    for i, parent in enumerate(own.parents):
        above = out[parent] if parent >= 0 else CONTENT
        out.append(found[at][1][pairs[i]] if i in pairs else DROPPED if above == OUTSIDE else above)
    return out
