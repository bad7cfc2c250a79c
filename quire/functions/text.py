"""Text-quality functions over page markdown, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in Unicode, with the four information separators.
SPACE = r"(?U)[\s\x1c-\x1f]"
_VISIBLE = r"(?U)[^\s\x1c-\x1f]"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Stand around a kept label so that an empty one can be told; private-use characters.
_OPEN, _CLOSE = "\ue000", "\ue001"
#: Marks a reference's token, so that it sorts after the same token of the markdown and before any longer one.
_AFTER = "!"
# Markdown noise within a line, in the order in which it goes; {s} is white space. A group is a label that stays.
NOISE = (r"^```.*$", r"^{s}*#{{1,6}}{s}", r"!\[([^\]]*)\]\([^)]*\)", r"\[([^\]]*)\]\([^)]*\)", r"[*_`]+")
MIN_TOKENS = 30
FLOOR = 0.80


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row. An expression that stands inside a lambda would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines(text: Column) -> Column:
    """Lines at every Unicode line boundary; a break at the end begins no line."""
    return bound(F.split(text, _BREAK), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(_VISIBLE)


def nonblank(text: Column) -> Column:
    return F.filter(lines(text), lambda x: ~is_blank(x))


def collapsed(text: Column) -> Column:
    """Ends stripped, inner white space as single spaces."""
    return F.regexp_replace(stripped(text), rf"{SPACE}+", " ")


def word_count(text: Column) -> Column:
    """Runs without white space."""
    return F.size(F.filter(F.split(text, rf"{SPACE}+"), lambda x: x != ""))


def plain_line(line: Column) -> Column:
    """A line without markdown noise. An empty label is told from no match by the marks around it."""
    for pattern in (n.format(s=SPACE) for n in NOISE):
        if "(" not in pattern.replace("\\(", "").replace("(?U)", ""):
            line = F.regexp_replace(line, pattern, " ")
        else:
            marked = F.regexp_replace(line, pattern, f"{_OPEN}$1{_CLOSE}")
            line = F.translate(F.replace(marked, F.lit(_OPEN + _CLOSE), F.lit(" ")), _OPEN + _CLOSE, "")
    return line


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order, after markdown marks are taken out line by line."""
    plain = F.lower(F.array_join(F.transform(lines(text), plain_line), "\n"))
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda x: x != "")


def recall(reference: Column, markdown: Column, least: int = MIN_TOKENS) -> Column:
    """Share of the reference's tokens, repeats counted, that occur in the markdown; null under ``least`` reference tokens.

    Both are token arrays. They are merged in order, the markdown's tokens each once and before equal ones of the reference: one sort and one pass.
    """
    own = F.transform(reference, lambda t: F.concat(t, F.lit(_AFTER)))
    merged = F.sort_array(F.concat(F.array_distinct(markdown), own))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("hits"))
    step = lambda s, x: F.when(F.endswith(x, F.lit(_AFTER)), F.struct(s["last"].alias("last"), (s["hits"] + (x == s["last"]).cast("int")).alias("hits"))).otherwise(F.struct(F.concat(x, F.lit(_AFTER)).alias("last"), s["hits"].alias("hits")))
    hits = F.aggregate(merged, start, step, lambda s: s["hits"])
    return F.when(F.size(reference) >= least, hits.cast("double") / F.size(reference))


def percent(share: Column) -> Column:
    """A share as a whole percentage, half to even."""
    return F.format_string("%.0f%%", F.bround(share * 100, 0))


def floor_failure(score: Column, floor: float = FLOOR) -> Column:
    """Reason why a page falls below the coverage floor; null if it doesn't, or can't be measured."""
    return F.when(score < floor, F.concat(F.lit("coverage floor not met: token recall "), percent(score), F.lit(" < "), percent(F.lit(floor)), F.lit(" (judge score alone is insufficient)")))


def outline(text: Column) -> Column:
    """Stripped lines that begin with a number sign."""
    return F.filter(F.transform(lines(text), stripped), lambda x: x.startswith("#"))


def candidate_lines(text: Column) -> Column:
    """The first two and the last two lines that aren't blank; a short page gives some twice."""
    return bound(nonblank(text), lambda full: F.concat(F.slice(full, 1, 2), F.slice(full, F.greatest(F.lit(1), F.size(full) - 1), 2)))


def occurrences(text: Column, part: Column | str) -> Column:
    """How often ``part`` occurs without overlap."""
    part = F.lit(part) if isinstance(part, str) else part
    return (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)


def degenerate(text: Column) -> Column:
    """Whether recognised text looks like an endless loop of fences or of its own beginning."""
    fence = "```"
    loop = (F.length(text) > 4000) & (occurrences(text, F.substring(text, 1, 20)) > 30)
    return F.coalesce((occurrences(text, fence) > 25) | (occurrences(text, f"{fence}\n{fence}") > 10) | loop, F.lit(False))


def native_viable(text: Column, least: int = 20) -> Column:
    """Whether a native text layer can serve as reference: enough words, or long words as in scripts without spaces."""
    bare = stripped(text)
    words = word_count(bare)
    return F.coalesce((words >= least) | ((words > 0) & (F.length(bare) >= 8 * words) & (F.length(bare) >= 3 * least)), F.lit(False))


def born_digital(pages: Column) -> Column:
    """Whether one of the first three page texts has 50 characters."""
    return F.exists(F.slice(pages, 1, 3), lambda p: F.length(stripped(p)) >= 50)


def reference_route(native: Column, native_first: Column, ocr: Column, least: int = 20) -> Column:
    """native, ocr or vision."""
    return F.when(native_first & native_viable(native, least), "native").when(ocr, "ocr").otherwise("vision")


def page_gate(verdict: Column, coverage: Column, score: Column, threshold: int = 95, floor: float = FLOOR) -> Column:
    """Whether a page passes: verdict, judge's coverage, and the coverage floor where it can be measured."""
    return F.coalesce((verdict == "pass") & (coverage >= threshold) & floor_failure(score, floor).isNull(), F.lit(False))


def dpi_ladder(dpi: Column) -> Column:
    """Resolutions to try in turn."""
    return F.when(dpi <= 80, F.array(dpi)).otherwise(F.array_distinct(F.array(dpi, F.lit(80), F.lit(72))))


def next_dpi(dpi: Column, step: int = 100, most: int = 400) -> Column:
    return F.least(F.lit(most), dpi + step)


def safe_stem(name: Column) -> Column:
    """A file stem with letters, digits, hyphens and underscores only."""
    return F.when(name == "", "upload").otherwise(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"))


def safe_docname(name: Column) -> Column:
    """Whether a name is one path segment."""
    return F.coalesce((name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/\\]"), F.lit(False))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)
