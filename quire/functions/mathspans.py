"""Math spans in markdown: rewritten for a renderer that unescapes once, and kept away from formatters.

A text is cut into prose and spans that alternate. The rewrite works on the spans, as column expressions; a formatter sees the prose with one
stand-in character for each span, and the spans come back in their order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import bound

# What a span is, text inside it, how an underscore in text is drawn, and the names of escaped braces.
SPAN = r"\$\$(?s:.*?)\$\$|\$[^$\n]+?\$"
TEXT = r"\\text\{([^{}]*)\}"
RULE = r"\rule[-0.05em]{0.35em}{0.5pt}"
LEFT, RIGHT = r"\lbrace ", r" \rbrace"

_STAND_INS = range(0xE000, 0xF900)


def _alternating(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with every match of the pattern (its whole) changed; what stands between is kept."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    changed = F.concat(F.transform(matches, change), F.array(F.lit("")))
    return F.array_join(F.flatten(F.zip_with(between, changed, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def _safe(span: Column) -> Column:
    """Underscores of text drawn as rules, escaped braces that touch something as named ones."""
    drawn = lambda own: F.replace(own, F.lit(r"\_"), F.lit(f"}}{RULE}\\text{{"))
    named = F.regexp_replace(_alternating(span, TEXT, drawn), r"\\\{(?!\s)", LEFT.replace("\\", r"\\"))
    return F.regexp_replace(named, r"(?<!\s)\\\}", RIGHT.replace("\\", r"\\"))


def github_math_safe(text: Column) -> Column:
    """Spans whose escapes survive being unescaped once; a span that is safe stays as it is. Null stays null."""
    return F.when(F.contains(text, F.lit("$")), bound(text, lambda t: _alternating(t, SPAN, _safe))).otherwise(text)


def formatted(text: str, formatter: Callable[[str], str]) -> str:
    """The formatter's output, with every math span as it was. A formatter that loses or repeats a stand-in is not trusted: the text stays."""
    cuts = [m.span() for m in re.finditer(SPAN, text)]
    if not cuts:
        return formatter(text)
    stand_in = next(chr(c) for c in _STAND_INS if chr(c) not in text)
    edges = [0, *(e for cut in cuts for e in cut), len(text)]
    pieces = [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    shown = formatter(stand_in.join(pieces[::2])).split(stand_in)
    if len(shown) != len(pieces[::2]):
        return text
    pieces[::2] = shown
    return "".join(pieces)


def normalized(text: Column, formatter: Callable[[str], str]) -> Column:
    """Markdown formatted by an injected function."""

    @F.pandas_udf("string")
    def done(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else formatted(x, formatter))

    return done(text)


def linted(text: Column, linter: Callable[[str], list[str]]) -> Column:
    """Warnings of an injected linter."""

    @F.pandas_udf("array<string>")
    def done(column: pd.Series) -> pd.Series:
        return column.map(lambda x: list(linter(x or "")))

    return done(text)
