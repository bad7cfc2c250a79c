"""Diagram sources: type, structure, representation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import SPACE, is_blank, lines, stripped

# The first word of a diagram's source, and the diagram type it names.
TYPES = {
    "graph": "flowchart",
    "flowchart": "flowchart",
    "sequencediagram": "sequenceDiagram",
    "classdiagram": "classDiagram",
    "statediagram": "stateDiagram-v2",
    "statediagram-v2": "stateDiagram-v2",
    "erdiagram": "erDiagram",
    "gantt": "gantt",
    "mindmap": "mindmap",
    "timeline": "timeline",
    "journey": "journey",
    "pie": "pie",
    "gitgraph": "gitGraph",
    "quadrantchart": "quadrantChart",
    "xychart-beta": "xychart-beta",
    "sankey-beta": "sankey-beta",
    "architecture-beta": "architecture-beta",
    "radar-beta": "radar-beta",
    "kanban": "kanban",
}
# Charts whose faithful fallback is a table.
DATA_CHARTS = ("pie", "xychart-beta", "sankey-beta", "radar-beta")
ALLOWED = tuple(sorted(set(TYPES.values())))


def without_fences(source: Column) -> Column:
    """Without fence lines around it, stripped."""
    opened = F.regexp_replace(F.array_join(lines(source), "\n"), rf"(?i)^(?:{SPACE}*```(?:mermaid)?[^\S\n]*(?:\n|$))+", "")
    return stripped(F.regexp_replace(opened, rf"(?:(?:^|\n)[^\S\n]*```{SPACE}*)+$", ""))


def _is_comment(line: Column) -> Column:
    return stripped(line).startswith("%%")


def first_line(source: Column) -> Column:
    """The first line that is neither blank nor a comment, stripped; else empty."""
    return F.coalesce(F.try_element_at(F.transform(F.filter(lines(source), lambda x: ~is_blank(x) & ~_is_comment(x)), stripped), F.lit(1)), F.lit(""))


def diagram_type(source: Column) -> Column:
    """Canonical type, or null."""
    word = F.lower(F.regexp_replace(F.element_at(F.split(first_line(source), f"{SPACE}+"), 1), ":+$", ""))
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.try_element_at(known, word)


def problem(source: Column, allowed: Column) -> Column:
    """Why a source can't be used; null if it can. The first of: empty, left-over marks, unknown type, type not allowed, no body."""
    bare = without_fences(source)
    kind = diagram_type(bare)
    rows = lines(bare)
    body = F.filter(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda x: ~is_blank(x) & ~_is_comment(x))
    return (
        F.when(bare == "", "empty Mermaid source")
        .when(F.contains(bare, F.lit("<<<")) | F.contains(bare, F.lit("<!--FIG:")), "Mermaid source contains leftover envelope/figure markers")
        .when(kind.isNull(), F.concat(F.lit("unrecognized Mermaid diagram type: '"), F.substring(first_line(bare), 1, 40), F.lit("'")))
        .when(~F.array_contains(allowed, kind), F.concat(F.lit("Mermaid type '"), kind, F.lit("' not in allowlist")))
        .when(F.size(body) == 0, F.concat(kind, F.lit(" diagram has no body")))
    )


def is_data_chart(kind: Column) -> Column:
    return F.coalesce(kind.isin(*DATA_CHARTS), F.lit(False))


def representation(convertible: Column, source: Column, kind: Column, has_data: Column, fallback: Column) -> Column:
    """mermaid, table or image."""
    return F.when(convertible & (source != ""), "mermaid").when(is_data_chart(kind) & has_data & fallback.isin("table", "both"), "table").otherwise("image")


def conversion(parsed: dict[str, Column], *, least: int = 80, allowed: Column, verify: Column, approved: Column, fidelity: Column) -> Column:
    """Outcome of a figure's conversion: struct (convertible, diagram_type, confidence, reason).

    ``parsed`` has error, convertible, mermaid, diagram_type and confidence. The first that holds decides: malformed, not convertible, too little confidence,
    unusable source, refused by the verifier, else accepted with the type that the source shows.
    """
    bad = problem(parsed["mermaid"], allowed)
    no = lambda reason: F.struct(F.lit(False).alias("convertible"), parsed["diagram_type"].alias("diagram_type"), parsed["confidence"].alias("confidence"), reason.alias("reason"))
    malformed = F.struct(F.lit(False).alias("convertible"), F.lit("").alias("diagram_type"), F.lit(0).alias("confidence"), F.concat(F.lit("malformed diagram envelope: "), parsed["error"]).alias("reason"))
    confidence = F.when(verify, F.greatest(parsed["confidence"], fidelity)).otherwise(parsed["confidence"])
    yes = F.struct(F.lit(True).alias("convertible"), F.coalesce(diagram_type(without_fences(parsed["mermaid"])), parsed["diagram_type"]).alias("diagram_type"), confidence.alias("confidence"), F.lit("").alias("reason"))
    return (
        F.when(parsed["error"].isNotNull(), malformed)
        .when(~parsed["convertible"], no(F.lit("agent reported not convertible")))
        .when(parsed["confidence"] < least, no(F.format_string(f"confidence %d < {least}", parsed["confidence"])))
        .when(bad.isNotNull(), no(bad))
        .when(verify & ~approved, no(F.format_string("verifier rejected Mermaid (fidelity %d)", fidelity)))
        .otherwise(yes)
    )
