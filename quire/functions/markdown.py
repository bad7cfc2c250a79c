"""Functions over markdown documents and figure markup, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import SPACE, bound, collapsed, lines, nonblank, stripped

HEADING = rf"^(#{{1,6}}){SPACE}+(.*)$"
TABLE_ROW = rf"^{SPACE}*\|.*\|{SPACE}*$"
SEPARATOR = rf"^{SPACE}*\|?(?:{SPACE}|[:|-])+\|?(?:{SPACE}|[:|-])*$"
LIST_ITEM = rf"^{SPACE}*(?:[-*+]|(?U)\d+[.)]){SPACE}+(?U)\S"
FIGURE_TOKEN = r"<!--FIG:(?:page:(\d+)|(\d+):(\d+)):([\d.,]+)-->"
FIGURE_MARK = "<!--FIG:"
ASSET_LINK = r"\[[^\]]*\]\((assets/[^)\s]+)\)"
MOST_ALT = 125


def heading_level(line: Column) -> Column:
    """1 to 6, or 0 for another line."""
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_text(line: Column) -> Column:
    return stripped(F.regexp_extract(line, HEADING, 2))


def slug(heading: Column) -> Column:
    """The anchor that a heading gets: lower case, without punctuation, hyphens for white space."""
    bare = F.regexp_replace(F.lower(stripped(heading)), r"(?U)[^\w\s\x1c-\x1f-]", "")
    return F.regexp_replace(bare, rf"{SPACE}+", "-")


def shifted_headings(text: Column) -> Column:
    """Headings moved up so that the highest is of level 1; text that needs no move stays as it is."""
    top = F.array_min(F.filter(F.transform(lines(text), heading_level), lambda n: n > 0))

    def moved(own: Column) -> Column:
        shift = lambda x: F.concat(F.repeat(F.lit("#"), heading_level(x) - own["top"] + 1), F.lit(" "), F.regexp_extract(x, HEADING, 2))
        return F.array_join(F.transform(own["rows"], lambda x: F.when(heading_level(x) > 0, shift(x)).otherwise(x)), "\n")

    return F.when(top > 1, bound(F.struct(lines(text).alias("rows"), top.alias("top")), moved)).otherwise(text)


def table_of_contents(text: Column) -> Column:
    """A nested list of links to the headings."""
    entry = lambda x: F.concat(F.repeat(F.lit("  "), heading_level(x) - 1), F.lit("- ["), heading_text(x), F.lit("](#"), slug(heading_text(x)), F.lit(")"))
    return F.array_join(F.transform(F.filter(lines(text), lambda x: heading_level(x) > 0), entry), "\n")


def is_separator(line: Column) -> Column:
    return line.rlike(SEPARATOR)


def is_table_row(line: Column) -> Column:
    return line.rlike(TABLE_ROW) & ~is_separator(line)


def _last(text: Column) -> Column:
    return F.coalesce(F.try_element_at(nonblank(text), F.lit(-1)), F.lit(""))


def _first(text: Column) -> Column:
    return F.coalesce(F.try_element_at(nonblank(text), F.lit(1)), F.lit(""))


def ends_in_row(text: Column) -> Column:
    return is_table_row(_last(text))


def starts_with_row(text: Column) -> Column:
    first = _first(text)
    return (first != "") & (is_table_row(first) | is_separator(first))


def ends_in_item(text: Column) -> Column:
    return _last(text).rlike(LIST_ITEM)


def starts_with_item(text: Column) -> Column:
    return _first(text).rlike(LIST_ITEM)


def without_leading_separator(text: Column) -> Column:
    """Without its first line that isn't blank, if that is a table separator."""
    rows = lines(text)
    at = F.array_position(F.transform(rows, lambda x: stripped(x) != ""), True).cast("int")
    rest = F.concat(F.slice(rows, F.lit(1), at - 1), F.slice(rows, at + 1, F.greatest(F.size(rows) - at, F.lit(0))))
    return F.when((at > 0) & is_separator(_first(text)), F.array_join(rest, "\n")).otherwise(text)


def placeholders(text: Column) -> Column:
    """The figure tokens in order, as structs (token, page, idx, x0, y0, x1, y1); page is null in the form that doesn't name it. Tokens without four numbers are left out."""
    number = lambda t, g: F.regexp_extract(t, FIGURE_TOKEN, g).try_cast("long")

    def parsed(t: Column) -> Column:
        xs = F.transform(F.split(F.regexp_extract(t, FIGURE_TOKEN, 4), ","), lambda x: x.try_cast("double"))
        named = F.regexp_extract(t, FIGURE_TOKEN, 1) != ""
        return F.struct(t.alias("token"), F.when(~named, number(t, 2)).alias("page"), F.when(named, number(t, 1)).otherwise(number(t, 3)).alias("idx"), *[F.get(xs, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.size(F.filter(xs, lambda x: x.isNotNull())).alias("k"), F.size(xs).alias("n"))

    found = F.transform(F.regexp_extract_all(text, F.lit(FIGURE_TOKEN), F.lit(0)), parsed)
    return F.transform(F.filter(found, lambda r: (r["k"] == 4) & (r["n"] == 4)), lambda r: F.struct(*[r[c].alias(c) for c in ("token", "page", "idx", "x0", "y0", "x1", "y1")]))


def leftover_tokens(text: Column) -> Column:
    """Figure tokens that are left in a text: the well-formed ones, others once each, and a mark that never closes."""
    good = F.transform(placeholders(text), lambda r: r["token"])
    any_ = F.regexp_extract_all(text, F.lit(r"<!--FIG:.*?-->"), F.lit(0))
    open_ = F.when(F.contains(text, F.lit(FIGURE_MARK)) & (F.size(any_) == 0), F.array(F.lit(f"{FIGURE_MARK} (unterminated)"))).otherwise(F.array().cast("array<string>"))
    return F.concat(good, F.array_except(any_, good), open_)


def short_alt(alt: Column) -> Column:
    """At most 125 characters of alternative text."""
    bare = collapsed(alt)
    cut = F.regexp_replace(F.substring(bare, 1, MOST_ALT - 1), rf"{SPACE}+$", "")
    return F.when(F.length(bare) > MOST_ALT, F.concat(cut, F.lit("…"))).otherwise(bare)


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *parts)


def image_block(file: Column, alt: Column, caption: Column, details: bool = True) -> Column:
    """Image link, caption, and the whole description where the alternative text is cut."""
    short, whole = short_alt(alt), collapsed(alt)
    long = F.when(whole != short, F.concat(F.lit("<details>\n<summary>Image description</summary>\n\n"), whole, F.lit("\n</details>"))) if details else F.lit(None).cast("string")
    return _joined(F.concat(F.lit("!["), short, F.lit("](assets/"), file, F.lit(")")), F.when(caption != "", F.concat(F.lit("*"), caption, F.lit("*"))), long)


def mermaid_block(source: Column, description: Column, image: Column, keep_image: Column) -> Column:
    """Diagram source first, the original picture folded below."""
    return _joined(
        F.concat(F.lit("```mermaid\n"), source, F.lit("\n```")),
        F.when(description != "", F.concat(F.lit("*"), description, F.lit("*"))),
        F.when(keep_image, F.concat(F.lit("<details>\n<summary>Original figure</summary>\n\n"), image, F.lit("\n</details>"))),
    )


def pipe_table(columns: Column, rows: Column) -> Column:
    """A pipe table; empty without columns. Bars are escaped in cells."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: row(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))))
    return F.when(F.size(columns) == 0, "").otherwise(F.array_join(F.concat(F.array(row(columns), row(F.transform(columns, lambda _: F.lit("---")))), body), "\n"))


def table_block(columns: Column, rows: Column, description: Column, image: Column) -> Column:
    """Data table first, the picture below."""
    table = pipe_table(columns, rows)
    return _joined(F.when(table != "", table), F.when(description != "", F.concat(F.lit("*"), description, F.lit("*"))), image)


def figure_block(kind: Column, image: Column, mermaid: Column, table: Column) -> Column:
    """The block of a figure's representation."""
    return F.when(kind == "mermaid", mermaid).when(kind == "table", table).otherwise(image)


def first_replaced(text: Column, part: Column, by: Column) -> Column:
    """The first occurrence of ``part`` replaced, character for character."""
    at = F.instr(text, part)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + F.length(part), F.length(text)))).otherwise(text)


def substituted(text: Column, pairs: Column) -> Column:
    """Tokens replaced one after the other by their blocks; ``pairs`` is an array of structs (token, block)."""
    return F.aggregate(pairs, text, lambda t, p: first_replaced(t, p["token"], p["block"]))


def top_level_links(text: Column, docname: Column) -> Column:
    """Asset links as seen from above the document's folder."""
    return F.replace(text, F.lit("(assets/"), F.concat(F.lit("("), docname, F.lit("/assets/")))


def asset_name(page: Column, index: Column, ext: str = "png") -> Column:
    return F.format_string(f"page-%03d-img-%02d.{ext}", page.cast("int"), index.cast("int"))


def asset_links(text: Column) -> Column:
    """Targets of the links into the asset folder, in order."""
    return F.regexp_extract_all(text, F.lit(ASSET_LINK), F.lit(1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
