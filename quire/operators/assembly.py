"""Pages to documents: running furniture, ordered joins, contents, rolling context.

A page table has the columns doc_id, page_number, text.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions import text as X

RECURRENCE, SIMILAR = 0.6, 0.9
_HAS_TOKEN = r"<!--FIG:(?:page:\d+|\d+:\d+):[\d.,]+-->"
#: Characters whose counts bound a similarity from above.
_COUNTED = "etanoirs ,"


def similar(threshold: float = SIMILAR):
    """Two normalised lines: equal, or neither empty and of a matching-blocks ratio of ``threshold`` or more."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> bool:
            if x == y:
                return True
            if not x or not y:
                return False
            m = SequenceMatcher(None, x, y)
            return m.quick_ratio() >= threshold and m.ratio() >= threshold

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    return alike


def candidates(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, pos, line, key): the lines where running furniture stands, without figure tokens."""
    found = pages.select("doc_id", "page_number", F.posexplode(X.candidate_lines(F.col("text"))).alias("pos", "line"))
    return found.withColumn("key", X.collapsed(F.col("line")))


def furniture_exact(pages: DataFrame, recurrence: float = RECURRENCE) -> DataFrame:
    """(doc_id, key, hits, total) of the lines that stand at the edge of enough of a document's pages; documents of one page have none."""
    total = pages.groupBy("doc_id").agg(F.count("*").alias("total"))
    hits = candidates(pages).where(~F.col("line").rlike(_HAS_TOKEN)).groupBy("doc_id", "key").agg(F.count_distinct("page_number").alias("hits"))
    return hits.join(total, "doc_id").where((F.col("total") >= 2) & (F.col("hits") / F.col("total") >= recurrence))


def furniture_similar(pages: DataFrame, recurrence: float = RECURRENCE, threshold: float = SIMILAR) -> DataFrame:
    """(doc_id, key, hits, total) with similar lines counted together.

    Only lines that can be similar meet: similar lengths put them into the same band or neighbouring ones, and the counts of frequent characters
    bound the ratio from above. A line whose bands hold too few pages can't recur often enough and meets none. Every line is its own match.
    """
    total = pages.groupBy("doc_id").agg(F.count("*").alias("total")).where("total >= 2")
    # lengths of similar lines differ by this factor at most
    factor = ((2 - threshold) / threshold) ** 1.001 if threshold < 1 else 1
    band = F.floor(F.log(F.greatest(F.length("key"), F.lit(1))) / math.log(factor)) if factor > 1 else F.length("key").cast("long")
    lines = candidates(pages).select("doc_id", "page_number", "key", (~F.col("line").rlike(_HAS_TOKEN)).alias("free"), band.alias("band")).distinct()
    near_bands = F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band")
    held = lines.select("doc_id", "page_number", near_bands).groupBy("doc_id", "band").agg(F.count_distinct("page_number").alias("held"))
    counts = F.array(*[F.length("key") - F.length(F.replace("key", F.lit(c), F.lit(""))) for c in _COUNTED])
    keys = lines.groupBy("doc_id", "band", "key").agg(F.max("free").alias("free")).withColumn("counts", counts).withColumn("n", F.length("key"))
    may_recur = held.join(total, "doc_id").where(F.col("held") / F.col("total") >= recurrence).select("doc_id", "band")
    left = keys.where("free").join(may_recur, ["doc_id", "band"], "left_semi")
    right = keys.select("doc_id", F.col("key").alias("b"), F.col("n").alias("bn"), F.col("counts").alias("bc"), near_bands)
    left = left.select("doc_id", "band", F.col("key").alias("a"), F.col("n").alias("an"), F.col("counts").alias("ac"))
    both = F.col("an") + F.col("bn")
    apart = F.aggregate(F.zip_with("ac", "bc", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    near = left.join(right, ["doc_id", "band"]).where((F.col("a") != F.col("b")) & (2 * F.least("an", "bn") >= threshold * both) & (apart <= (1 - threshold) * both))
    near = near.where(similar(threshold)("a", "b")).select("doc_id", "a", "b").union(left.select("doc_id", "a", F.col("a").alias("b")))
    hits = near.join(lines.select("doc_id", F.col("key").alias("b"), "page_number"), ["doc_id", "b"]).groupBy("doc_id", F.col("a").alias("key")).agg(F.count_distinct("page_number").alias("hits"))
    return hits.join(total, "doc_id").where(F.col("hits") / F.col("total") >= recurrence)


def without_furniture(pages: DataFrame, furniture: DataFrame, threshold: float | None = SIMILAR) -> DataFrame:
    """The pages without the lines that equal (or, with a threshold, resemble) their document's furniture; blank lines and figure tokens stay. Pages of documents without furniture are unchanged."""
    keys = furniture.groupBy("doc_id").agg(F.sort_array(F.collect_list("key")).alias("furniture"))

    @F.pandas_udf("array<string>")
    def resembling(lines: pd.Series, own: pd.Series) -> pd.Series:
        def same(x: str, y: str) -> bool:
            if x == y or not x or not y:
                return x == y
            m = SequenceMatcher(None, x, y)
            return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold

        return pd.Series([None if f is None else sorted({x for x in ls if any(same(x, y) for y in f)}) for ls, f in zip(lines, own, strict=True)])

    joined = pages.join(keys, "doc_id", "left")
    normal = F.transform(X.lines(F.col("text")), X.collapsed)
    gone = F.col("furniture") if threshold is None else resembling(F.array_distinct(normal), F.col("furniture"))
    joined = joined.withColumn("_gone", gone)
    kept = F.filter(X.lines(F.col("text")), lambda x: X.is_blank(x) | x.rlike(_HAS_TOKEN) | ~F.array_contains("_gone", X.collapsed(x)))
    cleaned = F.concat(F.btrim(F.array_join(kept, "\n"), F.lit("\n")), F.lit("\n"))
    return joined.withColumn("text", F.when(F.col("furniture").isNull(), F.col("text")).otherwise(cleaned)).drop("furniture", "_gone")


def furniture_pages(pages: DataFrame, furniture: DataFrame) -> DataFrame:
    """(doc_id, key, pages): pages that hold a furniture line anywhere, exactly."""
    lines = pages.select("doc_id", "page_number", F.explode(F.array_distinct(F.transform(X.lines(F.col("text")), X.collapsed))).alias("key"))
    found = lines.join(furniture.select("doc_id", "key"), ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.count_distinct("page_number").alias("pages"))
    return furniture.select("doc_id", "key").join(found, ["doc_id", "key"], "left").select("doc_id", "key", F.coalesce("pages", F.lit(0)).cast("long").alias("pages"))


def _kinds(text: Column) -> Column:
    """What a page's ends are: enough to choose every separator without looking at the text again."""
    return F.struct(
        M.starts_with_row(text).alias("row_head"),
        M.ends_in_row(text).alias("row_tail"),
        M.starts_with_item(text).alias("item_head"),
        M.ends_in_item(text).alias("item_tail"),
        X.is_blank(M.without_leading_separator(text)).alias("sole"),
    )


def joined_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, document): a document's pages in order. A table that goes on keeps its rows together (a repeated separator goes), a list goes on without a blank line, all else is parted by one.

    The choice at a page depends on the tail so far, a few flags that one fold carries over the pages; the text is joined once.
    """
    bare = F.btrim("text", F.lit("\n"))
    full = pages.where(~X.is_blank(F.col("text"))).select("doc_id", F.struct("page_number", bare.alias("text"), _kinds(bare).alias("k")).alias("p"))
    parts = full.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    # codes: 0 first page, 1 blank line, 2 list goes on, 3 table goes on
    fold = """aggregate(ps, named_struct('codes', '', 'row', false, 'item', false),
        (s, p) -> named_struct(
            'codes', concat(s.codes, case when s.codes = '' then '0' when s.row and p.k.row_head then '3' when s.item and p.k.item_head then '2' else '1' end),
            'row', if(s.codes <> '' and s.row and p.k.row_head and p.k.sole, s.row, p.k.row_tail),
            'item', if(s.codes <> '' and s.row and p.k.row_head and p.k.sole, s.item, p.k.item_tail)),
        s -> split(s.codes, ''))"""
    piece = lambda p, c: F.when(c == "0", p["text"]).when(c == "3", F.concat(F.lit("\n"), F.ltrim(M.without_leading_separator(p["text"]), F.lit("\n")))).otherwise(F.concat(F.when(c == "2", "\n").otherwise("\n\n"), p["text"]))
    out = parts.withColumn("codes", F.expr(fold))
    return out.select("doc_id", F.concat(F.array_join(F.zip_with("ps", "codes", piece), ""), F.lit("\n")).alias("document"))


def assembled(body: Column, contents: bool = True) -> Column:
    """Headings moved up; contents after the first line that begins with one number sign and a space (which they leave out), else at the top; none without headings."""
    label = "## Table of Contents\n\n"

    def cut(own: Column) -> Column:
        """The text up to its title line and after it; without a title all of it comes after."""
        title = F.regexp_instr(own, F.lit(r"(?m)^# "))
        after = F.when(title > 0, title - 1 + F.instr(F.concat(F.substring(own, title, F.length(own)), F.lit("\n")), F.lit("\n"))).otherwise(0)
        tail = F.substring(own, after + 1, F.length(own))
        return F.struct(own.alias("whole"), F.substring(own, F.lit(1), after).alias("head"), tail.alias("tail"), M.table_of_contents(tail).alias("toc"), (title > 0).alias("titled"))

    def put(p: Column) -> Column:
        above, below = F.concat(p["head"], F.lit("\n" + label), p["toc"], F.lit("\n"), p["tail"]), F.concat(F.lit(label), p["toc"], F.lit("\n\n"), p["tail"])
        return F.when(p["toc"] == "", p["whole"]).when(p["titled"], above).otherwise(below)

    shifted = M.shifted_headings(body)
    return X.bound(X.bound(shifted, cut), put) if contents else shifted


def rolling_context(pages: DataFrame, window: int = 3) -> DataFrame:
    """The pages with ``context``, the last pages' texts, and ``outline``, all headings before: strictly from earlier pages."""
    order = Window.partitionBy("doc_id").orderBy("page_number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    text = F.when(F.col("text") != "", F.col("text"))
    # empty pages don't count: each page knows how many full ones stand before it, and takes the last of those
    numbered = pages.withColumn("_full", F.count(text).over(before))
    near = Window.partitionBy("doc_id").orderBy("_full").rangeBetween(-window, -1)
    heads = F.flatten(F.collect_list(X.outline(F.coalesce("text", F.lit("")))).over(before))
    out = numbered.withColumn("outline", F.array_join(heads, "\n")).withColumn("context", F.array_join(F.collect_list(text).over(near), "\n\n"))
    return out.select(*pages.columns, "context", "outline")


def frontier_context(pages: DataFrame, frontier: DataFrame, window: int = 3) -> DataFrame:
    """(doc_id, page_number, context, outline) as ``rolling_context`` gives for the pages of ``frontier``, one a document, from finished pages before them.

    A document's headings are gathered once, for its one page, and only its last pages' texts.
    """
    at = frontier.select("doc_id", F.col("page_number").alias("_at"))
    before = pages.join(at, "doc_id").where("page_number < _at and text <> ''")
    latest = Window.partitionBy("doc_id").orderBy(F.desc("page_number"))
    last = before.select("doc_id", "page_number", "text").withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= window)
    context = last.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("_ps"))
    heads = before.select("doc_id", "page_number", X.outline(F.col("text")).alias("_heads")).where(F.size("_heads") > 0)
    heads = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "_heads"))).alias("_hs"))
    out = frontier.select("doc_id", "page_number").join(context, "doc_id", "left").join(heads, "doc_id", "left")
    return out.select("doc_id", "page_number", F.coalesce(F.array_join(F.col("_ps.text"), "\n\n"), F.lit("")).alias("context"), F.coalesce(F.array_join(F.flatten(F.col("_hs._heads")), "\n"), F.lit("")).alias("outline"))


def preview(pages: DataFrame, done: Column) -> DataFrame:
    """(doc_id, markdown): finished, non-empty pages in order."""
    full = pages.where(done & (F.col("text") != "")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("ps"))
    return full.select("doc_id", F.array_join(F.col("ps.text"), "\n\n").alias("markdown"))
