"""Registry of queries with their SQL, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader under its name, with the SQL that gives the same rows."""

    def register(make: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[make.__name__] = sql
        return make

    return register


def document_pages(read) -> DataFrame:
    """Documents as pages: a source is a document, doc_id its page order."""
    return read("documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), "text")


def conversation_pages(read) -> DataFrame:
    """Conversations as documents: a turn is a page."""
    return read("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text")


# SQL fragments in DuckDB's dialect


def lines(t: str) -> str:
    parts = rf"string_split_regex({t}, '\r\n|[\n\r\v\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f"list_transform([{parts}], lambda sp: CASE WHEN sp[-1] = '' THEN sp[1:len(sp)-1] ELSE sp END)[1]"


def bare(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapsed(x: str) -> str:
    return rf"regexp_replace({bare(x)}, '\s+', ' ', 'g')"


def plain(x: str) -> str:
    for pattern, by in ((r"^```.*$", " "), (r"^\s*#{1,6}\s", " "), (r"!\[\]\([^)]*\)", " "), (r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"[*_`]+", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def tokens(t: str) -> str:
    return f"list_filter(string_split_regex(lower(array_to_string(list_transform({lines(t)}, lambda l: {plain('l')}), chr(10))), '[^a-z0-9]+'), lambda x: x <> '')"


def nonblank(t: str) -> str:
    return f"list_filter({lines(t)}, lambda x: {bare('x')} <> '')"


def candidates(t: str) -> str:
    return f"list_transform([{nonblank(t)}], lambda ne: list_concat(ne[1:2], ne[-2:]))[1]"


def occurrences(t: str, part: str) -> str:
    return f"((length({t}) - length(replace({t}, {part}, ''))) / length({part}))"


HALF = "substr(text, 1, length(text) // 2)"
H1 = "coalesce(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '')"
