"""Quotation linking: which earlier message does a message answer, and what does it say itself.

Lines that begin with ``>`` are quoted, as deep as they have ``>`` marks; lines of equal depth that follow each other are a passage. Passages and
their lines are normalised (letters and digits, lower case, single spaces) and hashed. The original of a hash is the earliest message
of the conversation that says it unquoted. A message replies to the message that most of its shallowest linked passages come from.
Threads follow the replies; within a thread the turns stand in order, so every reply comes after what it answers.

Everything is DataFrame expressions: parsing happens within a row, originals are found by a grouped minimum (so a line that
thousands say and thousands quote joins one row), and threads by doubling jumps along the replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import Scratch

#: Tasks that the rows of one conversation, or the replies to one message, are dealt over.
SALTS = 8
_MARKS = r"^(?: {0,3}>)+"
#: Words that end a line which introduces a quotation.
_INTRODUCES = r"(?i)(?:wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió|escribe)\s*:\s*$"


def _normal(x: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", F.lit(" "))))


def _passages(text: Column) -> Column:
    """Array of (level, lines): maximal runs of lines of equal depth."""
    return F.transform(
        F.split(text, r"\r\n|\r|\n"),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS + " ?", "").alias("line")),
    )


def _may_quote() -> Column:
    """Cheap test that every message with a quotation passes."""
    return F.coalesce(F.contains("text", F.lit(">")) & F.col("text").rlike(r"(?m)^ {0,3}>"), F.lit(False))


def parsed(messages: DataFrame) -> DataFrame:
    """The messages with ``runs``: array of (level, lines), and ``own``: the lines outside of quotations, without lines that introduce one."""
    out = messages.withColumn("_lines", F.when(F.col("text").isNotNull(), _passages(F.col("text"))))
    out = out.withColumn("_starts", F.expr("filter(sequence(1, size(_lines)), i -> i = 1 or _lines[i - 1].level <> _lines[i - 2].level)"))
    runs = "transform(_starts, (s, k) -> struct(_lines[s - 1].level as level, transform(slice(_lines, s, coalesce(get(_starts, k + 1), size(_lines) + 1) - s), z -> z.line) as lines))"
    out = out.withColumn("runs", F.expr(runs))
    last = F.lit(_INTRODUCES)
    own = F.transform(
        "runs",
        lambda r, k: F.when(r["level"] > 0, F.array().cast("array<string>"))
        .when((F.coalesce(F.get("runs", k + 1)["level"], F.lit(0)) > 0) & F.regexp_like(F.element_at(r["lines"], -1), last), F.slice(r["lines"], 1, F.size(r["lines"]) - 1))
        .otherwise(r["lines"]),
    )
    return out.withColumn("own", F.flatten(own)).drop("_lines", "_starts")


def _units(lines: Column) -> Column:
    """The normalised lines, and all of them as one, without empty ones."""
    return F.array_distinct(F.filter(F.concat(F.transform(lines, _normal), F.array(_normal(F.array_join(lines, " ")))), lambda x: x != ""))


def _copies() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt")


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) of every message that quotes an earlier one of its conversation; rows that share conv_id and turn are one message."""
    rows = messages.select("conv_id", "turn", "text").where("conv_id is not null and turn is not null")
    key = [F.xxhash64("unit").alias("h"), F.xxhash64(F.lit(1), "unit").alias("g")]
    quoted = parsed(rows.where(_may_quote())).where(F.exists("runs", lambda r: r["level"] > 0)).select("conv_id", "turn", F.posexplode(F.filter("runs", lambda r: r["level"] > 0)).alias("k", "run"))
    quoted = quoted.select("conv_id", "turn", "k", F.col("run.level").alias("level"), F.explode(_units(F.col("run.lines"))).alias("unit")).select("conv_id", "turn", "k", "level", F.length("unit").alias("n"), *key)
    concerned = quoted.select("conv_id").distinct().select("conv_id", _copies())
    said = parsed(rows.withColumn("_salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS))).join(concerned, ["conv_id", "_salt"], "left_semi"))
    # a message says its lines, its runs between quotations, its paragraphs, and all it says as one
    parts = F.concat(
        F.array(F.col("own")),
        F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["lines"]),
        F.transform(F.split(F.array_join("own", "\n"), r"\n[ \t]*\n"), lambda p: F.split(p, "\n")),
    )
    said = said.select("conv_id", "turn", F.explode(F.array_distinct(F.flatten(F.transform(parts, _units)))).alias("unit"))
    origin = said.select("conv_id", "turn", *key).groupBy("conv_id", "h", "g").agg(F.min("turn").alias("origin"))
    found = quoted.join(origin, ["conv_id", "h", "g"]).where("origin < turn")
    votes = found.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("n").alias("weight"), F.collect_set("k").alias("ks"))
    best = F.max(F.struct(-F.col("level"), F.col("weight"), F.col("origin"))).alias("best")
    return votes.groupBy("conv_id", "turn").agg(best, F.size(F.array_distinct(F.flatten(F.collect_list("ks")))).cast("long").alias("n_linked")).select("conv_id", "turn", F.col("best.origin").alias("reply_to"), "n_linked")


def threads(replies: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, thread, depth): the first message that a chain of replies leads to, and the chain's length. Jumps double each round."""
    now = scratch.save(replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "jump-0")
    k = 0
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_to"), F.col("depth").alias("_more"), _copies())
        dealt = now.withColumn("_salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)))
        if dealt.join(up, ["conv_id", "thread", "_salt"], "left_semi").isEmpty():
            return now
        k += 1
        joined = dealt.join(up, ["conv_id", "thread", "_salt"], "left")
        now = scratch.save(joined.select("conv_id", "turn", F.coalesce("_to", "thread").alias("thread"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")), f"jump-{k}")
        scratch.drop(f"jump-{k - 1}")


def reply_threads(messages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Every message with reply_to (turn answered, or null), thread (turn that began the thread), depth, n_quotes, n_linked and body.

    The body is the text without quotations, of any length; without any quotation it is the text, a null one empty. Rows with a null conversation or turn answer nothing; rows that
    repeat both are one message for those that quote it, and each is returned. Of originals with equal votes the latest is answered. Without messages there are no rows; other
    columns, whatever their names, stay out. Reply order is (conv_id, thread, turn): see ``reply_ordered``.
    """
    scratch = scratch or Scratch(messages.sparkSession)
    replies = scratch.save(linked(messages), "replies")
    chain = scratch.save(replies.join(threads(replies, scratch), ["conv_id", "turn"]), "chain")
    scratch.drop("replies", *[f"jump-{k}" for k in range(64)])
    # messages that can't hold a quotation aren't parsed: their arrays are null
    rows = parsed(messages.select("conv_id", "turn", "role", F.col("text").alias("_all"), F.when(_may_quote(), F.col("text")).alias("text")))
    rows = rows.withColumn("n_quotes", F.coalesce(F.size(F.filter("runs", lambda r: r["level"] > 0)), F.lit(0)).cast("long"))
    body = F.when(F.col("n_quotes") == 0, F.coalesce("_all", F.lit(""))).otherwise(F.regexp_replace(F.array_join("own", "\n"), r"^\s+|\s+$", ""))
    rows = rows.select("conv_id", "turn", "role", "n_quotes", body.alias("body"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    out = rows.where(whole).join(chain, ["conv_id", "turn"], "left").unionByName(rows.where(~whole), allowMissingColumns=True)
    return out.select("conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "body")


def reply_ordered(threaded: DataFrame) -> DataFrame:
    """The messages in reply order, conversation after conversation, dealt by ranges so that a long conversation spreads over tasks."""
    return threaded.repartitionByRange("conv_id", "thread", "turn").sortWithinPartitions("conv_id", "thread", "turn")


def quoting(messages: DataFrame) -> DataFrame:
    """Messages made to quote: of three turns one quotes the turn before, one the two turns before at two levels, one nothing. For tables without quotations."""
    said = [messages.select("conv_id", (F.col("turn") + k).alias("turn"), F.replace("text", F.lit("\n"), F.lit("\n" + "> " * k)).alias(f"_{k}")).groupBy("conv_id", "turn").agg(F.min(f"_{k}").alias(f"_{k}")) for k in (1, 2)]
    own = messages.join(said[0], ["conv_id", "turn"], "left").join(said[1], ["conv_id", "turn"], "left")
    one = F.concat(F.lit("They wrote:\n> "), "_1", F.lit("\n\n"), "text")
    two = F.concat(F.lit("> > "), "_2", F.lit("\n> "), "_1", F.lit("\n"), "text")
    text = F.coalesce(F.when(F.col("turn") % 3 == 1, one).when(F.col("turn") % 3 == 2, two), F.col("text"))
    return own.select("conv_id", "turn", "role", text.alias("text"))
