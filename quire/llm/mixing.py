"""Mixing sources to target weights.

Every source's words are packed, document after document, into blocks of ``BLOCK`` words. Output shards draw how many of their slots
each source fills from a multinomial distribution; running totals over the shards number a source's slots, and a pseudorandom
permutation of the source's block numbers (a keyed Feistel network, a new one for every pass over the source) maps slots to blocks.
Blocks and slots are joined by source and block number, which are spread evenly whatever the source's size.

A source's slots are as many as its target needs: its last slot is cut to the word. Draws beyond that are void, and what the draws leave
missing fills shards of its own at the end, so a source yields its target rounded to whole words, and no word more than three times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import textbytes as tb
from quire.llm.shared import Scratch

BLOCK, SHARD, SEED = 128, 4096, 20240501
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents of a packing bucket, in expectation; rows that one task numbers in a running total; shards that one task draws or maps.
_BUCKET, _RUN, _SHARDS = 500, 1_000, 8
_WORD = r"[^\x20\x09-\x0D]+"


class Permutation:
    """A pseudorandom permutation of 0..n-1 and its inverse: four Feistel rounds, walked until the value is in range."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, -(-(n - 1).bit_length() // 2)))
        self.keys = tb.mixed(np.arange(1, 5, dtype=np.uint64) + np.uint64(key % 2**64))

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        out, wait = np.asarray(x, np.uint64).copy(), np.arange(len(x))
        low = (np.uint64(1) << self.half) - np.uint64(1)
        while len(wait):
            left, right = out[wait] >> self.half, out[wait] & low
            for k in keys:
                if back:
                    left, right = right ^ (tb.mixed(left + k) & low), left
                else:
                    left, right = right, left ^ (tb.mixed(right + k) & low)
            out[wait] = (left << self.half) | right
            wait = wait[out[wait] >= self.n]
        return out.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys, False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys[::-1], True)


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Target words of each source, the sources being in order: shares by weight, none above ``most`` times its size, the excess reshared by weight among the others."""
    own = [weights[i % len(weights)] for i in range(len(sizes))]
    capped: set[int] = set()
    while True:
        free = sum(w for i, w in enumerate(own) if i not in capped)
        level = (sum(sizes) - sum(most * sizes[i] for i in capped)) / free if free else 0.0
        above = {i for i, w in enumerate(own) if i not in capped and level * w > most * sizes[i]}
        if not above:
            return [float(most * s) if i in capped else level * w for i, (s, w) in enumerate(zip(sizes, own, strict=True))]
        capped |= above


@dataclass
class Plan:
    """One source: its words, target, blocks and slots; ``cut`` words of the last slot's block are left out."""

    number: int
    size: int
    target: float

    def __post_init__(self):
        self.blocks = -(-self.size // BLOCK)
        wanted = min(round(self.target), MOST * self.size)
        self.passes, rest = divmod(wanted, self.size) if self.size else (0, 0)
        n, held = 0, 0
        if rest:
            last = int(self.permutation(self.passes).inverse(np.array([self.blocks - 1]))[0])
            short = self.blocks * BLOCK - self.size
            n = -(-rest // BLOCK)
            held = n * BLOCK - short * (last < n)
            if held < rest:
                n += 1
                held = n * BLOCK - short * (last < n)
        self.cut = held - rest
        self.slots = self.passes * self.blocks + n

    def permutation(self, turn: int) -> Permutation:
        return Permutation(self.blocks, SEED * 1_000_003 + self.number * 1009 + turn)

    def block(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block number of each slot, and the words that the slot takes from the block's start."""
        block = np.zeros(len(slots), np.int64)
        for turn in np.unique(slots // self.blocks):
            own = slots // self.blocks == turn
            block[own] = self.permutation(int(turn))(slots[own] % self.blocks)
        takes = np.where(block == self.blocks - 1, self.size - (self.blocks - 1) * BLOCK, BLOCK)
        return block, takes - np.where(slots == self.slots - 1, self.cut, 0)


def _running(frame: DataFrame, at: str, value: str, name: str) -> DataFrame:
    """``frame`` with ``name``: the sum of ``value`` over the rows of its source_key before it, in order of ``at`` (distinct numbers from 0).

    Runs of ``_RUN`` numbers are summed first and only these sums are ordered in one task a source, so a large source is numbered by many tasks.
    """
    runs = frame.withColumn("_run", F.floor(F.col(at) / _RUN))
    sums = runs.groupBy("source_key", "_run").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("source_key").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_key", "_run", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("source_key", "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    out = runs.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(offsets, ["source_key", "_run"])
    return out.withColumn(name, F.col("_offset") + F.col("_inner")).drop("_run", "_inner", "_offset")


def packed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source_key, size, start) of every row, start being its first word's number within its source; and (source_key, total).

    Order within a source is by a hash of id and text, in buckets, so that a large source is numbered by many tasks.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("source")))
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    sizes = scratch.save(docs.select("doc_id", key.alias("source_key"), size.alias("size"), F.xxhash64("doc_id", "text").alias("h")), "sizes")
    buckets = max(1, -(-sizes.count() // _BUCKET))
    sizes = sizes.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    offsets = _running(sizes.groupBy("source_key", "bucket").agg(F.sum("size").alias("words")), "bucket", "words", "offset").drop("words")
    inner = Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offsets, ["source_key", "bucket"])
    starts = scratch.save(starts.select("doc_id", "source_key", "size", (F.col("offset") + F.col("inner")).alias("start")), "starts")
    scratch.drop("sizes")
    return starts, starts.groupBy("source_key").agg(F.sum("size").alias("total"))


def planned(totals: DataFrame) -> dict[str, Plan]:
    """The plan of each source. Sources stand in code point order, null last; one row a source comes to the driver."""
    rows = sorted((r["source_key"] == "n", r["source_key"].encode(), r["source_key"], r["total"]) for r in totals.collect())
    goal = targets([r[3] for r in rows])
    return {r[2]: Plan(i, r[3], t) for i, (r, t) in enumerate(zip(rows, goal, strict=True))}


def slots(spark, plans: dict[str, Plan]) -> DataFrame:
    """(shard, source_key, slot, block, takes) of every slot of the mixture."""
    own = {k: p for k, p in plans.items() if p.slots}
    keys, need = list(own), np.array([p.slots for p in own.values()], np.int64)
    total = int(need.sum())
    shards = -(-total // SHARD)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = np.random.default_rng([SEED, shard]).multinomial(min(SHARD, total - shard * SHARD), need / total)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int64)), pa.array([keys[i] for i in at], pa.string()), pa.array(n[at].astype(np.int64))], names=["shard", "source_key", "n"])

    tasks = max(1, min(4096, -(-shards // _SHARDS)))
    drawn = spark.range(0, shards, 1, tasks).mapInArrow(draw, "shard long, source_key string, n long")
    missing, at = [], shards * SHARD
    for r in drawn.groupBy("source_key").agg(F.sum("n").alias("n")).collect() if total else []:
        need[keys.index(r["source_key"])] -= r["n"]
    for k, short in zip(keys, need.tolist(), strict=True):
        while short > 0:
            n = min(short, SHARD - at % SHARD)
            missing.append((at // SHARD, k, n))
            at, short = at + n, short - n
    drawn = drawn.union(spark.createDataFrame(missing, "shard long, source_key string, n long"))
    ranges = _running(drawn.groupBy("source_key", "shard").agg(F.sum("n").alias("n")), "shard", "n", "first")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, key, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                plan = own[key]
                slot = np.arange(first, min(first + n, plan.slots))
                if len(slot):
                    block, takes = plan.block(slot)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), shard, np.int64)), pa.array([key] * len(slot), pa.string()), *map(pa.array, (slot, block, takes))], names=["shard", "source_key", "slot", "block", "takes"])

    # few rows become many: they are dealt by number, which no size estimate merges again
    dealt = ranges.select("shard", "source_key", "n", "first").repartition(tasks, "shard", "source_key")
    return dealt.mapInArrow(mapped, "shard long, source_key string, slot long, block long, takes long")


def mixture(starts: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """The mixture's pieces: (shard, source_key, slot, doc_id, start, doc_word, words): ``words`` words of a document from its word ``doc_word`` on."""
    last = F.col("start") + F.col("size")
    pieces = starts.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((last - 1) / BLOCK))))
    low = F.greatest("start", F.col("block") * BLOCK)
    high = F.least(last, (F.col("block") + 1) * BLOCK)
    pieces = pieces.select("source_key", "block", "doc_id", "start", (low - F.col("start")).alias("doc_word"), (low - F.col("block") * BLOCK).alias("a"), (high - F.col("block") * BLOCK).alias("b"))
    words = F.least("b", "takes") - F.col("a")
    # both sides grow with the corpus; their size estimates are too low after generated rows, so the strategy is named
    return pieces.hint("merge").join(slots(starts.sparkSession, plans), ["source_key", "block"]).withColumn("words", words).where("words > 0").select("shard", "source_key", "slot", "doc_id", "start", "doc_word", "words")


def mixed_documents(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row. A null or blank text has size 0 and nothing taken; a null source is a source.

    Texts of any length are packed over as many blocks as they need. Rows that repeat (or share an id) are documents of their own, each at its own place; which of
    two equal rows stands first changes nothing. Sources stand in code point order, so weights never tie. An empty table gives no rows; columns of other names are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    starts, totals = packed(docs, scratch)
    plans = planned(totals)
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, p.size, float(p.target)) for k, p in plans.items()], "source_key string, source_size long, target double")
    taken = mixture(starts, plans).groupBy("source_key", "start").agg(F.sum("words").alias("taken"))
    held = starts.where("size > 0").join(taken, ["source_key", "start"], "left").unionByName(starts.where("size = 0"), allowMissingColumns=True)
    return held.join(table, "source_key").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
