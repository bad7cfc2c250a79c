"""Near-duplicate embeddings by iterative quantisation (Gong and Lazebnik, 2011) and multi-index Hamming tables.

A rotation of the principal axes is learned so that the signs of the rotated vectors are balanced binary codes close to the vectors. Each
code of m substrings is cut into m Hamming tables: codes that differ in fewer than m bits agree on a whole substring (the radius within which a rotation
finds all), and vectors that agree on one are candidates. Every candidate pair is decided by the cosine of the original vectors in double precision.

Rotations, each learned from another start, are added, as many as it takes, until pairs that lie exactly at the threshold (sample vectors moved by that
angle) meet in some table with probability ``RECALL``. (A table of another rotation finds more for its cost than probing the neighbours of a substring does: reckoned for independent bits, at 26 bits and a
cosine of 0.95, 27 probes of one table find 0.25 of such pairs, 27 tables 0.83.) The length of a substring is chosen among those that leave a table's buckets
at about ``LOADS`` vectors: the one whose tables cost least.

A bucket's pairs are not emitted: each bucket leaves, for each vector, the number of its links that no earlier table has, and
links enough to connect what is linked. Buckets above ``BUCKET`` vectors are compared in pairs of blocks: a vector's number of links is exact, so every
pair of different vectors of a cluster is decided.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import graph
from quire.llm.shared import Scratch

#: Vectors that the rotations are fitted on at most, in expectation.
FIT_ROWS = 20_000
LOADS, BUCKET, RECALL, STEPS = (16, 64, 256), 4096, 0.97, 30
#: Vectors of a bucket whose comparison costs as much as one entry of a table.
_EVEN = 128
_BITS, _ROWS = 62, 512


@dataclass
class Codes:
    """``rotations`` map centred unit vectors to code bits; ``width`` bits make a substring."""

    mean: np.ndarray
    rotations: list[np.ndarray]
    width: int

    @property
    def tables(self) -> int:
        return sum(r.shape[1] // self.width for r in self.rotations)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """The substring of each vector in each table."""
        out = []
        for rotation in self.rotations:
            bits = (unit - self.mean) @ rotation > 0
            for a in range(0, bits.shape[1] - self.width + 1, self.width):
                out.append(bits[:, a : a + self.width] @ (1 << np.arange(self.width, dtype=np.int64)))
        return np.stack(out, axis=1) if out else np.zeros((len(unit), 0), np.int64)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # neither overflow nor underflow below
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _rotation(centred: np.ndarray, axes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Alternates between the codes that are nearest to the rotated vectors and the rotation that is best for the codes."""
    own = centred @ axes
    turn = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))[0]
    for _ in range(STEPS):
        left, _, right = np.linalg.svd(np.where(own @ turn > 0, 1.0, -1.0).T @ own)
        turn = (left @ right).T
    return axes @ turn


def fit(sample: np.ndarray, vectors: int, cosine: float) -> Codes:
    """From sample vectors, for a table of ``vectors`` vectors."""
    rng = np.random.default_rng(41)
    unit = unit_rows(sample)
    # recall is measured on vectors that nothing is learned from
    order = rng.permutation(len(unit))
    held = min(4000, len(unit) // 5) if len(unit) >= 100 else 0
    some, unit = (unit[order[:held]], unit[order[held:]]) if held else (unit, unit)
    mean = unit.mean(axis=0) if len(unit) > 100 else np.zeros(unit.shape[1])
    _, axes = np.linalg.eigh((unit - mean).T @ (unit - mean))
    axes = axes[:, ::-1][:, :_BITS]
    aside = rng.standard_normal(some.shape)
    aside -= (aside * some).sum(axis=1, keepdims=True) * some
    moved = cosine * some + np.sqrt(1 - cosine**2) * unit_rows(aside) if some.shape[1] > 1 else some
    rotations: list[np.ndarray] = []
    best = None
    for load in sorted(LOADS, reverse=True):  # shorter substrings need fewer rotations
        codes = Codes(mean, [], min(axes.shape[1], max(6, int(np.ceil(np.log2(max(2, vectors / load)))))))
        met = np.zeros(len(some), bool)
        while met.mean() < RECALL or not codes.rotations:
            if best and codes.tables * (1 + load / _EVEN) >= best[0]:
                break
            k = len(codes.rotations)
            if k == len(rotations):
                rotations.append(_rotation(unit - mean, axes, rng))
            codes.rotations.append(rotations[k])
            met |= (Codes(mean, [rotations[k]], codes.width).keys(some) == Codes(mean, [rotations[k]], codes.width).keys(moved)).any(axis=1)
        else:
            best = codes.tables * (1 + load / _EVEN), codes
    return best[1]


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what a symmetric link matrix connects."""
    out, wait = [], np.ones(len(links), bool)
    for start in range(len(links)):
        if not wait[start]:
            continue
        wait[start] = False
        queue = [start]
        while queue:
            a = queue.pop()
            near = np.flatnonzero(links[a] & wait)
            wait[near] = False
            out += [(a, int(b)) for b in near]
            queue += near.tolist()
    return out


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column, of any lengths."""
    ends = column.value_lengths().to_numpy(zero_copy_only=False).cumsum()
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def bucket_links(unit: np.ndarray, keys: np.ndarray, copies: np.ndarray, table: int, cosine: float, half: np.ndarray | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each vector of a bucket the copies it is linked to here and in no earlier table, and links that connect. By rows, so that no matrix of doubles or of earlier keys is whole."""
    n = len(unit)
    close, new = np.zeros((n, n), bool), np.zeros(n, np.int64)
    for a in range(0, n, _ROWS):
        own = slice(a, min(n, a + _ROWS))
        near = unit[own] @ unit.T >= cosine
        near[np.arange(near.shape[0]), np.arange(own.start, own.stop)] = False
        if half is not None:
            near &= half[own, None] != half[None, :]
        close[own] = near
        for t in range(table if near.any() else 0):
            near &= keys[own, t, None] != keys[None, :, t]
        new[own] = near @ copies
    return new, _forest(close)


def similar_vectors(vectors: DataFrame, cosine: float = 0.95, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows with a null id, which have no component and are
    kept. Vectors link with those of their own dimension only: each dimension has an index of its own. Rows that repeat an id are vectors of their own in n_links
    and one in components; rows that repeat a vector are linked with each other. A cosine equal to the threshold, as computed in doubles, is a link. Without rows there are
    none; other columns, whatever their names, stay out.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = scratch.save(rows.withColumn("sound", F.coalesce(sound, F.lit(False))).select("vec_id", F.when(F.col("sound"), F.xxhash64("v")).alias("p"), F.when(F.col("sound"), F.xxhash64(F.lit(1), "v")).alias("q"), F.when(F.col("sound"), F.col("v")).alias("v")), "rows")
    usable = rows.where("p is not null").withColumn("d", F.size("v"))
    # two hashes of different seeds tell classes apart in joins
    classes = scratch.save(usable.groupBy("d", "p", "q", "v").agg(F.min("vec_id").alias("c"), F.count("*").alias("copies")).select("d", "p", "q", "c", "copies", "v"), "classes")
    totals = {r["d"]: r["count"] for r in classes.groupBy("d").count().collect()}
    if not totals:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    fitted = {}
    for size, total in sorted((d, n) for d, n in totals.items() if n > 1):
        own = classes.where(F.col("d") == size)
        share = F.pmod(F.col("p"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, FIT_ROWS / total))
        sampled = own.where(share).select("p", "v").toArrow().combine_chunks()
        if not len(sampled):
            sampled = own.select("p", "v").limit(1).toArrow().combine_chunks()
        sampled = sampled.sort_by("p").combine_chunks()
        fitted[size] = fit(_vectors(sampled["v"].chunk(0), size), total, cosine)
    shared = spark.sparkContext.broadcast(fitted)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(5).to_numpy()
            for size in map(int, np.unique(sizes)):
                if size not in shared.value:  # a sole vector of its dimension
                    continue
                some = batch.filter(pa.array(sizes == size))
                keys = shared.value[size].keys(unit_rows(_vectors(some.column(3), size)))
                yield pa.RecordBatch.from_arrays([*some.columns[:3], some.column(4), some.column(5), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["p", "q", "c", "copies", "d", "keys"])

    keyed = scratch.save(classes.select("p", "q", "c", "v", "copies", "d").mapInArrow(coded, "p long, q long, c long, copies long, d int, keys array<long>"), "keyed")
    spots = keyed.select("p", "q", "d", F.posexplode("keys").alias("t", "key"))
    full = spots.groupBy("d", "t", "key").agg(F.count("*").alias("n")).where("n > 1")
    counted = scratch.save(full, "buckets")
    blocks = F.ceil(F.col("n") * 2 / BUCKET)
    dealt = spots.join(counted.where(F.col("n") <= BUCKET).select("d", "t", "key"), ["d", "t", "key"]).select("d", "t", "key", F.lit(0).cast("long").alias("block"), F.lit(-1).alias("side"), "p", "q")
    if not counted.where(F.col("n") > BUCKET).isEmpty():
        large = spots.join(counted.where(F.col("n") > BUCKET).select("d", "t", "key", blocks.alias("m")), ["d", "t", "key"])
        large = large.withColumn("i", F.pmod(F.xxhash64("p"), F.col("m"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
        lo, hi = F.least("i", "j"), F.greatest("i", "j")
        dealt = dealt.union(large.select("d", "t", "key", (1 + lo * F.col("m") + hi).alias("block"), F.when(lo == hi, -1).when(F.col("i") == lo, 0).otherwise(1).alias("side"), "p", "q"))

    def linked(rows: list[tuple]) -> pa.RecordBatch:
        table, half = rows[0][1], np.array([r[4] for r in rows])
        ids, copies = [r[5] for r in rows], np.array([r[6] for r in rows])
        n, pairs = bucket_links(unit_rows(np.stack([r[8] for r in rows])), np.stack([r[7] for r in rows]), copies, table, cosine, None if half[0] < 0 else half)
        some = np.flatnonzero(n)
        a = [ids[i] for i in some] + [ids[i] for i, _ in pairs]
        b = [None] * len(some) + [ids[j] for _, j in pairs]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*n[some].tolist(), *[0] * len(pairs)], pa.int64()), pa.array([rows[i][9] for i in some] + [None] * len(pairs), pa.int64())], names=["a", "b", "n", "p"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            if not len(batch):
                continue
            keys, vectors = _lists(batch.column(7)), _lists(batch.column(8))
            for k, row in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5, 6, 9)), strict=True)):
                if row[:4] != at:
                    if len(held) > 1:
                        yield linked(held)
                    at, held = row[:4], []
                held.append((*row[:7], keys[k], vectors[k], row[7]))
        if len(held) > 1:
            yield linked(held)

    gathered = dealt.join(keyed.drop("d"), ["p", "q"]).join(classes.select("p", "q", "v"), ["p", "q"]).select("d", "t", "key", "block", "side", "c", "copies", "keys", "v", "p")
    found = scratch.save(gathered.repartition("d", "t", "key", "block").sortWithinPartitions("d", "t", "key", "block").mapInArrow(compare, "a long, b long, n long, p long"), "found")
    several = usable.groupBy("vec_id").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo != hi").select("vec_id")
    same = usable.join(several, "vec_id", "left_semi").join(classes.select("p", "q", "c"), ["p", "q"]).select(F.col("vec_id").alias("a"), F.col("c").alias("b"))
    known = scratch.save(graph.components(found.where("b is not null").select("a", "b").union(same), scratch, "stars"), "known")
    scratch.drop("keyed", "buckets")
    sums = found.where("b is null").groupBy(F.col("a").alias("c"), "p").agg(F.sum("n").alias("n"))
    labelled = classes.select("p", "q", "c", "copies").join(known.withColumnRenamed("node", "c"), "c", "left").join(sums, ["c", "p"], "left")
    labelled = scratch.save(labelled.select("p", "q", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "c").alias("component_id"), "copies"), "labelled")
    scratch.drop("found", "classes", "known")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    out = graph.labelled_rows(rows.drop("v"), labelled, ["p", "q"])
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
