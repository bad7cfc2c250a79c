"""Near-duplicate documents by a chosen-path set similarity join (after Christiani, Pagh and Sivertsen, 2018).

A document's set is its distinct shingles. Documents of equal words (by SHA-256) are one class from the start. In each of ``TREES``
independent trees every class branches, at every node, to ``BRANCHES`` children: the tokens chosen are its minwise ones under hash functions
that belong to the node (of the functions of its tree and level). Two sets of similarity j agree on a choice with probability j, so for two branches and
j well above a half the chance to share a node of any depth stays near that of the first level (0.97 a tree at 0.85). Nodes that are cheap to compare are
compared exhaustively; others branch on, ``DEPTH`` levels at most.

A comparison walks a node's classes breadth-first: only classes not yet reached are compared, on their full sets of shingles (words are told by their
bytes, no hash decides), so a node of n copies takes about n comparisons and leaves fewer than n links, and its connected parts are found exactly.

Large groups of near copies are not branched on: first the costly nodes of one tree are compared with a few pivots each, block by
block, which joins such a group in linear time. Later, nodes that lie inside one component need nothing; of a node whose classes outside its largest component fit into
one block, only these are compared with all blocks; what remains costly at the last level is compared in pairs of blocks, without
those inside the largest component. Nodes with the same members are compared once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import graph
from quire.llm import textbytes as tb
from quire.llm.shared import Scratch

TREES, BRANCHES, FIRST, DEPTH, POOL = 3, 2, 2, 5, 4
#: Shingles that a node, or each half of a pair of blocks, may hold to be compared in one task, and classes times shingles.
NODE_SHINGLES, NODE_WORK = 1 << 20, 1 << 30
#: Pivots of a costly node.
PIVOTS = 8
#: Minwise hashes kept of a set: for each tree the roots' and, for each level below, those that its nodes choose from.
_PER_TREE = BRANCHES + POOL * (DEPTH - 1)
SIGNATURE = TREES * _PER_TREE
_MULTIPLIERS = np.random.default_rng(77).integers(1, 2**32, SIGNATURE, dtype=np.uint32) | np.uint32(1)
_ADDENDS = np.random.default_rng(78).integers(0, 2**32, SIGNATURE, dtype=np.uint32)
#: Bytes of a text that are split into words at once.
_PIECE = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece: runs without ASCII white space, A-Z lower-cased."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def numbering() -> defaultdict[bytes, int]:
    """Numbers words from 1 on as they are looked up."""
    return defaultdict(count(1).__next__)


def word_numbers(text: bytes, seen: defaultdict[bytes, int], digest=None) -> np.ndarray:
    """The words as numbers; ``digest``, if given, takes them in."""
    found = [np.zeros(0, np.int64)]
    for words in pieces(text):
        if digest and words:
            digest.update(b" ".join(words) + b" ")
        found.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
    return np.concatenate(found) if len(found) > 2 else found[-1]


def shingled(texts: list[np.ndarray], size: int, words: int) -> list[np.ndarray]:
    """The distinct shingles of each text (numbers of words up to ``words``) as sorted numbers that are equal for equal shingles of all texts. A shorter text is one shingle, filled up with zeros."""
    width = max(1, words.bit_length())
    padded = [np.r_[t, np.zeros(size - len(t), np.int64)] if 0 < len(t) < size else t for t in texts]
    counts = [max(0, len(t) - size + 1) for t in padded]
    if width * size <= 63:
        out = []
        for t, n in zip(padded, counts, strict=True):
            own = np.zeros(n, np.int64)
            for k in range(size):
                own = own << width | t[k : n + k]
            out.append(np.unique(own))
        return out
    number = np.concatenate([t[:n] for t, n in zip(padded, counts, strict=True)]) if texts else np.zeros(0, np.int64)
    for k in range(1, size):
        more = np.concatenate([t[k : n + k] for t, n in zip(padded, counts, strict=True)])
        # renumbered at each step, so that a pair of numbers fits
        number = np.unique(number * (words + 1) + more, return_inverse=True)[1]
    return [np.unique(own) for own in np.split(number, np.cumsum(counts)[:-1])] if texts else []


def _signature(own: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set of hashes, as 31 bits."""
    high, least = (own >> np.uint64(32)).astype(np.uint32), np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(high), 1 << 10):
        values = np.multiply.outer(_MULTIPLIERS, high[a : a + (1 << 10)])
        values ^= _ADDENDS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint32(1)).astype(np.int32)


class _Hashes:
    """Hashes of numbered words, kept as the numbering grows."""

    def __init__(self):
        self.held, self.n = np.zeros(1 << 12, np.uint64), 0

    def of(self, number: np.ndarray, seen: dict[bytes, int]) -> np.ndarray:
        if len(seen) > len(self.held):
            self.held = np.r_[self.held, np.zeros(len(seen), np.uint64)]
        new = len(seen) - self.n
        for k, w in enumerate(islice(reversed(seen), new)):
            self.held[len(seen) - 1 - k] = xxhash.xxh3_64_intdigest(w)
        self.n = len(seen)
        return self.held[number - 1]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, p, signature) of every row: p is the SHA-256 of its words; p and signature are null without words."""
    odd = np.uint64(0xC2B2AE3D27D4EB4F)

    def sketch(text: bytes, seen: defaultdict[bytes, int], hashes: _Hashes) -> tuple:
        digest = sha256()
        number = word_numbers(text, seen, digest)
        if not len(number):
            return 0, None, None
        own = hashes.of(number, seen)
        n = min(size, len(own))
        rolled = np.full(len(own) - n + 1, n, np.uint64)
        for k in range(n):
            rolled = rolled * odd + own[k : len(own) - n + 1 + k]
        return len(shingled([number], size, len(seen))[0]), digest.digest(), _signature(tb.mixed(rolled))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, hashes = numbering(), _Hashes()
            rows = [sketch(t or b"", seen, hashes) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "p", "signature"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, n_shingles long, p binary, signature array<int>")


def connecting_links(sets: list[np.ndarray], known: np.ndarray, similar: tuple[int, int], half: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that are similar and connect whatever similarity connects. ``known``: component of each set so far, as a number; ``half``: only sets of different halves are compared."""
    up, down = similar
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(number.max() + 1, bool)
    rest, links = np.arange(len(sets)), []
    while len(rest):
        own = known[rest] == known[rest[0]]
        queue, rest = list(rest[own]), rest[~own]
        while queue and len(rest):
            a = queue.pop()
            fit = (sizes[rest] * down >= up * sizes[a]) & (sizes[a] * down >= up * sizes[rest])
            if half is not None:
                fit &= half[rest] != half[a]
            who = rest[fit]
            if not len(who):
                continue
            mine = number[begins[a] : ends[a]]
            mark[mine] = True
            heads = np.cumsum(sizes[who]) - sizes[who]
            at = np.arange(sizes[who].sum()) + np.repeat(begins[who] - heads, sizes[who])
            both = np.add.reduceat(mark[number[at]], heads, dtype=np.int64)
            mark[mine] = False
            near = who[down * both >= up * (sizes[who] + sizes[a] - both)]
            if len(near):
                links += [(a, b) for b in near]
                reached = np.isin(known[rest], known[near])
                queue += list(rest[reached])
                rest = rest[~reached]
    return links


def _branched(nodes: DataFrame, level: int) -> DataFrame:
    """Each node's classes in its children; ``nodes`` has tree, path and signature."""
    chosen = [F.lit(j) for j in range(BRANCHES)]
    if level:  # different functions of the level's, chosen by the node
        first = F.pmod(F.xxhash64("path", F.lit(level)), F.lit(POOL))
        chosen = [BRANCHES + POOL * (level - 1) + F.pmod(first + j, F.lit(POOL)) for j in range(BRANCHES)]
    values = F.array(*[F.element_at("signature", (F.col("tree") * _PER_TREE + at + 1).cast("int")) for at in chosen])
    out = nodes.select("*", F.posexplode(values).alias("_j", "_value"))
    return out.withColumn("path", F.xxhash64("path", "_j", F.lit(level), "_value")).drop("_j", "_value")


def _members(classes: DataFrame) -> DataFrame:
    """(tree, path, c, n_shingles) at the first level that is compared."""
    trees = F.explode(F.array(*[F.lit(t).cast("long") for t in range(TREES)])).alias("tree")
    nodes = classes.select("c", "n_shingles", "signature", trees).withColumn("path", F.col("tree"))
    for level in range(FIRST):
        nodes = _branched(nodes, level)
    return nodes.drop("signature")


def _weighed(nodes: DataFrame) -> DataFrame:
    """Every path that holds classes of different components: its classes, its shingles, two fingerprints of its members, and the component that holds most of its shingles, with these."""
    parts = nodes.groupBy("path", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"))
    found = parts.groupBy("path").agg(F.sum("n").alias("n"), F.sum("w").alias("weight"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("w", "component")).alias("_m"), F.count("*").alias("parts"))
    return found.where("parts > 1").select("path", "n", "weight", "x", "y", F.col("_m.w").alias("most"), F.col("_m.component").alias("major"))


def _once(paths: DataFrame) -> DataFrame:
    """One path of those that have the same members."""
    return paths.groupBy("n", "weight", "x", "y").agg(F.min(F.struct("path", "most", "major")).alias("p")).select("n", "weight", "p.*")


_SIDES = ["path", "block", "side", "c", "component"]


def _wholes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    return nodes.join(paths.select("path"), "path").select("path", F.lit(0).cast("long").alias("block"), F.lit(-1).alias("side"), "c", "component")


def _blocks(weight: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(weight * 2 / NODE_SHINGLES)).cast("long")


def _pivoted(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Comparisons of each path's classes, in blocks, with its pivots: those of the least hashes."""
    dealt = nodes.join(paths.select("path", F.least(_blocks(F.col("weight")), "n").alias("m")), "path")
    least = [F.min(F.struct(F.xxhash64("c", F.lit(k)).alias("h"), "c", "component")).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = dealt.groupBy("path").agg(F.any_value("m").alias("m"), *least)
    pivots = pivots.select("path", "m", F.explode(F.array_distinct(F.array(*[F.struct(f"p{k}.c", f"p{k}.component") for k in range(PIVOTS)]))).alias("p"))
    pivots = pivots.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("block"), F.lit(1).alias("side"), "p.c", "p.component")
    return dealt.select("path", F.pmod(F.xxhash64("c", F.lit("block")), F.col("m")).alias("block"), F.lit(0).alias("side"), "c", "component").union(pivots)


def _paired(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Comparisons of each path's classes in pairs of blocks, a block with itself included, but none between blocks of its largest component."""
    rest = F.col("weight") - F.col("most")
    sizes = paths.select("path", "major", F.least(_blocks(F.col("most")), "n").alias("mg"), F.least(_blocks(rest), "n").alias("mr"))
    dealt = nodes.join(sizes, "path").withColumn("_inner", F.col("component") == F.col("major"))
    h = F.xxhash64("c", F.lit("block"))
    # blocks of the largest component are numbered first
    i = F.when(F.col("_inner"), F.pmod(h, F.col("mg"))).otherwise(F.col("mg") + F.pmod(h, F.col("mr")))
    j = F.explode(F.sequence(F.when(F.col("_inner"), F.col("mg")).otherwise(F.lit(0).cast("long")), F.col("mg") + F.col("mr") - 1))
    dealt = dealt.withColumn("i", i).withColumn("j", j)
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    return dealt.select("path", (1 + lo * (F.col("mg") + F.col("mr")) + hi).alias("block"), F.when(lo == hi, -1).when(F.col("i") == lo, 0).otherwise(1).alias("side"), "c", "component")


def _assigned(nodes: DataFrame, classes: DataFrame, scratch: Scratch, name: str, pivot: bool) -> tuple[DataFrame, DataFrame]:
    """The comparisons of some trees (path, block, side, c, component). With ``pivot`` costly nodes are compared with pivots only; their paths come second."""
    out, costly = None, None
    for level in range(FIRST, DEPTH + 1):
        weighed = scratch.save(_weighed(nodes), f"weighed-{name}-{level}")
        fits = (F.col("weight") <= NODE_SHINGLES) & (F.col("n") * F.col("weight") <= NODE_WORK)
        found = _wholes(nodes, _once(weighed.where(fits)))
        out = found if out is None else out.union(found)
        costly = weighed.where(~fits)
        if costly.isEmpty():
            break
        if pivot:
            return out.union(_pivoted(nodes, _once(costly))), costly.select("path")
        lean = F.lit(True) if level == DEPTH else 2 * (F.col("weight") - F.col("most")) <= NODE_SHINGLES
        out = out.union(_paired(nodes, _once(costly.where(lean))))
        if level == DEPTH:
            break
        deep = nodes.join(costly.where(~lean).select("path"), "path", "left_semi").join(classes.select("c", "signature"), "c")
        nodes = scratch.save(_branched(deep, level).drop("signature"), f"nodes-{name}-{level + 1}")
    return out, costly.select("path")


def _compared(members: DataFrame, sets: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """Links (a, b) within each (path, block); rows of side 0 and 1 are two halves, of side -1 one whole."""

    def linked(rows: list[tuple]) -> pa.RecordBatch:
        rows = [*dict.fromkeys(rows)]
        ids = [r[0] for r in rows]
        known = np.unique(np.array([r[1] for r in rows]), return_inverse=True)[1]
        half = np.array([r[2] for r in rows])
        links = []
        if known.max() and (half[0] < 0 or half.min() < half.max()):
            seen = numbering()
            numbers = [word_numbers(r[3], seen) for r in rows]
            links = connecting_links(shingled(numbers, size, len(seen)), known, similar, None if half[0] < 0 else half)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in links], pa.int64()), pa.array([ids[j] for _, j in links], pa.int64())], names=["a", "b"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for path, block, *row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (path, block) != key:
                    if rows:
                        yield linked(rows)
                    key, rows = (path, block), []
                rows.append(tuple(row))
        if rows:
            yield linked(rows)

    joined = members.join(sets, "c").select("path", "block", "c", "component", "side", "text")
    return joined.repartition("path", "block").sortWithinPartitions("path", "block").mapInArrow(apply, "a long, b long")


def similar_documents(docs: DataFrame, size: int = 3, similar: tuple[int, int] = (85, 100), scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: component_id is the smallest doc_id that links reach; a link is a Jaccard similarity of similar[0] / similar[1] or more.

    Rows without words, or with a null text, are linked with nothing; a text of fewer than ``size`` words is one shingle. Rows with a null id are linked with nothing, have
    no component and are kept. Rows that repeat an id are one document: what either links to is linked, and each such row is returned. Every link is confirmed on full
    sets of shingles, of texts of any length; a tie at the threshold is a link. Without documents there are no rows; other columns, whatever their names, stay out.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = scratch.save(sketches(docs, size), "sketches")
    usable = sketched.where("p is not null and doc_id is not null")
    classes = scratch.save(usable.groupBy("p").agg(F.min("doc_id").alias("c"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature"), F.count("*").alias("copies")), "classes")
    several = usable.groupBy("doc_id").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo != hi").select("doc_id")
    links = scratch.save(usable.join(several, "doc_id", "left_semi").join(classes.select("p", "c"), "p").select(F.col("doc_id").alias("a"), F.col("c").alias("b")), "links")
    every = _members(classes)
    shared = every.groupBy("path").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("path")
    nodes = scratch.save(every.join(shared, "path", "left_semi"), "nodes")
    # the same plan at every size: without the hint a short list would be broadcast
    texts = docs.select(F.col("doc_id").alias("c"), F.col("text").cast("binary").alias("text")).where("text is not null")
    sets = scratch.save(texts.join(nodes.select("c").distinct().hint("merge"), "c", "left_semi"), "sets")
    known = None
    for turn in range(2):
        own = nodes.where("tree = 0" if not turn else "tree > 0")
        if turn and not costly.isEmpty():  # what pivots alone have met
            own = own.union(nodes.where("tree = 0").join(costly, "path", "left_semi"))
        own = own.withColumn("component", F.col("c")) if known is None else scratch.save(own.join(known.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c")), "own")
        if turn:
            links = known.select(F.col("node").alias("a"), F.col("component").alias("b"))
        assigned, costly = _assigned(own, classes, scratch, f"{turn}", not turn)
        found = scratch.save(_compared(assigned, sets, size, similar), f"links-{turn}")
        known = scratch.save(graph.components(links.union(found), scratch, f"stars-{turn}"), f"known-{turn}")
        scratch.drop(f"links-{turn}")
    scratch.drop("nodes", "own", "sets", "links", "known-0", *[f"{t}-{k}-{level}" for t in ("weighed", "nodes") for k in range(2) for level in range(FIRST, DEPTH + 1)])
    labelled = classes.join(known.withColumnRenamed("node", "c"), "c", "left").select("p", F.coalesce("component", "c").alias("component_id"), "copies")
    out = graph.labelled_rows(sketched.drop("signature"), scratch.save(labelled, "labelled"), ["p"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
