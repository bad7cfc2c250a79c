"""Benchmark decontamination with suffix arrays of the training text.

A shard is the documents of an Arrow batch. Its text is laid out as word numbers of the benchmark's vocabulary (words are told by their bytes; other
words share a number that no benchmark word has, a separator stands between documents) and its suffixes are sorted: those that begin with two
benchmark words that follow each other somewhere in the benchmark, as no benchmark suffix can share two words with any other one.

Every benchmark suffix of a window's length (and every shorter item whole) is binary-searched in every shard; the range found holds all places
that share its first ``WINDOW`` words. Places that follow each other in a document as their suffixes do in the benchmark are one longest
verbatim match. The matches of a document give its hit words, its items, and its longest match with the place on both sides.
``longest_matches`` also gives, for each benchmark suffix, its longest match over all shards, down to two words.

A benchmark above ``BLOCK_BYTES`` is taken in blocks of whole items, one after the other: each is broadcast alone, its hits are written,
and the blocks' hits are merged by the hash (SHA-256) of the text, on which alone they depend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import textbytes as tb
from quire.llm.shared import Scratch

#: Words of a window; a document is contaminated from this share of words in windows: one in SHARE.
WINDOW, SHARE = 13, 20
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 8 << 20
#: Bytes that are split into words at once.
_CHUNK = 1 << 20
#: A word of a lower-cased text, and of a text as it is.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Vocabulary:
    """Numbers from 2 on of the distinct words of some spans; a hash finds the word, its bytes decide."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        keys, first = np.unique(tb.span_hashes(data, starts, ends), return_index=True) if len(starts) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.index = tb.KeyIndex(keys)
        sizes = (ends - starts)[first]
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        inner = np.arange(sizes.sum()) - np.repeat(self.starts, sizes)
        self.data = data[np.repeat(starts[first], sizes) + inner]
        #: words whose hash another word has
        self.others: dict[bytes, int] = {}
        number = self.numbers(data, starts, ends)
        for i in np.flatnonzero(number == 1):
            self.others.setdefault(data[starts[i] : ends[i]].tobytes(), len(keys) + 2 + len(self.others))

    def __len__(self) -> int:
        return len(self.index.keys) + len(self.others)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word; 1 for a word that isn't held."""
        out = np.ones(len(starts), np.uint32)
        if not len(starts) or not len(self.index.keys):
            return out
        found = self.index.find(tb.span_hashes(data, starts, ends))
        at = np.flatnonzero(found >= 0)
        own = found[at]
        same = tb.equal_spans(data, starts[at], ends[at], self.data, self.starts[own], self.ends[own])
        out[at[same]] = own[same] + 2
        if self.others:
            for i in at[~same]:
                out[i] = self.others.get(data[starts[i] : ends[i]].tobytes(), 1)
        return out


@dataclass
class Benchmark:
    """Whole items: their words as numbers from 2 on, with ``WINDOW`` zeros between items."""

    ids: list
    vocabulary: Vocabulary
    words: np.ndarray
    first: np.ndarray  # position of each item's first word
    sizes: np.ndarray  # words of each item
    width: int  # bits of a word number
    pairs: tb.KeyIndex  # two neighbouring words, or a lone item's only word with 0

    @property
    def depth(self) -> int:
        """Words of a packed key of the suffix array: whole 64-bit integers that hold a window at least."""
        per = 64 // self.width
        return -(-WINDOW // per) * per


def benchmark_block(rows: list[tuple]) -> Benchmark:
    """From (item id, text); items without words are left out."""
    column = pa.array([t or "" for _, t in rows], pa.large_string())
    parts = [(tb.LOWER[data], offsets) for _, _, data, offsets in tb.chunks(column)]
    data = np.concatenate([d for d, _ in parts]) if parts else np.zeros(0, np.uint8)
    offsets = np.r_[0, np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))] if parts else np.zeros(1, np.int64)
    starts, ends, heads = tb.words(data, offsets, tb.ALNUM)
    vocabulary = Vocabulary(data, starts, ends)
    sizes = np.diff(heads)
    held = np.flatnonzero(sizes)
    sizes = sizes[held]
    first = np.cumsum(sizes + WINDOW) - sizes - WINDOW
    words = np.zeros(int((sizes + WINDOW).sum()) + WINDOW, np.uint64)
    words[np.arange(len(starts)) + np.repeat(np.arange(len(held)) * WINDOW, sizes)] = vocabulary.numbers(data, starts, ends)
    pair = words[:-1] << np.uint64(32) | words[1:]
    keep = (words[:-1] > 0) & (words[1:] > 0)
    lone = first[sizes == 1]
    width = max(4, (len(vocabulary) + 2).bit_length())
    return Benchmark([rows[i][0] for i in held], vocabulary, words, first, sizes, width, tb.KeyIndex(np.unique(np.r_[pair[keep], words[lone] << np.uint64(32)])))


def _packed(words: np.ndarray, at: np.ndarray, depth: int, width: int) -> list[np.ndarray]:
    """The words at and after each position as integers that compare like the word sequences."""
    per = 64 // width
    keys = []
    for head in range(0, depth, per):
        key = np.zeros(len(at), np.uint64)
        for k in range(per):
            key = (key << np.uint64(width)) | words[at + head + k]
        keys.append(key)
    return keys


@dataclass
class Shard:
    """Word numbers of some documents, each followed by a zero and all by ``depth`` more, and the sorted suffixes."""

    words: np.ndarray
    heads: np.ndarray  # position of each document's first word, and the end
    counts: np.ndarray  # words of each document
    suffixes: np.ndarray
    keys: list[np.ndarray]  # of the sorted suffixes


def shard(texts: pa.Array, bench: Benchmark) -> Shard:
    """The suffix array of an Arrow batch's texts. They are split into words chunk by chunk and sorted as one."""
    numbers, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in tb.chunks(texts, _CHUNK):
        data = tb.LOWER[data]
        starts, ends, first = tb.words(data, offsets, tb.ALNUM)
        numbers.append(bench.vocabulary.numbers(data, starts, ends))
        counts.append(np.diff(first))
    number, counts = np.concatenate(numbers), np.concatenate(counts)
    words = np.zeros(len(number) + len(counts) + bench.depth + 1, np.uint64)
    words[np.arange(len(number)) + np.repeat(np.arange(len(counts)), counts)] = number
    heads = np.r_[0, np.cumsum(counts + 1)]
    known = np.flatnonzero(words[:-1] > 1)
    pair = words[known] << np.uint64(32) | words[known + 1]
    held = bench.pairs.find(pair) >= 0
    if np.any((bench.pairs.keys & np.uint64(0xFFFFFFFF)) == 0):
        held |= bench.pairs.find(pair & ~np.uint64(0xFFFFFFFF)) >= 0
    at = known[held]
    keys = _packed(words, at, bench.depth, bench.width)
    order = np.lexsort(keys[::-1])
    return Shard(words, heads, counts, at[order], [k[order] for k in keys])


def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of each wanted key sequence among the sorted ones."""
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = np.where(open_, (low + high) // 2, 0)
        less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for k, w in zip(keys, wanted, strict=True):
            own = k[mid]
            less |= equal & (own < w)
            equal &= own == w
        up = open_ & (less | equal if right else less)
        low, high = np.where(up, mid + 1, low), np.where(open_ & ~up, mid, high)


def windows(bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, length and item of each window of the benchmark: of each suffix that is searched."""
    n = np.maximum(1, bench.sizes - WINDOW + 1)
    item = np.repeat(np.arange(len(n)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return bench.first[item] + inner, np.minimum(WINDOW, bench.sizes[item]), item


def occurrences(own: Shard, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """Every place in the shard that shares a window's words with a benchmark suffix: position, and number of the window."""
    none = np.zeros(0, np.int64)
    if not len(own.suffixes) or not len(bench.ids):
        return none, none
    at, length, _ = windows(bench)
    padded = np.r_[bench.words, np.zeros(bench.depth, np.uint64)]
    per = 64 // bench.width
    low_keys, high_keys = [], []
    for j, key in enumerate(_packed(padded, at, bench.depth, bench.width)):
        tail = np.clip((j + 1) * per - length, 0, per) * bench.width  # bits after the window's end
        mask = np.where(tail >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(tail, 63).astype(np.uint64)) - np.uint64(1))
        low_keys.append(key & ~mask)
        high_keys.append(key | mask)
    low, high = _bound(own.keys, low_keys, False), _bound(own.keys, high_keys, True)
    n = np.maximum(0, high - low)
    window = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return own.suffixes[place], window


def matches(own: Shard, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The longest verbatim matches between the shard's documents and the benchmark, each as long as it goes on both sides: place in the shard, position in the benchmark, words, item."""
    place, window = occurrences(own, bench)
    if not len(place):
        return place, place, place, place
    at, length, item = windows(bench)
    start = at[window]
    order = np.lexsort((place, start - place))
    place, start, window = place[order], start[order], window[order]
    head = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(start) != 1)])
    last = np.r_[head[1:], len(place)] - 1
    return place[head], start[head], place[last] - place[head] + length[window[last]], item[window[head]]


def longest(own: Shard, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every suffix of the benchmark that shares two words with the shard: its position, the words of its longest match, and a place of it."""
    none = np.zeros(0, np.int64)
    query = np.flatnonzero(bench.words > 0)
    if not len(own.suffixes) or not len(query):
        return none, none, none
    padded = np.r_[bench.words, np.zeros(bench.depth, np.uint64)]
    at = _bound(own.keys, _packed(padded, query, bench.depth, bench.width), False)
    best, place = np.zeros(len(query), np.int64), np.full(len(query), -1, np.int64)
    for side in (at - 1, at):
        inside = (side >= 0) & (side < len(own.suffixes))
        start = own.suffixes[np.clip(side, 0, len(own.suffixes) - 1)]
        n, wait = np.zeros(len(query), np.int64), np.flatnonzero(inside)
        while len(wait):
            q, p = query[wait] + n[wait], start[wait] + n[wait]
            same = (q < len(padded)) & (p < len(own.words))
            same[same] = (padded[q[same]] > 0) & (padded[q[same]] == own.words[p[same]])
            wait = wait[same]
            n[wait] += 1
        better = n > best
        best, place = np.where(better, n, best), np.where(better, start, place)
    hit = best >= 2
    return query[hit], best[hit], place[hit]


def blocks(benchmark: DataFrame, limit: int | None = None) -> tuple[int, Iterator[Benchmark]]:
    """How many blocks of about ``limit`` bytes of whole items the benchmark has, and the blocks. Each is fetched when it is asked for."""
    limit = limit or BLOCK_BYTES
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // limit))

    def fetched() -> Iterator[Benchmark]:
        for k in range(n):
            part = own if n == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
            yield benchmark_block(sorted(((r["item_id"], r["text"]) for r in part.toLocalIterator()), key=lambda r: (r[0] is not None, r)))

    return n, fetched()


_FOUND = T.StructType().add("spans", T.ArrayType(T.IntegerType())).add("items", T.ArrayType(T.StringType())).add("longest", T.StructType().add("words", "long").add("doc_word", "long").add("item_id", "string").add("item_word", "long"))


def hits(docs: DataFrame, shared, keep: list) -> DataFrame:
    """``keep`` of every document with n_words and, null without a match, the merged word spans (start, end, start, end, ...) of its matches, their items, and the longest match (of equally long ones the first place, there the least item and place in it)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            own = shard(tb.text_of(batch), bench)
            place, start, words, item = matches(own, bench)
            doc = np.searchsorted(own.heads, place, "right") - 1
            order = np.lexsort((start, place, doc))
            place, start, words, item, doc = (x[order] for x in (place, start, words, item, doc))
            found: dict[str, list] = {f.name: [None] * len(batch) for f in _FOUND}
            cuts = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)] if len(doc) else np.zeros(1, int)
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                d = doc[s]
                low = place[s:e] - own.heads[d]
                high = np.maximum.accumulate(low + words[s:e])
                new = np.r_[True, low[1:] > high[:-1]]
                found["spans"][d] = np.c_[low[new], high[np.r_[np.flatnonzero(new)[1:] - 1, len(high) - 1]]].ravel().tolist()
                found["items"][d] = [x for x in {bench.ids[i] for i in np.unique(item[s:e])} if x is not None]
                best = int(words[s:e].argmax())
                i = item[s + best]
                found["longest"][d] = {"words": int(words[s + best]), "doc_word": int(low[best]), "item_id": bench.ids[i], "item_word": int(start[s + best] - bench.first[i])}
            kinds = {"spans": pa.list_(pa.int32()), "items": pa.list_(pa.string()), "longest": pa.struct([("words", pa.int64()), ("doc_word", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64())])}
            yield pa.RecordBatch.from_arrays([*batch.columns[:held], pa.array(own.counts, pa.int64()), *(pa.array(found[k], kinds[k]) for k in kinds)], names=[*batch.schema.names[:held], "n_words", *kinds])

    picked = tb.with_text(docs, keep)
    held = len(keep)
    return picked.mapInArrow(apply, T.StructType([*picked.schema.fields[:held], T.StructField("n_words", T.LongType()), *_FOUND.fields]))


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """(item_id, item_word, words, doc_id, doc_word): for every benchmark suffix the longest verbatim match of ``least`` (two or more) words in any document, with one place of it: the greatest doc_id of equally long ones, as a string."""
    scratch, every = scratch or Scratch(docs.sparkSession), None
    for k, bench in enumerate(blocks(benchmark)[1]):
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        def apply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                part = shard(batch.column(1), own)
                query, n, place = longest(part, own)
                query, n, place = (x[n >= least] for x in (query, n, place))
                item = np.searchsorted(own.first, query, "right") - 1
                doc = np.searchsorted(part.heads, place, "right") - 1
                ids = batch.column(0).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array([own.ids[i] for i in item], pa.string()), pa.array(query - own.first[item]), pa.array(n), ids.cast(pa.string()), pa.array(place - part.heads[doc])], names=["item_id", "item_word", "words", "doc_id", "doc_word"])

        found = docs.select("doc_id", "text").mapInArrow(apply, "item_id string, item_word long, words long, doc_id string, doc_word long")
        found = scratch.save(found.groupBy("item_id", "item_word").agg(F.max(F.struct("words", "doc_id", "doc_word")).alias("m")), f"longest-{k}")
        shared.destroy()
        every = found if every is None else every.unionByName(found)
    return every.groupBy("item_id", "item_word").agg(F.max("m").alias("m")).select("item_id", "item_word", "m.*")


def _merged(docs: DataFrame, found: Iterator[Benchmark], keep: list, scratch: Scratch) -> DataFrame:
    """As ``hits``, over blocks: each leaves its hits by the hash of the text; spans of different blocks may overlap."""
    text = F.col(f"{tb.BOXED}.text") if tb.BOXED in keep else F.col("text")
    key = F.unhex(F.sha2(text, 256))
    every = None
    for k, bench in enumerate(found):
        shared = docs.sparkSession.sparkContext.broadcast(bench)
        part = hits(docs.select(key.alias("_key"), text.alias("text")), shared, ["_key"]).where("spans is not null").drop("n_words")
        part = scratch.save(part, f"hits-{k}")
        shared.destroy()
        every = part if every is None else every.unionByName(part)
    pairs = F.expr("transform(sequence(0, cast(size(spans) / 2 as int) - 1), i -> struct(spans[2 * i] as s, spans[2 * i + 1] as e))")
    best = F.min(F.struct((-F.col("longest.words")).alias("less"), "longest.doc_word", "longest.item_id", "longest.item_word")).alias("_best")
    by_text = every.groupBy("_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))).alias("_pairs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), best)
    longest_ = F.struct((-F.col("_best.less")).alias("words"), "_best.doc_word", "_best.item_id", "_best.item_word").alias("longest")
    by_text = by_text.select("_key", F.flatten(F.transform("_pairs", lambda p: F.array(p["s"], p["e"]))).alias("spans"), "items", longest_)
    rows = docs.select(*keep, F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"), key.alias("_key"))
    return rows.join(by_text, "_key", "left").drop("_key")


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``keep`` (default doc_id) of every document, with n_words, n_hit, n_items, items_sha256, contaminated, items (sorted as strings), spans and longest (words, doc_word, item_id, item_word; null without a match).

    A null or wordless text has no words and is not contaminated; a wordless item has no window. Items with a null id count for n_hit
    and not for the items. Documents may repeat: each row is judged alone, by its whole text, however long. Items may repeat: equal ids count once.
    Of equally long matches the first place counts, there the least item id. Without documents there are no rows, without a benchmark no hits; other columns, whatever their names, stay out.
    """
    keep = keep or ["doc_id"]
    n, found = blocks(benchmark)
    if n == 1:
        merged = hits(docs, docs.sparkSession.sparkContext.broadcast(next(found)), keep)
    else:
        merged = _merged(docs, found, keep, scratch or Scratch(docs.sparkSession))
    # spans are sorted by start: what of each lies beyond those before it
    n_hit = F.coalesce(F.expr("aggregate(sequence(0, cast(size(spans) / 2 as int) - 1), named_struct('n', 0L, 'at', 0), (a, i) -> named_struct('n', a.n + greatest(0, spans[2 * i + 1] - greatest(a.at, spans[2 * i])), 'at', greatest(a.at, spans[2 * i + 1])), a -> a.n)"), F.lit(0).cast("long"))
    items = F.array_sort(F.coalesce(F.col("items"), F.array().cast("array<string>")))
    out = merged.withColumn("n_hit", F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(n_hit)).withColumn("items", items)
    return out.select(*keep, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "spans", "longest")
