"""Texts of an Arrow batch as flat byte arrays, with vectorised words and hashes.

All functions work on the UTF-8 bytes. Every class of bytes used here treats the bytes of a multi-byte
character alike, so byte runs and character runs are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the column that holds a whole row.
BOXED = "_whole_row"

CHUNK_BYTES = 1 << 19

_RNG = np.random.default_rng(20240229)
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(inside: str) -> np.ndarray:
    """Boolean table of the bytes of a word: ``visible`` (no ASCII white space) or ``alnum`` (digits, ASCII letters, non-ASCII)."""
    table = np.ones(256, bool)
    if inside == "visible":
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif inside == "alnum":
        table[:0x80] = False
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    else:
        raise ValueError(inside)
    return table


VISIBLE, ALNUM = byte_class("visible"), byte_class("alnum")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) over whole texts of about ``limit`` bytes together; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def with_text(docs: DataFrame, keep: list, *more: Column) -> DataFrame:
    """``keep`` and, unless a boxed row among them holds it already, the text last but for ``more``."""
    return docs.select(*keep, *([] if BOXED in keep else [F.col("text").alias("_text")]), *more)


def text_of(batch: pa.RecordBatch) -> pa.Array:
    names = batch.schema.names
    return batch.column(names.index(BOXED)).field("text") if BOXED in names else batch.column(names.index("_text"))


def boxed(docs: DataFrame) -> DataFrame:
    """The whole row as one column, beside the id: no name can clash, and the text travels once."""
    return docs.select(F.struct("*").alias(BOXED), "doc_id")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of long texts takes, in the JVM and in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (with a closing total)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    own = inside[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = False
    before[1:], after[:-1] = own[:-1], own[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(own & ~before), np.flatnonzero(own & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        full = np.full(max(n, CHUNK_BYTES + 4096), _STEP if kind == "up" else _STEP_INVERSE, np.uint64)
        full[0] = 1
        _powers[kind] = np.multiply.accumulate(full)
    return _powers[kind][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over random byte codes, finalised."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _power("up", n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _power("down", n + 1)[starts])


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span of ``data`` has the bytes of its span of ``other``."""
    n = ends - starts
    same = n == other_ends - other_starts
    at = np.flatnonzero(same)
    n = n[at]
    last = np.cumsum(n)
    inner = np.arange(last[-1] if len(last) else 0) - np.repeat(last - n, n)
    unlike = np.flatnonzero(data[np.repeat(starts[at], n) + inner] != other[np.repeat(other_starts[at], n) + inner])
    same[at[np.searchsorted(last, unlike, "right")]] = False
    return same


class KeyIndex:
    """Open-addressing table from distinct uint64 keys to their positions; lookups are vectorised."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, np.uint64)
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        wait, at = np.arange(len(keys), dtype=np.int32), self._home(self.keys)
        while len(wait):
            free = self.slots[at] < 0
            self.slots[at[free]] = wait[free]
            lost = self.slots[at] != wait
            wait, at = wait[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _STEP) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is absent."""
        at = self._home(keys)
        found = self.slots[at]
        if not len(self.keys):
            return found
        wait = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        at = at[wait]
        while len(wait):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.slots[at]
            found[wait] = got
            more = (got >= 0) & (self.keys[got] != keys[wait])
            wait, at = wait[more], at[more]
        return found
