"""Language identification by prediction by partial matching.

For each language a context tree over bytes (orders 0 to ``ORDER``) is counted on a bounded sample and frozen. The code
length of a byte is that of its symbol in the longest context seen, or an escape to the next shorter one (method D: a
symbol counted c of n times costs -log2((2c-1)/2n), an escape from a context with d symbols -log2(d/2n)); below order 0 all
256 bytes are alike. Symbols of longer contexts are not excluded. A text costs the sum over its bytes; the language
that codes it shortest is predicted. Before coding, capitals of ASCII and of Latin-1 letters are folded, so that
shouted texts meet the same contexts.

The trees are merged into one table an order, whose row holds a (context, symbol)'s finished code length for every
language, so one lookup usually codes a byte for all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import textbytes as tb
from quire.llm.shared import fitted

ORDER = 4
#: Documents, and bytes, that a language's tree is counted on at most, in expectation, chosen by a hash of doc_id, and bytes of the longest text among them.
FIT_DOCS, FIT_BYTES, FIT_TEXT = 400, 4 << 20, 1 << 18
UNKNOWN = "und"
_PAD = 10


def folded(data: np.ndarray) -> np.ndarray:
    out = tb.LOWER[data]
    if len(out) > 1:
        out[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 0x20
    return out


def _contexts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte of every text: the byte with the ORDER bytes before it (line feeds before the text's first), as one integer."""
    lengths = np.diff(offsets)
    shift = np.repeat(np.arange(1, len(lengths) + 1) * ORDER, lengths)
    at = np.arange(len(data)) + shift
    spread = np.full(len(data) + ORDER * len(lengths), _PAD, np.uint64)
    spread[at] = folded(data)
    key = spread.copy()
    for k in range(1, ORDER + 1):
        key[k:] |= spread[:-k] << np.uint64(8 * k)
    return key[at]


@dataclass
class Trees:
    languages: list[str]
    grams: list[tb.KeyIndex]  # by order: (context, symbol) seen in any language
    costs: list[np.ndarray]  # by order: rows of grams, a column a language: bits
    contexts: list[tb.KeyIndex]
    escapes: list[np.ndarray]

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits that each text takes in each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            return out
        keys = _contexts(data, offsets)
        found = self.grams[ORDER].find(keys)
        cost = self.costs[ORDER][found]
        wait = np.flatnonzero(found < 0)
        cost[wait] = 0
        for k in range(ORDER, -1, -1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            own = keys[wait] & mask
            if k < ORDER:
                got = self.grams[k].find(own)
                cost[wait[got >= 0]] += self.costs[k][got[got >= 0]]
                wait, own = wait[got < 0], own[got < 0]
            context = self.contexts[k].find(own >> np.uint64(8))
            seen = context >= 0
            cost[wait[seen]] += self.escapes[k][context[seen]]
        cost[wait] += 8
        out[full] = np.add.reduceat(cost, offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def fit(texts: dict[str, list[bytes]]) -> Trees:
    """Count and freeze the trees of each language's texts."""
    languages = sorted(texts)
    trees = Trees(languages, [], [], [], [])
    keys = {}
    for name in languages:
        data = np.frombuffer(b"".join(texts[name]), np.uint8)
        keys[name] = _contexts(data, np.cumsum([0, *map(len, texts[name])]))
    for k in range(ORDER + 1):
        counted = [np.unique(keys[n] & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True) for n in languages]
        grams = np.unique(np.concatenate([g for g, _ in counted])) if languages else np.zeros(0, np.uint64)
        contexts = np.unique(grams >> np.uint64(8))
        escapes = np.zeros((len(contexts), len(languages)), np.float32)
        if k:
            below = trees.costs[-1][trees.grams[-1].find(grams & np.uint64((1 << 8 * k) - 1))]
        else:
            below = np.full((len(grams), len(languages)), 8, np.float32)
        cost = below.copy()
        of = np.searchsorted(contexts, grams >> np.uint64(8))
        for j, (g, c) in enumerate(counted):
            if not len(g):
                continue
            heads = np.flatnonzero(np.r_[True, (g[1:] >> np.uint64(8)) != (g[:-1] >> np.uint64(8))])
            total, kinds = np.add.reduceat(c, heads), np.diff(np.r_[heads, len(g)])
            at = np.searchsorted(contexts, g[heads] >> np.uint64(8))
            escapes[at, j] = -np.log2(kinds / (2 * total))
            cost[:, j] += escapes[of, j]
            cost[np.searchsorted(grams, g), j] = -np.log2((2 * c - 1) / (2 * np.repeat(total, kinds)))
        trees.grams.append(tb.KeyIndex(grams))
        trees.costs.append(cost)
        trees.contexts.append(tb.KeyIndex(contexts))
        trees.escapes.append(escapes)
    return trees


def sample(docs: DataFrame, learn: Column, rows: int = FIT_DOCS) -> DataFrame:
    """(doc_id, text, lang): about ``rows`` non-empty texts of each language, or ``FIT_BYTES`` if that is less, among the rows that pass ``learn``, chosen by a hash of doc_id. Texts above ``FIT_TEXT`` bytes teach nothing more."""
    own = docs.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & (F.length("text") > 0) & (F.octet_length("text") <= FIT_TEXT))
    counts = {r["lang"]: min(rows / r["n"], FIT_BYTES / r["bytes"]) for r in own.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect()}
    if not counts:
        return own.limit(0)
    bound = F.create_map(*[F.lit(x) for lang, share in counts.items() for x in (lang, int((1 << 30) * min(1.0, share)))])
    return own.where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) < bound[F.col("lang")])


def _fit_table(table: pa.Table) -> Trees:
    texts: dict[str, list[bytes]] = {}
    for _, text, lang in sorted(zip(*(table[c].to_pylist() for c in ("doc_id", "text", "lang")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        texts.setdefault(lang, []).append(text.encode())
    return fit(texts)


def learned(docs: DataFrame, learn: Column, rows: int = FIT_DOCS) -> Trees:
    """The trees of all languages of the rows that pass ``learn``."""
    return fitted(sample(docs, learn, rows), _fit_table)


def predict(docs: DataFrame, trees: Trees, keep: list | None = None) -> DataFrame:
    """Columns ``keep`` (default doc_id) with lang_pred, score (the language's share of the likelihoods) and bits_per_byte.

    lang_pred is ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Of languages that code
    a text equally short, the first by name is taken. Texts are coded whole, whatever their length; each row is judged alone, so rows that repeat get the same. Without rows
    there are none; other columns, whatever their names, stay out.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            text, letters = tb.text_of(batch), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            best, score, rate = np.full(len(letters), len(names) - 1), np.zeros(len(letters)), np.zeros(len(letters))
            for a, b, data, offsets in tb.chunks(text) if own.languages else ():
                bits = own.code_lengths(data, offsets)
                low = bits.argmin(axis=1)
                least = bits[np.arange(b - a), low]
                best[a:b], score[a:b] = low, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                rate[a:b] = least / np.maximum(1, np.diff(offsets))
            best[~letters], score[~letters] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:held], pa.array(names[best], pa.string()), pa.array(score), pa.array(rate)], names=[*batch.schema.names[:held], "lang_pred", "score", "bits_per_byte"])

    text = F.col(f"{tb.BOXED}.text") if tb.BOXED in keep else F.col("text")
    picked = tb.with_text(docs, keep, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    held = len(keep)
    schema = T.StructType(picked.schema.fields[:held]).add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return picked.mapInArrow(apply, schema)
