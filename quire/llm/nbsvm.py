"""Linear text classifiers with naive Bayes features (Wang and Manning, 2012).

n-gram indicators are scaled by the log-count ratio of the two classes; a linear hinge-loss model is fitted on
them by dual coordinate descent (Hsieh et al., 2008) and its margins are calibrated to probabilities.
The fit uses a bounded sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import textbytes as tb
from quire.llm.shared import fitted

BITS = 18
#: Labelled rows that a fit uses at most, in expectation; they are chosen by a hash of doc_id.
FIT_ROWS = 3000

_PUNCTUATION = np.ones(256, bool)
_PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), *range(0x09, 0x0E), 0x20]] = False


def _bucket(h: np.ndarray) -> np.ndarray:
    return (tb.mixed(h) >> np.uint64(64 - BITS)).astype(np.int32)


def char_grams(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Buckets of the byte n-grams (low to high bytes, at most 8) of one lower-cased text that stands between spaces."""
    text = np.empty(len(data) + 2, np.uint8)
    text[0] = text[-1] = 32
    text[1:-1] = tb.LOWER[data]
    rolling, found = text.astype(np.uint64), []
    for n in range(2, high + 1):
        if len(text) < n:
            break
        rolling = (rolling[:-1] << np.uint64(8)) | text[n - 1 :]
        if n >= low:
            found.append(_bucket(rolling + np.uint64((n * 0xD6E8FEB86659FD93) % 2**64)))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def toxicity_grams(data: np.ndarray) -> np.ndarray:
    """Character n-grams of 3 to 5 bytes."""
    return char_grams(data, 3, 5)


_SHAPE = np.full(256, ord("a"), np.uint8)
_SHAPE[0x30:0x3A], _SHAPE[0x41:0x5B] = ord("9"), ord("A")
for _b in [*np.flatnonzero(_PUNCTUATION), *range(0x09, 0x0E), 0x20]:
    _SHAPE[_b] = _b


def quality_grams(data: np.ndarray) -> np.ndarray:
    """n-grams of the shape of a text (letters, capitals and digits as classes, punctuation as itself), of its words, and of repeats.

    Runs of three or more equal classes count as three. A word n-gram notes which of its words repeat an earlier one of
    the five words before it, so that repetition is seen whatever the vocabulary. Whole lines count as words too.
    """
    none = np.zeros(0, np.int32)
    if not len(data):
        return none
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[3:] = ~((shape[3:] == shape[2:-1]) & (shape[2:-1] == shape[1:-2]) & (shape[1:-2] == shape[:-3]))
    shape, found = shape[keep], []
    rolling = shape.astype(np.uint64)
    for n in range(2, 5):
        if len(shape) < n:
            break
        rolling = (rolling[:-1] << np.uint64(8)) | shape[n - 1 :]
        if n >= 3:
            found.append(_bucket(rolling + np.uint64((n * 0xA24BAED4963EE407) % 2**64)))
    offsets = np.array([0, len(data)])
    lower = tb.LOWER[data]
    starts, ends, _ = tb.words(lower, offsets, tb.VISIBLE)
    h = tb.span_hashes(lower, starts, ends)
    found.append(_bucket(h ^ np.uint64(0x51ED270B)))
    same = np.zeros(len(h), np.uint64)
    for back in range(1, 6):
        if len(h) > back:
            same[back:] |= (h[back:] == h[:-back]).astype(np.uint64) << np.uint64(back - 1)
    for n in (1, 2, 3):
        if len(same) >= n:
            flags = sum(same[k : len(same) - n + 1 + k] << np.uint64(5 * k) for k in range(n))
            found.append(_bucket(flags + np.uint64(0x7F4A7C15 + n)))
    is_line = np.ones(256, bool)
    is_line[10] = False
    line_starts, line_ends, _ = tb.words(lower, offsets, is_line)
    seen = len(line_starts) - len(np.unique(tb.span_hashes(lower, line_starts, line_ends)))
    distinct = len(np.unique(h)) * 10 // max(1, len(h))
    found.append(_bucket(np.array([0xABCD00 + min(seen, 4), 0xABCE00 + distinct, 0xABCF00 + min(12, len(h).bit_length())], np.uint64)))
    return np.concatenate(found)


def _distinct(grams: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """The distinct buckets; ``stamp`` is scratch space of one entry a bucket, in any state."""
    order = np.arange(len(grams), dtype=np.int32)
    stamp[grams] = order
    return grams[stamp[grams] == order]


def _descend(rows: list[np.ndarray], ratio: np.ndarray, scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss over features ratio[row] * scale; the bias is one more feature of value 1.

    Returns coefficient times ratio for each bucket. Kept in that form, an update needs the squared ratios only, and no value is stored by row.
    """
    squared = ratio * ratio
    z, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    norm = np.array([s * s * squared[r].sum() + 1.0 for r, s in zip(rows, scale, strict=True)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            slope = y[i] * (scale[i] * z[r].sum() + bias) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                z[r] += step * scale[i] * squared[r]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return z, bias


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton steps."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - goal) * margins).sum() + 1e-6 * a, (p - goal).sum()])
        s = p * (1 - p) + 1e-9
        hess = np.array([[(s * margins**2).sum() + 1e-6, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


@dataclass
class Model:
    """``weights`` already hold ratio times coefficient, one a bucket. Scale: 1 / sqrt(distinct n-grams) of the text."""

    grams: Callable[[np.ndarray], np.ndarray]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, texts: Iterator[np.ndarray]) -> np.ndarray:
        stamp, out = np.zeros(1 << BITS, np.int32), []
        for t in texts:
            f = _distinct(self.grams(t), stamp)
            out.append(self.weights[f].sum(dtype=np.float64) / np.sqrt(max(1, len(f))) + self.bias)
        return np.array(out)

    def probabilities(self, texts: Iterator[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -60, 60)))


def fit(texts: list[bytes], labels: list[int], grams: Callable, *, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 8, folds: int = 2, least: int = 3) -> Model:
    """Fit on byte texts and 0/1 labels. With one class only, or no rows, the score is the constant smoothed share of label 1.

    Buckets that fewer than ``least`` sample texts hold are left out.
    """
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    empty = np.zeros(1 << BITS, np.float32)
    if not len(y) or len(set(y)) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(grams, empty, 0.0, 1.0, float(np.log(share / (1 - share))))
    stamp = np.zeros(1 << BITS, np.int32)
    rows = [_distinct(grams(np.frombuffer(t, np.uint8)), stamp) for t in texts]
    scale = np.array([1 / np.sqrt(max(1, len(r))) for r in rows])

    def train(part: np.ndarray) -> tuple[np.ndarray, float]:
        up, down = np.full(1 << BITS, smoothing), np.full(1 << BITS, smoothing)
        for i in part:
            (up if y[i] > 0 else down)[rows[i]] += 1
        held = (up + down - 2 * smoothing) >= least
        ratio = np.where(held, np.log((up / up.sum()) / (down / down.sum())), 0.0)
        share = (y[part] > 0).mean()
        return _descend([rows[i] for i in part], ratio, scale[part], y[part], np.where(y[part] > 0, cost * 0.5 / share, cost * 0.5 / (1 - share)), epochs, 7)

    fold = np.random.default_rng(11).permutation(len(y)) % folds
    out = np.zeros(len(y))
    for k in range(folds):
        part = np.flatnonzero(fold != k)
        if len(set(y[part])) < 2:
            continue
        w, bias = train(part)
        for i in np.flatnonzero(fold == k):
            out[i] = w[rows[i]].sum() * scale[i] + bias
    slope, shift = _platt(out, y)
    w, bias = train(np.arange(len(y)))
    return Model(grams, w.astype(np.float32), bias, slope, shift)


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, _y): about ``rows`` labelled rows whose doc_id passes ``learn``, chosen by a hash of doc_id.

    A doc_id with two labels, and null ids, texts or labels, are left out.
    """
    own = labels.select("doc_id", F.col(label).alias("_y")).where(F.col("_y").isin(0, 1) & learn).groupBy("doc_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").select("doc_id", "_y")
    total = own.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(1, total)))
    few = own.where(share)
    return docs.select("doc_id", "text").where(learn & share & F.col("text").isNotNull()).join(F.broadcast(few), "doc_id").select("doc_id", "text", "_y")


def learned(docs: DataFrame, labels: DataFrame, label: str, learn: Column, grams: Callable, rows: int = FIT_ROWS) -> Model:
    """The model of a label, fitted on a sample."""

    def fit_table(table: pa.Table) -> Model:
        held = sorted(zip(*(table[c].to_pylist() for c in ("doc_id", "text", "_y")), strict=True))
        return fit([t.encode() for _, t, _ in held], [y for _, _, y in held], grams)

    return fitted(sample(docs, labels, label, learn, rows), fit_table)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: list | None = None) -> DataFrame:
    """Columns ``keep`` (default doc_id) of ``docs`` with ``score`` and ``predicted``; a null text counts as empty.

    Texts are scored whole, whatever their length; each row is judged alone, so rows that repeat get the same. A score equal to ``threshold`` is predicted 1. Without rows there are none;
    other columns, whatever their names, stay out.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            text = tb.text_of(batch)
            p = [own.probabilities(data[a:b] for a, b in zip(o[:-1], o[1:], strict=True)) for _, _, data, o in tb.chunks(text)]
            p = np.concatenate(p) if p else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:held], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names[:held], "score", "predicted"])

    picked = tb.with_text(docs, keep)
    held = len(keep)
    return picked.mapInArrow(apply, T.StructType(picked.schema.fields[:held]).add("score", "double").add("predicted", "integer"))
