"""Token counts by a two-tier lookup of pre-tokens.

A byte-pair model whose pieces never hold a space mark after another character cannot merge across the start of a run of
spaces, nor across a character that no piece holds with a neighbour (the line feed, in the model used). So a text's
count is the sum over its pre-tokens. The lengths of frequent pre-tokens are broadcast in a table of at most
``TABLE`` entries; misses are encoded once and kept in a bounded cache of the worker. No pre-token is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.shared import fitted

#: Entries of the broadcast table, texts and bytes that it is counted on at most (in expectation), bytes of the longest of these texts, entries of a worker's cache, and the longest pre-token kept in either.
TABLE, TABLE_DOCS, TABLE_BYTES, TABLE_TEXT, CACHE, LONGEST = 1 << 16, 2000, 16 << 20, 1 << 18, 1 << 19, 64
LIMIT = 4096
_MARK = "▁"


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lengths(dict):
    """Tokens of a word after its space mark or, ``after`` being a line feed, at the start of a line. Misses are encoded; at ``CACHE`` entries it starts anew from the table."""

    def __init__(self, model, after: str, table: dict[str, int]):
        super().__init__(table)
        self.model, self.after, self.table = model, after, table
        self.less = len(model.encode(after, num_threads=1)) if after else 0

    def __missing__(self, word: str) -> int:
        if word:
            n = len(self.model.encode(self.after + word, num_threads=1)) - self.less
        else:
            n = 0 if self.after else 1
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
                self.update(self.table)
            self[word] = n
        return n


class Encoder:
    """Counts a text's tokens as the model does, from the lengths of its pre-tokens. Falls back to whole texts if the model's pieces don't allow the split."""

    def __init__(self, path: str, table: dict[str, int] | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.parts = not any(_MARK in p.lstrip(_MARK) for p in pieces) and not any("\n" in p and len(p) > 1 for p in pieces) and self._regular()
        self.words, self.heads = Lengths(self.model, "", table or {}), Lengths(self.model, "\n", {})

    def _regular(self) -> bool:
        """Whether the model adds one mark before a text, keeps all spaces, and takes a line feed as one token."""
        tokens = lambda t: self.model.encode(t, out_type=str)
        return tokens("") == [] and tokens("a")[0].startswith(_MARK) and "".join(tokens(" a  b ")) == _MARK * 2 + "a" + _MARK * 2 + "b" + _MARK and len(tokens("a\n")) == len(tokens("a")) + 1 and len(tokens("a\nb\tc")) == len(tokens("a\nb")) + len(tokens("a\tc")) - len(tokens("a"))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.parts:
            return len(self.model.encode(text, num_threads=1))
        if "  " in text or text[0] == " " or _MARK in text:
            return self._with_runs(text)
        words, heads = self.words.__getitem__, self.heads.__getitem__
        first, *lines = text.split("\n")
        n = sum(map(words, first.split(" "))) + len(lines)
        for line in lines:
            if line:
                head, *rest = line.split(" ")
                n += heads(head) + sum(map(words, rest))
        return n

    def _with_runs(self, text: str) -> int:
        """Where several space marks may stand together, a pre-token is the run of marks with the word after it."""
        lines = (_MARK + text.replace(" ", _MARK)).split("\n")
        n = len(lines) - 1
        for line in lines:
            head, *rest = line.split(_MARK)
            n += self.heads[head] if head else 0
            run = 0
            for word in rest:
                if word:
                    n += self.words[_MARK * run + word] if run else self.words[word]
                    run = 0
                else:
                    run += 1
            if run:
                n += self.words[_MARK * (run - 1)]
        return n


_encoders: dict[str, Encoder] = {}


def encoder(path: str, table: dict[str, int] | None = None) -> Encoder:
    """The process's encoder for a model file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, table)
    return _encoders[path]


def frequent(docs: DataFrame, path: str, entries: int = TABLE, rows: int = TABLE_DOCS) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about ``rows`` texts, or ``TABLE_BYTES`` if that is less, chosen by a hash of doc_id and counted in one task; the table only saves time, so a sample will do."""
    own = docs.select("doc_id", "text").where(F.octet_length("text") <= TABLE_TEXT)
    total = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    share = min(1.0, rows / max(1, total["n"]), TABLE_BYTES / max(1, total["bytes"] or 0))

    def counted(table: pa.Table) -> dict[str, int]:
        counts: Counter = Counter()
        for text in table["text"]:
            counts.update(text.as_py().replace("\n", " ").split(" "))
        model = Encoder(path)
        most = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:entries]
        return {w: model.words[w] for w, _ in most if len(w) <= LONGEST and _MARK not in w} if model.parts else {}

    return fitted(own.where(F.pmod(F.xxhash64("doc_id", F.lit("tokens")), F.lit(1 << 30)) < int((1 << 30) * share)), counted)


def token_counts(docs: DataFrame, path: str, keep: list | None = None, limit: int = LIMIT) -> DataFrame:
    """Columns ``keep`` (default doc_id) with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each whole text; null counts as empty.

    A long text is counted line by line, so it needs little more than itself. Rows that repeat are counted each; a text of ``limit`` tokens is not over it. Without rows there are none; other
    columns, whatever their names, stay out.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, path))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, shared.value)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            n = np.fromiter((own.count(t.as_py() or "") for t in text), np.int64, len(text))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(n > limit)], names=[*batch.schema.names[:-1], "n_tokens", "over_limit"])

    picked = docs.select(*keep, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").alias("_text"))
    return picked.mapInArrow(apply, T.StructType(picked.schema.fields[:-1]).add("n_tokens", "long").add("over_limit", "boolean"))
