import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import langid
from quire.llm import textbytes as tb


def brute_bits(train, text):
    """Prediction by partial matching spelt out: counts by context, escapes by recursion."""
    fold = lambda b: bytes(langid.folded(np.frombuffer(b, np.uint8)))
    counts = {}
    for t in train:
        own = b"\n" * langid.ORDER + fold(t)
        for i in range(langid.ORDER, len(own)):
            for k in range(langid.ORDER + 1):
                c = counts.setdefault(own[i - k : i], {})
                c[own[i]] = c.get(own[i], 0) + 1

    def bits(context, symbol):
        here = counts.get(context)
        rest = lambda: bits(context[1:], symbol) if context else 8.0
        if not here:
            return rest()
        n = sum(here.values())
        if symbol in here:
            return -math.log2((2 * here[symbol] - 1) / (2 * n))
        return -math.log2(len(here) / (2 * n)) + rest()

    own = b"\n" * langid.ORDER + fold(text)
    return sum(bits(own[i - langid.ORDER : i], own[i]) for i in range(langid.ORDER, len(own)))


def test_code_lengths_are_exact():
    r = random.Random(1)
    say = lambda letters, n: "".join(r.choice(letters) for _ in range(n)).encode()
    train = {"x": [say("abc é", 200), say("abÉ", 50), b""], "y": [say("bcdü ", 300)], "z": [b""]}
    texts = [say("abcdé ü!", n) for n in (0, 1, 3, 60, 200)]
    got = langid.fit(train)
    column = pa.array([t.decode() for t in texts])
    bits = np.concatenate([got.code_lengths(d, o) for _, _, d, o in tb.chunks(column, 100)])
    want = [[brute_bits(train[n], t) for n in ("x", "y", "z")] for t in texts]
    assert bits == pytest.approx(np.array(want), rel=1e-5, abs=1e-3)


def corpus():
    r = random.Random(2)
    words = {"en": ["the", "of", "and", "house", "river"], "de": ["der", "und", "häuser", "fluss"], "fr": ["le", "et", "été", "rivière"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(3, 40))), lang, "s") for i, lang in enumerate(r.choice(list(words)) for _ in range(300))]
    return rows + [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "12 !", "de", "s"), (1003, "der und fluss", None, None), (None, "the river of", "en", "s"), (1004, "the river " * 30000, "en", "s"), (5, "le et", "fr", "s"), (5, "le et", "fr", "s")]


SCHEMA = "doc_id long, text string, lang string, source string"


def test_predictions(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as score", "2 as lang_pred")
    trees = langid.learned(frame, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    got = langid.predict(frame, trees).collect()
    assert len(got) == len(rows)
    by_id = {g.doc_id: g for g in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by_id[1003].lang_pred == "de" and by_id[None].lang_pred == "en" and by_id[1004].lang_pred == "en"
    known = [(by_id[i].lang_pred, lang) for i, _, lang, _ in rows if i is not None and i < 300 and i != 5]
    assert sum(a == b for a, b in known) >= 0.98 * len(known) and all(0 <= g.score <= 1 for g in got)


def test_empty_tables(spark):
    frame = spark.createDataFrame(corpus(), SCHEMA)
    learn = F.lit(True)
    nothing = langid.learned(frame.limit(0), learn)
    assert {r.lang_pred for r in langid.predict(frame, nothing).collect()} == {"und"}
    assert langid.predict(frame.limit(0), langid.learned(frame, learn)).count() == 0


def test_ties_take_the_first_name():
    got = langid.fit({"b": [b"abab"], "a": [b"abab"]})
    assert got.languages == ["a", "b"] and got.code_lengths(np.frombuffer(b"ab", np.uint8), np.array([0, 2])).argmin() == 0
