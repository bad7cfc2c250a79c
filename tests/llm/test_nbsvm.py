import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import nbsvm


def texts(n=300, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        own = [r.choice(["tha", "onre", "ing", "été", "of"]) for _ in range(r.randint(3, 60))]
        bad = r.random() < 0.3
        if bad:
            own.insert(r.randrange(len(own)), r.choice(["rotten", "Vile"]))
        out.append((i, " ".join(own), int(bad)))
    return out


def test_distinct_and_grams():
    stamp = np.random.default_rng(0).integers(0, 9, 1 << nbsvm.BITS).astype(np.int32)
    grams = nbsvm.toxicity_grams(np.frombuffer("Aba aba ABA".encode(), np.uint8))
    assert sorted(nbsvm._distinct(grams, stamp)) == sorted(set(grams.tolist()))
    for own in (nbsvm.toxicity_grams, nbsvm.quality_grams):
        for t in (b"", b"a", b"ab", b" \n", "é".encode() * 3, b"x" * 100_000):
            assert own(np.frombuffer(t, np.uint8)).dtype == np.int32


def test_descent_reaches_the_optimum():
    """Duality gap of the hinge-loss problem."""
    r = np.random.default_rng(1)
    rows = [np.sort(r.choice(40, 6, replace=False)) for _ in range(120)]
    ratio, scale = r.standard_normal(40), r.random(120) + 0.5
    values = [ratio[i] * s for i, s in zip(rows, scale, strict=True)]
    y = np.where(r.random(120) < 0.5, 1.0, -1.0)
    cost = np.full(120, 0.7)
    z, bias = nbsvm._descend(rows, ratio, scale, y, cost, 2000, 3)
    w = z / ratio
    margin = np.array([w[i] @ v + bias for i, v in zip(rows, values, strict=True)])
    norm = w @ w + bias**2
    primal = norm / 2 + (cost * np.maximum(0, 1 - y * margin)).sum()
    best = min(primal, *((lambda u, b: (u @ u + b * b) / 2 + (cost * np.maximum(0, 1 - y * np.array([u[i] @ v + b for i, v in zip(rows, values, strict=True)]))).sum())(w * s, bias * s) for s in (0.9, 0.98, 1.02, 1.1)))
    assert best == pytest.approx(primal, rel=1e-3)


def test_held_out_accuracy(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "rotten"), (None, "vile vile"), (903, "tha onre " * 20000), (5, "x"), (5, "x")], "doc_id long, text string").selectExpr("*", "0 as score", "1 as predicted")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(None, 0, 1), (7000, 0, None), (900, 0, 1)], "doc_id long, quality int, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = nbsvm.learned(docs, labels, "toxic", learn, nbsvm.toxicity_grams)
    got = {r.doc_id: r for r in nbsvm.score(docs, model).collect()}
    assert len(got) == 300 + 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    hits = [got[i].predicted == y for i, _, y in rows if i != 5]
    assert sum(hits) >= 0.97 * len(hits) and got[902].predicted == 1 and got[901].predicted == 0


def test_quality_of_held_out_texts(spark):
    """Marks, shouting and repeats make poor texts, in words that no other text has."""
    r = random.Random(6)
    rows = []
    for i in range(500):
        own = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 80))]
        kind = r.choice(["good", "good", "marks", "shout", "again"])
        if kind == "marks":
            own = [w + r.choice(["$$$", "***", "!!"]) for w in own]
        elif kind == "shout":
            own = [w.upper() + "!!" for w in own]
        elif kind == "again":
            own = [own[k % 4] for k in range(len(own))]
        rows.append((i, " ".join(own) + ".", int(kind == "good")))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = nbsvm.learned(docs, labels, "quality", F.crc32(F.col("doc_id").cast("string")) % 5 != 0, nbsvm.quality_grams)
    got = {x.doc_id: x.score for x in nbsvm.score(docs, model).collect()}
    held = {x.doc_id for x in docs.where("crc32(cast(doc_id as string)) % 5 = 0").collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i in held]
    assert len(right) > 60 and sum(right) >= 0.95 * len(right)


def plain_model(texts, labels, score):
    """Naive Bayes support vectors with dictionaries of n-grams instead of buckets, and the primal solved by subgradient steps."""
    def grams(t):
        b = b" " + t.lower().encode() + b" "
        return {b[i : i + n] for n in (3, 4, 5) for i in range(len(b) - n + 1)}

    sets = [grams(t) for t in texts]
    count = [{}, {}]
    for s, y in zip(sets, labels, strict=True):
        for g in s:
            count[y][g] = count[y].get(g, 0) + 1
    names = sorted(g for g in {**count[0], **count[1]} if count[0].get(g, 0) + count[1].get(g, 0) >= 3)
    total = [sum(c.values()) for c in count]
    ratio = {g: np.log((count[1].get(g, 0) + 1) / (total[1] + 1) * (total[0] + 1) / (count[0].get(g, 0) + 1)) for g in names}
    at = {g: k for k, g in enumerate(names)}

    def row(s):
        out = np.zeros(len(names) + 1)
        for g in s:
            if g in at:
                out[at[g]] = ratio[g] / np.sqrt(len(s))
        out[-1] = 1
        return out

    x, y = np.array([row(s) for s in sets]), np.where(np.array(labels) > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    w = np.zeros(x.shape[1])
    for k in range(1, 4000):
        w -= (w - ((y * (x @ w) < 1) * cost * y) @ x) / (k + 200)
    return np.array([row(grams(t)) @ w for t in score])


def test_against_dictionaries():
    rows = texts(200, 4)
    model = nbsvm.fit([t.encode() for _, t, _ in rows], [y for *_, y in rows], nbsvm.toxicity_grams, epochs=500)
    new = [t for _, t, _ in texts(100, 9)]
    got = model.margins(np.frombuffer(t.encode(), np.uint8) for t in new)
    want = plain_model([t for _, t, _ in rows], [y for *_, y in rows], new)
    assert np.corrcoef(got, want)[0, 1] > 0.99 and ((got > 0) == (want > 0)).mean() >= 0.97


def test_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = nbsvm.learned(docs, some, "quality", F.lit(True), nbsvm.quality_grams)
        scores = {r.score for r in nbsvm.score(docs, model).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1
    assert nbsvm.score(docs.limit(0), model).count() == 0
