import random
import re

import numpy as np
import pytest

from quire.llm import mixing


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    p = mixing.Permutation(n, 5)
    x = p(np.arange(n))
    assert sorted(x) == list(range(n)) and (p.inverse(x) == np.arange(n)).all()


def literal_targets(sizes):
    """The rule as it is worded: reshare the excess until no source is above its bound."""
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    t = [sum(sizes) * x / sum(w) for x in w]
    fixed = set()
    while True:
        above = [i for i in range(len(t)) if i not in fixed and t[i] > 3 * sizes[i] + 1e-9]
        if not above:
            return t
        excess = sum(t[i] - 3 * sizes[i] for i in above)
        for i in above:
            t[i] = 3 * sizes[i]
            fixed.add(i)
        free = [i for i in range(len(t)) if i not in fixed]
        for i in free:
            t[i] += excess * w[i] / sum(w[j] for j in free)


def test_targets():
    r = random.Random(0)
    for _ in range(200):
        sizes = [r.choice([0, 1, 5, 100, 10**6]) * r.randint(1, 9) for _ in range(r.randint(1, 9))]
        got = mixing.targets(sizes)
        assert got == pytest.approx(literal_targets(sizes)) and sum(got) == pytest.approx(sum(sizes))


def corpus(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 7, 300, 5000]))), r.choice(["a", "a", "a", "é", "b", "B", None]), "x") for i in range(150)]
    rows += [(900, None, "a", "x"), (901, "", "only", "x"), (None, "p q", "b", "x"), (5, "t t t", "b", "x"), (5, "t t t", "b", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")


def test_against_definition(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_BUCKET", 20)
    monkeypatch.setattr(mixing, "SHARD", 64)
    rows, frame = corpus(spark)
    got = mixing.mixed_documents(frame).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed_documents(frame.repartition(7)).collect()), key=str)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, count(t)) for i, t, _, _ in rows)
    names = sorted({s for _, _, s, _ in rows if s}, key=str.encode) + [None]
    sizes = [sum(count(t) for _, t, s, _ in rows if s == n) for n in names]
    goal = dict(zip(names, zip(sizes, literal_targets(sizes), strict=True), strict=True))
    by_id = {i: s for i, _, s, _ in rows}
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert (r.source_size, pytest.approx(r.target)) == (goal[by_id[r.doc_id]][0], goal[by_id[r.doc_id]][1])
        assert 0 <= r.taken <= 3 * r.size
        taken[by_id[r.doc_id]] += r.taken
    assert all(abs(taken[n] - goal[n][1]) <= 0.51 for n in names)


def test_pieces_are_whole(spark):
    from quire.llm.shared import Scratch

    _, frame = corpus(spark)
    starts, totals = mixing.packed(frame, Scratch(spark))
    pieces = mixing.mixture(starts, mixing.planned(totals)).collect()
    slots = {}
    for p in pieces:
        slots.setdefault((p.source_key, p.slot), []).append(p)
    assert all(sum(p.words for p in x) <= mixing.BLOCK for x in slots.values())
    assert mixing.mixed_documents(frame.limit(0)).count() == 0
