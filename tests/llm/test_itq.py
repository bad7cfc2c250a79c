import numpy as np
import pytest

from quire.llm import itq


def brute(rows, cosine=0.95):
    ids = [i for i, v in rows]
    sound = [i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    unit = np.array([np.array(v, float) / np.linalg.norm(v) if s else np.zeros(16) for s, (_, v) in zip(sound, rows, strict=True)])
    close = unit @ unit.T >= cosine
    np.fill_diagonal(close, False)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(*np.nonzero(close), strict=True):
        x, y = sorted((find(ids[a]), find(ids[b])))
        root[y] = x
    return sorted(((i, int(c.sum()), find(i) if i is not None else None, i is None or find(i) == i) for i, c in zip(ids, close, strict=True)), key=str)


def corpus():
    r = np.random.default_rng(2)
    out = []
    for _ in range(60):
        v = r.standard_normal(16)
        out.append(v)
        for _ in range(int(r.choice([0, 0, 1, 3, 20]))):
            out.append(v + r.standard_normal(16) * r.choice([0.0, 0.03, 0.1]))
    rows = [(int(k), x.astype(np.float32).tolist()) for k, x in zip(r.permutation(len(out)), out, strict=True)]
    same = rows[0][1]
    nan, inf = float("nan"), float("inf")
    return rows + [(5000, None), (5001, [0.0] * 16), (5002, [nan] + same[1:]), (5003, [None] + same[1:]), (5004, [inf] + same[1:]), (5005, []), (5006, [1.0]), (None, same), (5007, [2 * x for x in same])]


@pytest.mark.parametrize("bucket", [1024, 8])
def test_against_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(itq, "BUCKET", bucket)
    rows = corpus()
    got = itq.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = brute(rows)
    links = sum(w[1] for w in want)
    assert len(got) == len(rows) and links * 0.9 <= sum(g.n_links for g in got) <= links
    assert sum(tuple(g) == w for g, w in zip(sorted(map(tuple, got), key=str), want, strict=True)) >= 0.9 * len(rows)
    only = {r[0]: r for r in want}
    assert all(g.n_links <= only[g.vec_id][1] for g in got)


def test_empty_and_sole(spark):
    frame = spark.createDataFrame(corpus(), "vec_id long, embedding array<float>")
    assert itq.similar_vectors(frame.limit(0)).count() == 0
    assert [tuple(r) for r in itq.similar_vectors(frame.where("vec_id = 5007")).collect()] == [(5007, 0, 5007, True)]
    assert [tuple(r) for r in itq.similar_vectors(frame.where("vec_id = 5000")).collect()] == [(5000, 0, 5000, True)]


@pytest.mark.parametrize(("size", "vectors"), [(16, 10**6), (32, 10**8), (32, 10**9), (64, 5 * 10**7), (64, 10**10), (256, 10**9)])
def test_recall_at_the_threshold(size, vectors):
    """Of pairs at the threshold, fresh ones, and for every size as many rotations as that takes."""
    r = np.random.default_rng(3)
    x = itq.unit_rows(r.standard_normal((3000, size)))
    codes = itq.fit(x, vectors, 0.95)
    z = itq.unit_rows(r.standard_normal((3000, size)))
    u = r.standard_normal(z.shape)
    u = itq.unit_rows(u - (u * z).sum(1, keepdims=True) * z)
    y = 0.95 * z + np.sqrt(1 - 0.95**2) * u
    met = (codes.keys(z) == codes.keys(y)).any(axis=1).mean()
    print(size, vectors, "width", codes.width, "tables", codes.tables, "recall", met)
    assert met >= 0.95


def test_bucket_links():
    r = np.random.default_rng(8)
    unit = itq.unit_rows(np.repeat(r.standard_normal((30, 12)), 40, axis=0) + 0.15 * r.standard_normal((1200, 12)))
    keys, copies = r.integers(0, 3, (1200, 4)), r.integers(1, 4, 1200)
    for half in (None, r.integers(0, 2, 1200)):
        close = (unit @ unit.T >= 0.95) & ~np.eye(1200, dtype=bool)
        if half is not None:
            close &= half[:, None] != half[None, :]
        new = close & ~(keys[:, None, :2] == keys[None, :, :2]).any(axis=2)
        got, links = itq.bucket_links(unit, keys, copies, 2, 0.95, half)
        assert got.tolist() == (new @ copies).tolist()
        assert all(close[a, b] for a, b in links)


def test_hot_vector_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(itq.graph, "HOT", 5)
    rows = corpus() + [(6000 + k, [1.0] * 16) for k in range(40)] + [(7000 + k, None) for k in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as p", "2 as q", "vec_id as c", "3 as n_links", "4 as copies", "embedding as v")
    got = {r.vec_id: r for r in itq.similar_vectors(frame).collect() if r.vec_id and r.vec_id >= 6000}
    assert len(got) == 60 and all(got[6000 + k][1:] == (39, 6000, k == 0) for k in range(40)) and all(got[7000 + k][1:] == (0, 7000 + k, True) for k in range(20))


@pytest.mark.parametrize("bucket", [1024, 8])
def test_each_dimension_has_its_links(spark, bucket, monkeypatch):
    monkeypatch.setattr(itq, "BUCKET", bucket)
    r = np.random.default_rng(5)
    rows = []
    for size, n in ((16, 40), (8, 25), (3, 4), (1, 1)):
        for _ in range(n):
            v = r.standard_normal(size)
            rows += [(len(rows) + k, (v * (1 + k)).tolist()) for k in range(2)]
    rows.append((len(rows), rows[-1][1] + [0.0]))
    got = {g.vec_id: g for g in itq.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    for k, v in rows:
        # twice a vector meets it in every table
        same = [j for j, w in rows if j != k and len(w) == len(v) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95]
        assert got[k].n_links <= len(same) and got[k].n_links >= min(1, len(same)) and got[k].component_id <= min([k, *same])
    assert got[len(rows) - 1].n_links == 0 and got[len(rows) - 1].kept
