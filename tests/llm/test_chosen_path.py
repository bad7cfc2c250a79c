import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import chosen_path, graph
from quire.llm.shared import Scratch


def shingles(text, size=3):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(size, len(own))
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 60))
    docs, passage = [], " ".join(word() for _ in range(12))
    for _ in range(25):
        own = [word() for _ in range(r.randint(1, 120))]
        docs.append(" ".join(own))
        for _ in range(r.choice([0, 1, 3, 6])):
            own = list(own)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = word()
            docs.append(r.choice([" ", "\n", "  "]).join(own).upper() if r.random() < 0.2 else passage + " " + " ".join(own) if r.random() < 0.2 else " ".join(own))
    docs += ["", None, " \t", "one", "ONE", "one two", "one two three", passage, passage]
    order = list(range(len(docs)))
    r.shuffle(order)
    return [(k * 7 % 1009, t) for k, t in zip(order, docs, strict=True)]


@pytest.mark.parametrize(("shingles", "work"), [(1 << 20, 1 << 30), (300, 1 << 30), (1 << 20, 2000), (60, 500)])
def test_against_brute_force(spark, shingles, work, monkeypatch):
    # small limits: pivots, deeper branching, pairs of blocks
    monkeypatch.setattr(chosen_path, "NODE_SHINGLES", shingles)
    monkeypatch.setattr(chosen_path, "NODE_WORK", work)
    monkeypatch.setattr(graph, "HOT", 2)
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as c", "1 as p", "text as path", "2 as component_id")
    got = chosen_path.similar_documents(frame).collect()
    assert {tuple(r) for r in got} == brute(docs) and len(got) == len(docs)


def test_words_of_equal_polynomial_hash_are_different(spark):
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, two = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    docs = [(1, one), (2, two), (3, f"{one} {two} {one} x"), (4, f"{two} {one} {two} x"), (5, two.upper())]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in chosen_path.similar_documents(frame).collect()} == brute(docs)


def test_shingles_are_exact():
    r = random.Random(3)
    for words in (5, 1 << 30):
        texts = ["".join(r.choice("ab c\n") for _ in range(r.randint(0, 60))).encode() for _ in range(40)]
        for size in (1, 3, 5):
            seen = chosen_path.numbering()
            numbers = [chosen_path.word_numbers(t, seen) for t in texts]
            got = chosen_path.shingled(numbers, size, max(words, len(seen)) if words > 5 else len(seen))
            want = [shingles(t.decode(), size) for t in texts]
            assert [len(g) for g in got] == [len(w) for w in want]
            assert all(len(set(a.tolist()) & set(b.tolist())) == len(x & y) for a, x in zip(got, want, strict=True) for b, y in zip(got, want, strict=True))


def test_long_texts(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "_PIECE", 1000)
    r = random.Random(4)
    own = [f"w{r.randint(0, 999)}" for _ in range(60_000)]
    docs = [(1, " ".join(own)), (2, "\n".join([*own[:59_000], *["z"] * 50])), (3, " ".join(own[:30_000])), (4, "x" * 100_000)]
    monkeypatch.setattr(chosen_path, "NODE_SHINGLES", 20_000)
    assert {tuple(x) for x in chosen_path.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == brute(docs)


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.85 exactly that share a node of the last level: what the trees miss at most, as pairs may meet before."""
    r = np.random.default_rng(5)
    rows = []
    for k in range(4000):
        own = r.integers(0, 2**63, 185 + 15, dtype=np.uint64)  # 170 shared, 15 of each alone: 170 / 200
        rows += [(2 * k + side, chosen_path._signature(np.r_[own[:170], own[170 + 15 * side : 185 + 15 * side]]).tolist()) for side in (0, 1)]
    classes = spark.createDataFrame(rows, "c long, signature array<int>").selectExpr("c", "1L as n_shingles", "signature")
    nodes = chosen_path._members(classes)
    for level in range(chosen_path.FIRST, chosen_path.DEPTH):
        nodes = chosen_path._branched(nodes.join(classes.select("c", "signature"), "c"), level).drop("signature")
    pair = F.floor(F.col("c") / 2)
    met = nodes.groupBy(pair.alias("pair"), "tree", "path").agg(F.count_distinct("c").alias("n")).where("n = 2")
    got = met.select("pair").distinct().count()
    print("met", got / 4000, [x.n / 4000 for x in met.groupBy("tree").agg(F.count_distinct("pair").alias("n")).collect()])
    assert got >= 0.997 * 4000
    by_tree = met.groupBy("tree").agg(F.count_distinct("pair").alias("n")).collect()
    assert len(by_tree) == chosen_path.TREES and all(x.n >= 0.85 * 4000 for x in by_tree)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "A b  c d"), (3, None), (4, ""), (5, "p q r s"), (5, "u v w x"), (6, "u v w x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, chosen_path.similar_documents(frame).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False)], key=str)
    assert chosen_path.similar_documents(frame.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 9), (9, 5), (7, 7), (None, 1)] + [(200, k) for k in range(201, 260)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()))
    assert got == {**dict.fromkeys(range(100, 141), 100), 3: 3, 5: 3, 9: 3, **dict.fromkeys(range(200, 260), 200)}
