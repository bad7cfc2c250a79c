import hashlib
import random
import re

import pytest

from quire.llm import suffix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item_id, t in items:
            w = words(t)
            n = min(13, len(w))
            for k in range(max(1, len(w) - 12)) if w else ():
                for p in range(len(own) - n + 1):
                    if own[p : p + n] == w[k : k + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item_id))
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)))
    return out


def tables(spark, seed=3):
    r = random.Random(seed)
    vocabulary = ["a", "B", "cé", "d9", "e", "Fx"]
    say = lambda n: r.choice([" ", ", "]).join(r.choice(vocabulary) for _ in range(n))
    items = [(k, say(r.choice([2, 5, 13, 20, 40]))) for k in range(12)] + [(90, ""), (91, None), (92, "lone"), (93, say(13)), (10, "ten ten")]
    items.append((94, items[-2][1]))
    docs = [(k, say(r.randint(0, 90))) for k in range(60)] + [(200, None), (201, ""), (202, "!!"), (203, "a lone tree"), (204, "x " * 30 + items[3][1] * 3 + " y"), (204, "x " * 30 + items[3][1] * 3 + " y"), (205, (items[2][1] + " zz ") * 50)]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def brute_longest(docs, items):
    """(words, place, item, place in it) of the longest match of each document, with brute force."""
    out = []
    for _, text in docs:
        own, best = words(text), None
        for item_id, t in items:
            w = words(t)
            for q in range(len(w)):
                for p in range(len(own)):
                    n = 0
                    while p + n < len(own) and q + n < len(w) and own[p + n] == w[q + n]:
                        n += 1
                    if n and n >= min(13, len(w)):
                        new = (-n, p, str(item_id), q)
                        best = new if best is None else min(best, new)
        out.append(best and (-best[0], *best[1:]))
    return out


@pytest.mark.parametrize("limit", [suffix.BLOCK_BYTES, 150])
def test_against_brute_force(spark, limit, monkeypatch):
    docs, items, d, b = tables(spark)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", limit)
    got = suffix.contamination(d.withColumn("items", d.text).withColumn("longest", d.doc_id).withColumn("_text", d.doc_id), b).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(brute(docs, items))
    want = {d: x for (d, _), x in zip(docs, brute_longest(docs, items), strict=True)}
    assert {r.doc_id: r.longest and tuple(r.longest) for r in got} == want
    boxed = suffix.contamination(suffix.tb.boxed(d), b, [suffix.tb.BOXED]).collect()
    assert sorted((r[suffix.tb.BOXED].doc_id, r.n_hit) for r in boxed) == sorted((r.doc_id, r.n_hit) for r in got)


def colliding():
    """Two words of 1,024 letters whose polynomial hashes are equal."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_words_of_equal_hash(spark):
    one, two = colliding()
    data = suffix.np.frombuffer((one + two).encode(), suffix.np.uint8)
    h = suffix.tb.span_hashes(data, suffix.np.array([0, 1024]), suffix.np.array([1024, 2048]))
    assert h[0] == h[1]
    items = [(1, "x " + one + " y"), (2, "p " + two + " q")]
    docs = [(1, f"x {two} y"), (2, f"x {one} y"), (3, f"p {two} q"), (4, f"p {one} q"), (5, one), (6, f"x {one} y p {two} q")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in suffix.contamination(*frames).collect())
    assert got == sorted(brute(docs, items)) and [r[2] for r in got] == [0, 3, 3, 0, 0, 6]


def test_very_long_text(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    text = "filler words here " * 400_000 + passage + " tail" * 100_000
    frames = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string")
    r = suffix.contamination(*frames).first()
    assert (r.n_words, r.n_hit, r.contaminated, tuple(r.longest)) == (1_300_030, 30, False, (30, 1_200_000, "1", 0))


def test_empty_tables(spark):
    docs, _, d, b = tables(spark)
    assert suffix.contamination(d.limit(0), b).count() == 0
    rows = suffix.contamination(d, b.limit(0)).collect()
    assert len(rows) == len(docs) and not any(r.contaminated or r.n_hit for r in rows)


def test_longest_matches(spark):
    d = spark.createDataFrame([(1, "x a b c d e f g h i j k l m n o p y"), (2, "a b c d e f g h i j k l m")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "q a b c d e f g h i j k l m n o p")], "item_id long, text string")
    got = {r.item_word: (r.words, r.doc_id, r.doc_word) for r in suffix.longest_matches(d, b).collect()}
    assert got == {1: (16, "1", 1), 2: (15, "1", 2), 3: (14, "1", 3), 4: (13, "1", 4)}
