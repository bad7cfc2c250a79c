import random
import re
import sys

import __spark_entry__
import corpus_pipeline
from quire.llm import queries


def corpus(spark, folder):
    r = random.Random(9)
    words = {"en": ["tha", "onre", "ing", "of", "the", "house"], "de": ["der", "und", "häuser", "fluss", "schon"]}
    docs, labels = [], []
    for i in range(400):
        lang = r.choice(["en", "en", "de"])
        own = [r.choice(words[lang]) + str(r.randint(0, 99)) for _ in range(r.randint(30, 80))]
        toxic = i % 7 == 0
        if toxic:
            own[3] = "rottenvile"
        docs.append((i, " ".join(own), lang, r.choice(["s1", "s2", "s3", None])))
        labels.append((i, 1, int(toxic)))
    base = docs[1][1]
    docs += [(1000, base, "en", "s1"), (1001, base.upper(), "en", "s2"), (1002, "12 34", "en", "s1"), (1003, None, "en", "s1"), (1004, docs[2][1] + " more", "en", "s1")]
    passage = " ".join(f"bench{k}" for k in range(20))
    docs += [(2000, "the house of " + passage, "en", "s1"), (2001, " ".join(f"the{k} house" for k in range(400)) + " bench1 bench2", "en", "s1")]
    docs = [(*d, len(d[1] or ""), "extra") for d in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_and_run(spark, tmp_path):
    folder = str(tmp_path)
    docs = corpus(spark, folder)
    source = {d[0]: d[3] for d in docs}
    toxic = {i for i in range(400) if i % 7 == 0}
    kept = set(source) - {1002, 1003} - toxic - {1000, 1001, 1004} - {2000}
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    gone = [{1002, 1003}, toxic, {1000, 1001, 1004}, {2000}]
    for (name, stage), out in zip(corpus_pipeline.STAGES[:-1], gone, strict=True):
        before, columns = {r.doc_id for r in frame.select("doc_id").collect()}, frame.columns
        frame = stage(spark, frame, folder)
        assert frame.columns == columns, name
        frame.write.parquet(f"{folder}/{name}")
        frame = spark.read.parquet(f"{folder}/{name}")
        assert before - {r.doc_id for r in frame.select("doc_id").collect()} == out, name
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == kept
    size = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs}
    assert all(r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in got)
    for s in ("s1", "s2", "s3", None):
        own = [r for r in got if source[r.doc_id] == s]
        assert sum(r.size for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= 0.51


def test_repeated_ids_and_clashing_names(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, 5, "b"), (1, "another " * 9, 6, "a"), (1, "another " * 9, 6, "c"), (2, text, 7, "d"), (None, text, 8, "e"), (3, None, 9, "f"), (4, "", 1, "g"), (4, None, 2, "h")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _kept int, n string").selectExpr("*", "1 as component_id", "2 as p", "'x' as kept", "3 as _at")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted([rows[1], rows[4], rows[5], rows[7]], key=str)
    assert stage(spark, docs.limit(0), "").count() == 0


def test_entry_lists_every_query():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert "quire.llm" in sys.modules and not any(m.startswith("quire.llm") for m in ("quire.plans.catalogue",))


def test_nothing_else_imports_it():
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent
    for path in root.joinpath("quire").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "quire.llm" not in path.read_text(encoding="utf-8"), path
