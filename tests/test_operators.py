import json

import pytest
from pyspark.sql import functions as F

from quire.operators import assembly, envelope, figures, gating, store

GOOD = '<<<MARKDOWN>>>\n# T\nsee <<<NOTES>>> inline\n <<<MARKDOWN>>>\n<<<OTHER>>>\n<<<END_MARKDOWN>>>  \n<<<FIGURES>>>\n[{"index": 1, "bbox": [0, 1, 2.5, 3], "alt": "a"}]\n<<<END_FIGURES>>>\n<<<FURNITURE>>>\n{"header": "H", "page-number": 3}\n<<<END_FURNITURE>>>\n<<<NOTES>>>\n<<<END_NOTES>>>'


def test_transcription():
    got = envelope.transcription(GOOD)
    assert got["markdown"] == "# T\nsee <<<NOTES>>> inline\n <<<MARKDOWN>>>\n<<<OTHER>>>" and got["figures"][0]["bbox"] == [0.0, 1.0, 2.5, 3.0] and got["furniture"] == {"header": "H", "footer": "", "page_number": "3"}


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (lambda r: "", "missing sections"),
        (lambda r: r.rpartition("\n")[0], "truncated: <<<NOTES>>> never closed"),
        (lambda r: "<<<END_NOTES>>>\n" + r, "line 1: unexpected"),
        (lambda r: r + "\n<<<NOTES>>>", "duplicate"),
        (lambda r: "hi\n" + r, "line 1: content outside any section: 'hi'"),
        (lambda r: "<<<OTHER>>>\n" + r, "stray marker"),
        (lambda r: r.replace("<<<FIGURES>>>", " <<<FIGURES>>>"), "content outside"),
        (lambda r: r.replace('"alt": "a"', '"alt": 3'), "FIGURES[0].alt must be a string"),
        (lambda r: r.replace('"alt": "a"', '"x": 3'), "FIGURES[0] missing key 'alt'"),
        (lambda r: r.replace("2.5, 3]", "2.5]"), "bbox must be 4 numbers"),
        (lambda r: r.replace('"index": 1', '"index": "x"'), "index must be a number"),
        (lambda r: r.replace('[{"index"', '{"a":[{"index"').replace('"a"}]', '"a"}]}'), "must be a JSON array"),
        (lambda r: r.replace('{"header"', '[{"header"'), "invalid FURNITURE JSON"),
    ],
)
def test_malformed(change, error):
    assert error in envelope.attempted(envelope.transcription, change(GOOD))["error"]


@pytest.mark.parametrize("payload", ['{"coverage": 101, "verdict": "pass"}', '{"coverage": true, "verdict": "pass"}', '{"coverage": 9, "verdict": "pass", "misses": "x"}', '{"coverage": 9, "verdict": "maybe"}', '{"coverage": 9}', "[]", "{", '{"coverage": 98.0, "verdict": "pass"}'])
def test_bad_verdicts(spark, payload):
    raw = f"<<<VERDICT>>>\n{payload}\n<<<END_VERDICT>>>"
    assert envelope.attempted(envelope.verdict, raw)["error"]
    assert not spark.createDataFrame([(payload,)], "p string").select(envelope.verdict_fields(F.col("p")).alias("v")).first().v.ok


def test_diagram_and_columns(spark):
    raw = '<<<DIAGRAM>>>\n{"convertible": true, "type": "pie", "confidence": 91}\n<<<END_DIAGRAM>>>\n<<<MERMAID>>>\npie\n a\n<<<END_MERMAID>>>\n<<<DATA>>>\n{"columns": ["c"], "rows": [["1"]]}\n<<<END_DATA>>>'
    frame = spark.createDataFrame([(raw, GOOD), (None, None)], "d string, t string")
    rows = frame.select(envelope.parsed_diagram(F.col("d")).alias("d"), envelope.parsed_transcription(F.col("t")).alias("t")).collect()
    assert rows[0].d.data.rows == [["1"]] and rows[0].d.error is None and rows[0].t.figures[0]["index"] == 1 and "missing" in rows[1].t.error
    for bad in ('{"convertible": 1}', '{"convertible": true, "confidence": 101}', '{"convertible": true, "type": 2}'):
        assert envelope.attempted(envelope.diagram, raw.replace(raw.split("\n")[1], bad))["error"]


def pages(spark, *documents):
    rows = [(f"d{i}", n, t) for i, d in enumerate(documents) for n, t in enumerate(d, 1)]
    return spark.createDataFrame(rows, "doc_id string, page_number int, text string")


def plain_join(texts):
    """The rule spelt out on strings."""
    import re

    row = lambda x: bool(re.match(r"^\s*\|.*\|\s*$", x)) and not sep(x)
    sep = lambda x: bool(re.match(r"^\s*\|?[\s:|-]+\|?[\s:|-]*$", x))
    item = lambda x: bool(re.match(r"^\s*([-*+]|\d+[.)])\s+\S", x))
    full = lambda t: [x for x in t.splitlines() if x.strip()] or [""]
    out = None
    for t in (t.strip("\n") for t in texts if t.strip()):
        if out is None:
            out = t
        elif row(full(out)[-1]) and (row(full(t)[0]) or sep(full(t)[0])):
            ls = t.splitlines()
            at = next(i for i, x in enumerate(ls) if x.strip())
            out += "\n" + ("\n".join(ls[:at] + ls[at + 1 :]) if sep(ls[at]) else t).lstrip("\n")
        elif item(full(out)[-1]) and item(full(t)[0]):
            out += "\n" + t
        else:
            out += "\n\n" + t
    return out + "\n" if out else None


def test_join(spark):
    import random

    r = random.Random(3)
    bits = ["| a | b |", "|---|---|", "- x", "2. y", "prose", "", "---", "| c |\n", "\n| d |"]
    docs = [["\n".join(r.choice(bits) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 7))] for _ in range(60)]
    docs.append(["| a |", "|---|", "| b |"])
    got = {x.doc_id: x.document for x in assembly.joined_pages(pages(spark, *docs)).collect()}
    assert got == {f"d{i}": plain_join(d) for i, d in enumerate(docs) if plain_join(d)}


def test_contents(spark):
    frame = spark.createDataFrame([("# T\nx\n## A\ny\n",), ("## B\n### C\n",), ("x",), ("# T only",)], "t string")
    got = [r.v for r in frame.select(assembly.assembled(F.col("t")).alias("v")).collect()]
    assert got == ["# T\n\n## Table of Contents\n\n  - [A](#a)\nx\n## A\ny\n", "# B\n\n## Table of Contents\n\n  - [C](#c)\n## C", "x", "# T only"]
    assert frame.select(assembly.assembled(F.col("t"), False).alias("v")).first().v == "# T\nx\n## A\ny\n"


def test_furniture(spark):
    docs = [[f"Annual report 2024, page {n}\nbody {n} {'x' * n}\n\n<!--FIG:1:1:1,2,3,4-->\nfooter" for n in range(1, 6)], ["solo page"], ["a", "b", "c"]]
    own = pages(spark, *docs)
    exact = assembly.furniture_exact(own)
    assert [(r.doc_id, r.key, r.hits) for r in exact.collect()] == [("d0", "footer", 5)]
    near = assembly.furniture_similar(own)
    assert {r.key for r in near.collect()} == {"footer", *(f"Annual report 2024, page {n}" for n in range(1, 6))}
    got = {(r.doc_id, r.page_number): r.text for r in assembly.without_furniture(own, near).collect()}
    assert got["d0", 2] == "body 2 xx\n\n<!--FIG:1:1:1,2,3,4-->\n" and got["d1", 1] == "solo page" and got["d2", 1] == "a"
    assert {(r.key, r.pages) for r in assembly.furniture_pages(own, exact).collect()} == {("footer", 5)}


def test_context(spark):
    own = pages(spark, ["# a\n1", "", "2", "## b\n3", "4", "5"])
    got = [(r.context, r.outline) for r in assembly.rolling_context(own, 2).orderBy("page_number").collect()]
    assert got == [("", ""), ("# a\n1", "# a"), ("# a\n1", "# a"), ("# a\n1\n\n2", "# a"), ("2\n\n## b\n3", "# a\n## b"), ("## b\n3\n\n4", "# a\n## b")]


def test_store(spark):
    log = spark.createDataFrame([("j", p, v, s) for p, v, s in [(1, 1, "verified"), (2, 1, "verified"), (3, 1, "needs_review"), (4, 1, "transcribed"), (4, 2, "ocr")]], "job_id string, page_number int, version long, status string")
    jobs = spark.createDataFrame([("j", 5), ("k", 0), ("l", 2)], "job_id string, page_count int")
    point = lambda x: {r.job_id: r.page_number for r in store.resume_points(jobs, store.latest(x, ["job_id", "page_number"])).collect()}
    assert point(log) == {"j": 4, "k": None, "l": 1}
    new = spark.createDataFrame([("j", 2, 9, "verified"), ("j", 4, 9, "verified")], log.schema)
    assert [r.page_number for r in store.admitted(log, new, ["job_id", "page_number"]).collect()] == [4]
    again = log.union(store.invalidation(log, new.where("page_number = 2"), ["job_id", "page_number"]))
    assert point(again)["j"] == 2 and store.admitted(again, new, ["job_id", "page_number"]).count() == 2


def test_replace_job(spark, tmp_path):
    rows = lambda j, n: spark.createDataFrame([(j, i) for i in range(n)], "job_id string, n int")
    path = str(tmp_path / "images")
    for frame in (rows("a", 3), rows("b", 2), rows("a", 1)):
        store.replace_job(frame, path)
    assert {(r.job_id, r["count"]) for r in spark.read.parquet(path).groupBy("job_id").count().collect()} == {("a", 1), ("b", 2)}


def test_gating(spark):
    base = {"dpi": 200, "reference_kind": "native", "misses": ["m"], "floor_score": None, "prompt_tokens": 1, "completion_tokens": 2, "ms": 1.0, "envelope_error": None}
    rows = [
        ("a", 0, "m0", 90, "retry", None, None), ("a", 1, "m1", 96, "pass", 0.9, None), ("a", 2, "m2", 99, "pass", None, None),
        ("b", 0, "m0", 94, "pass", None, None), ("b", 1, None, None, None, None, "line 1: bad"),
        ("c", 0, "m0", 99, "pass", 0.4, None),
    ]
    frame = spark.createDataFrame([{**base, "job_id": j, "page_number": 1, "attempt": a, "markdown": m, "coverage": c, "verdict": v, "floor_score": f, "envelope_error": e} for j, a, m, c, v, f, e in rows], "job_id string, page_number int, attempt int, dpi int, reference_kind string, markdown string, coverage int, verdict string, misses array<string>, floor_score double, prompt_tokens long, completion_tokens long, ms double, envelope_error string")
    got = {r.job_id: (r.status, r.markdown, r.coverage_score, r.retries, r.token_usage.prompt, r.notes) for r in gating.reduced(frame).collect()}
    assert got == {"a": ("verified", "m1", 96, 1, 2, None), "b": ("needs_review", "", 0, 1, 2, "verification cap reached"), "c": ("needs_review", "m0", 99, 0, 1, "coverage floor failed: judge score alone is insufficient")}
    kept = {r.job_id: r.markdown for r in gating.reduced(frame, reference_compatible=False).collect()}
    assert kept["b"] == "m0"
    notes = [r.n for r in frame.select("job_id", "attempt", gating.retry_note().alias("n")).orderBy("job_id", "attempt").collect()]
    assert json.dumps(["m"], separators=(",", ":")) in notes[0] and "malformed" in notes[4] and "floor FAILED" in notes[5]


def test_greedy(spark):
    refs = spark.createDataFrame([("d", 1, i, 0.0, 0.0, w, 10.0) for i, w in enumerate((10.0, 9.0, 8.0))], "doc_id string, page_number int, ord int, x0 double, y0 double, x1 double, y1 double")
    natives = spark.createDataFrame([("d", 1, i, 0.0, 0.0, 10.0, 10.0) for i in range(2)], "doc_id string, page_number int, pos int, x0 double, y0 double, x1 double, y1 double")
    got = {r.ord: r.pos for r in figures.greedy_matches(figures.scored_pairs(refs, natives)).collect()}
    assert got == {0: 0, 1: 1}


def test_spans_and_natives(spark):
    spans = spark.createDataFrame([("d", 1, 0, "in", 1.0, 1.0, 2.0, 2.0), ("d", 1, 1, "out", 50.0, 50.0, 60.0, 60.0)], "doc_id string, page_number int, pos int, text string, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([("d", 1, 7, 0.0, 0.0, 5.0, 5.0), ("d", 1, 8, 90.0, 90.0, 95.0, 95.0)], "doc_id string, page_number int, idx int, x0 double, y0 double, x1 double, y1 double")
    assert {r.idx: r.text for r in figures.spans_in_box(spans, boxes).collect()} == {7: "in", 8: ""}
    images = spark.createDataFrame([("d", 1, x, p) for p, x in enumerate((5, 5, 6))], "doc_id string, page_number int, xref int, pos int")
    masks = spark.createDataFrame([("d", 1, 6)], "doc_id string, page_number int, xref int")
    assert [(r.xref, r.pos) for r in figures.distinct_natives(images, masks).collect()] == [(5, 0)]
