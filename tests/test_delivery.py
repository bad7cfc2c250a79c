import json

import pytest
from pyspark.sql import functions as F

from quire.operators import store
from quire.plans import conversion, delivery
from quire.plans.conversion import Models, Reply
from quire.sources.settings import Settings
from quire.streaming.control import Admission

FIGURES = [
    {"index": 1, "bbox": [10, 10, 110, 60], "alt": "A flow", "caption": "Flow"},
    {"index": 2, "bbox": [10, 70, 110, 120], "alt": "A photo", "caption": None},
    {"index": 3, "bbox": [0, 0, 5000, 5000], "alt": "Outside", "caption": None},
    {"index": 4, "bbox": [20, 20, 40, 40], "alt": "Lost", "caption": "Never anchored"},
]


def transcribe(job, page, reference, context, outline, dpi):
    tokens = "<!--FIG:page:1:10,10,110,60-->\n\n<!--FIG:9:2:10,70,110,120-->" if page == 1 else "See $\\text{a\\_b}$."
    words = ["alpha and its kin", "something else entirely", "a last word"][page - 1]
    text = f"Running head\n\n{'## ' if page > 1 else '# '}Part {page} of {job}: {words}\n\n{reference}\n\n{tokens}\n\nIt ends with {words}, page {page * 7919}.\n\nRunning foot"
    held = json.dumps(FIGURES if page == 1 else [])
    return Reply(f"<<<MARKDOWN>>>\n{text}\n<<<END_MARKDOWN>>>\n<<<FIGURES>>>\n{held}\n<<<END_FIGURES>>>\n<<<FURNITURE>>>\n<<<END_FURNITURE>>>\n<<<NOTES>>>\nn\n<<<END_NOTES>>>", 7, 3)


def verify(job, page, markdown, reference, outline, dpi):
    return Reply('<<<VERDICT>>>\n{"coverage": 99, "verdict": "pass"}\n<<<END_VERDICT>>>', 1, 1)


def diagram(job, page, index, png, ground):
    assert png.startswith(b"cut") and (ground == "words in it" if index == 1 else True)
    if index == 4:
        return Reply("garbage")
    kind = "flowchart" if index == 1 else ""
    return Reply(f'<<<DIAGRAM>>>\n{{"convertible": {str(index == 1).lower()}, "type": "{kind}", "confidence": 90, "description": "d"}}\n<<<END_DIAGRAM>>>\n<<<MERMAID>>>\ngraph TD\n  A-->B\n<<<END_MERMAID>>>\n<<<DATA>>>\n<<<END_DATA>>>')


def check(job, page, index, png, ground, source):
    assert index == 1 and "A-->B" in source
    return Reply('<<<VERDICT>>>\n{"coverage": 97, "verdict": "pass"}\n<<<END_VERDICT>>>')


def crop(boxes):
    png = F.concat(F.lit("cut"), F.col("idx")).cast("binary")
    return boxes.select("doc_id", "page_number", "idx", F.when((F.col("x1") <= 1000) & (F.col("y1") <= 1000), png).alias("png"))


TOOLS = delivery.Tools(crop, diagram, check, formatter=lambda t: t.replace("Part", "Chapter"), linter=lambda t: ["long"] if len(t) > 10 else [])
MODELS = Models(transcribe, verify, sleep=lambda s: None)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    pages = spark.createDataFrame([(j, p, " ".join(f"{j}{p}w{k}" for k in range(40))) for j in ("a", "b") for p in (1, 2, 3)], "job_id string, page_number int, text string")
    assert conversion.run(spark, path, pages, MODELS).reason == "completed"
    return path


def jobs_of(spark, *ids):
    rows = store.created(spark.createDataFrame([(i, f"{i}.pdf", 3) for i in ids], "job_id string, filename string, page_count int"))
    return rows.withColumn("pipeline_version", F.lit("v1"))


@pytest.fixture(scope="module")
def natives(spark):
    return spark.createDataFrame([("a", 1, 0, "jpeg", bytearray(b"native"), 12.0, 70.0, 108.0, 119.0)], delivery.NATIVES), spark.createDataFrame([("a", 1, 0, "words in it", 20.0, 20.0, 30.0, 30.0), ("b", 1, 0, "words in it", 20.0, 20.0, 30.0, 30.0)], delivery.SPANS)


def test_to_the_deliverable(spark, stored, natives, tmp_path):
    judged = {r.job_id: r for r in delivery.deliver(spark, stored, jobs_of(spark, "a", "b"), *natives, TOOLS).collect()}
    assert not judged["a"].hard_fail and judged["a"].warnings == ["long"] and set(judged) == {"a", "b"}
    out = delivery.write(spark, stored, "a", "paper", str(tmp_path / "out"))
    text = out["document"].read_text()
    assert "<!--FIG" not in text and "Running" not in text and text.startswith("# Chapter 1 of a: alpha")
    assert "```mermaid\ngraph TD\n  A-->B\n```" in text and "![A photo](paper/assets/page-001-img-02.jpeg)" in text and "![A flow](paper/assets/page-001-img-01.png)" in text
    assert text.index("page-001-img-02") < text.index("page-001-img-04.png") < text.rindex("Chapter 2 of a") and "*Never anchored*" in text
    assert r"$\text{a}\rule[-0.05em]{0.35em}{0.5pt}\text{b}$" in text
    assert {p.name: p.read_bytes() for p in out["assets"].iterdir()} == {"page-001-img-01.png": b"cut0", "page-001-img-02.jpeg": b"native", "page-001-img-04.png": b"cut4"}
    report = out["report"].read_text()
    for line in ("- prompts: {'transcribe': 'v1'", "- models: agent=agent ocr=ocr", "- dpi: 200", "- converted to Mermaid: 1 (33%)", "index=3 alt='Outside' reason=bbox outside render; needs_review", "index=4 alt='Lost' reason=no placeholder token in markdown; appended at page end", "- 'Running head' (on 3 pages)", "model=agent effort=low transcribe_ms=", "- long"):
        assert line in report, line
    messages = {r.message for r in spark.read.parquet(f"{stored}/figure_events").where("job_id = 'a'").collect()}
    assert messages == {"page 1 figure 1: mermaid flowchart (confidence 97)", "page 1 figure 2: image fallback (agent reported not convertible)", "page 1 figure 3: image fallback (figure crop failed)", next(m for m in messages if "figure 4" in m)}
    assert any("malformed diagram envelope" in m for m in messages)
    with pytest.raises(KeyError):
        delivery.write(spark, stored, "zz", "paper", str(tmp_path / "out"))


def test_without_picture_and_without_models(spark, stored, natives):
    settings = Settings(diagram_keep_image=False)
    assert not any(r.hard_fail for r in delivery.deliver(spark, stored, jobs_of(spark, "a"), *natives, TOOLS, settings).collect())
    assert {r.file for r in spark.read.parquet(f"{stored}/assets").collect()} == {"page-001-img-02.jpeg", "page-001-img-04.png"}
    assert {r.image_id: r.asset_path for r in spark.read.parquet(f"{stored}/images").collect()}[1] == ""
    found = spark.createDataFrame([("b", 1, 1, "a", "c", 0.0, 0.0, 9.0, 9.0)], "doc_id string, page_number int, idx int, alt string, caption string, x0 double, y0 double, x1 double, y1 double")
    for tools, own in ((delivery.Tools(crop), Settings()), (TOOLS, Settings(diagram_to_mermaid=False))):
        assert [(r.convertible, r.reason, r.mermaid) for r in delivery.diagrams(found, crop(found), natives[1], tools, own).collect()] == [(False, "", None)]
    blind = delivery.Tools(lambda boxes: boxes.select("doc_id", "page_number", "idx", F.lit(None).cast("binary").alias("png")))
    got = delivery.deliver(spark, stored, jobs_of(spark, "b"), *natives, blind).first()
    assert got.hard_fail and len(got.reasons) == 2 and spark.read.parquet(f"{stored}/assets").count() == 0


def test_status_and_restart(spark, tmp_path):
    path = str(tmp_path)
    log = jobs_of(spark, "a", "b").withColumn("options", F.lit('{"max_page_retries": 0, "unknown": 1}'))
    store.append(log, f"{path}/jobs")
    now = lambda: store.latest(spark.read.parquet(f"{path}/jobs"), ["job_id"])
    with pytest.raises(KeyError):
        store.status_rows(now(), "zz", "ocr")
    store.append(store.status_rows(now(), "a", "failed", "ocr"), f"{path}/jobs")
    failed = store.job(now(), "a").first()
    assert (failed.status, failed.stage, failed.version) == ("failed", "ocr", 1) and failed.started_at and failed.finished_at
    pages = spark.createDataFrame([("a", p, " ".join(f"a{p}w{k}" for k in range(40))) for p in (1, 2)], "job_id string, page_number int, text string")
    admission = Admission()
    got = conversion.restart(spark, path, "a", pages, MODELS, admission)
    assert got.reason == "completed" and got.waves == 2
    after = store.job(now(), "a").first()
    assert (after.status, after.stage, after.started_at, after.finished_at) == ("assembling", "restart", failed.started_at, None)
    listed = store.page_list(spark.read.parquet(f"{path}/a/checkpoints")).collect()
    assert {(r.page_number, r.status, r.needs_review) for r in listed} == {(1, "verified", False), (2, "verified", False)}
    store.append(store.status_rows(now(), "a", "completed"), f"{path}/jobs")
    with pytest.raises(conversion.Conflict):
        conversion.restart(spark, path, "a", pages, MODELS, admission)
    with pytest.raises(conversion.Conflict):
        conversion.restart(spark, path, "b", pages, MODELS, admission)
    with pytest.raises(KeyError):
        conversion.restart(spark, path, "zz", pages, MODELS, admission)
    admission.admit("x")
    with pytest.raises(conversion.Conflict):
        conversion.restart(spark, path, "b", pages.withColumn("job_id", F.lit("b")), MODELS, admission)
