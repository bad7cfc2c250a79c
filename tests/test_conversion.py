import json

import pytest

from quire.plans import conversion
from quire.plans.conversion import Models, Reply
from quire.plans.fingerprint import DEFAULTS, fingerprint, options_rows
from quire.plans.resilience import CallFailed, delay, resilient, resolve_model
from quire.sources.settings import Settings
from quire.streaming.control import Control


def envelope(markdown):
    return f"<<<MARKDOWN>>>\n{markdown}\n<<<END_MARKDOWN>>>\n<<<FIGURES>>>\n<<<END_FIGURES>>>\n<<<FURNITURE>>>\n<<<END_FURNITURE>>>\n<<<NOTES>>>\n<<<END_NOTES>>>"


def verdict(coverage, word):
    return f"<<<VERDICT>>>\n{json.dumps({'coverage': coverage, 'verdict': word, 'misses': ['m']})}\n<<<END_VERDICT>>>"


def transcribe(job, page, reference, context, outline, dpi):
    """Echoes the reference with a heading; page 2 is malformed at first, page 3 leaves out most until 400 dpi."""
    if page == 2 and "malformed" not in context:
        return Reply("garbage")
    if job == "out" and page == 2:
        raise CallFailed("status", 503)
    text = reference if not (page == 3 and dpi < 400) else "too little"
    return Reply(envelope(f"## {job} {page}\n{text}\nseen: {len(outline.splitlines())} {context.count('## ')}"), 10, 5)


def verify(job, page, markdown, reference, outline, dpi):
    return Reply(verdict(60 if job == "low" else 97, "pass"), 1, 1)


MODELS = Models(transcribe, verify, sleep=lambda s: None)


def pages(spark, *jobs, n=4):
    words = lambda j, p: " ".join(f"{j}{p}w{k}" for k in range(40))
    return spark.createDataFrame([(j, p, words(j, p)) for j in jobs for p in range(1, n + 1)], "job_id string, page_number int, text string")


def checkpoints(spark, path):
    return {(r.job_id, r.page_number): r for r in spark.read.parquet(f"{path}/checkpoints").collect()}


def test_run_to_the_end(spark, tmp_path):
    path = str(tmp_path)
    got = conversion.run(spark, path, pages(spark, "a", "low"), MODELS)
    assert got.reason == "completed" and got.waves == 4
    held = checkpoints(spark, path)
    assert len(held) == 8
    assert all(held["a", p].status == "verified" for p in range(1, 5)) and all(held["low", p].status == "needs_review" for p in range(1, 5))
    assert (held["a", 3].retries, held["a", 3].render_dpi, held["a", 2].retries) == (2, 400, 0)
    assert held["a", 4].markdown.endswith("seen: 3 3") and held["a", 1].markdown.endswith("seen: 0 0")
    assert conversion.run(spark, path, pages(spark, "a", "low"), MODELS).waves == 0
    document = {r.job_id: r.document for r in conversion.documents(spark, path).collect()}["a"]
    assert document.startswith("# a 1\n\n## Table of Contents\n\n- [a 2](#a-2)") and document.count("# a ") == 4


def test_outage_pauses_and_a_second_run_goes_on(spark, tmp_path):
    path = str(tmp_path)
    own = pages(spark, "out", "b", n=2)
    got = conversion.run(spark, path, own, MODELS)
    assert got.reason == "paused" and "503" in got.error
    assert set(checkpoints(spark, path)) == {("out", 1), ("b", 1), ("b", 2)}
    calm = Models(lambda job, *rest: transcribe("x" + job, *rest), verify, sleep=lambda s: None)
    assert conversion.run(spark, path, own, calm).reason == "completed" and ("out", 2) in checkpoints(spark, path)


def test_cancelled(spark, tmp_path):
    control = Control("transcribing")
    control.cancel()
    assert conversion.run(spark, str(tmp_path), pages(spark, "a"), MODELS, control=control).reason == "cancelled"


def test_references(spark):
    frame = spark.createDataFrame([("j", 1, "w " * 30), ("j", 2, "few"), ("j", 3, "")], "job_id string, page_number int, text string")

    def recognise(job, page, dpi):
        return ("`" * 3 + "\n") * 40 if dpi > 80 else f"read {page} at {dpi}"

    models = Models(transcribe, verify, recognise, sleep=lambda s: None)
    got = {r.page_number: (r.reference_kind, r.reference[:11].strip() if r.reference_kind == "native" else r.reference, r.dpi) for r in conversion.references(frame, Settings(), models).collect()}
    assert got == {1: ("native", "w w w w w w", 200), 2: ("ocr", "read 2 at 80", 80), 3: ("ocr", "read 3 at 80", 80)}
    assert {r.reference_kind for r in conversion.references(frame, Settings(ocr_enabled=False), models).collect()} == {"native", "vision"}


def test_recognition_falls_back():
    def slow(job, page, dpi):
        raise TimeoutError

    text, dpi, outcome = conversion.recognised(Models(transcribe, verify, slow, sleep=lambda s: None), "j", 1, 200, "native")
    assert (text, dpi, outcome.error) == ("native", 72, None)

    def down(job, page, dpi):
        raise CallFailed("connect")

    assert conversion.recognised(Models(transcribe, verify, down, sleep=lambda s: None), "j", 1, 200, "native")[2].paused


@pytest.mark.parametrize(
    ("failures", "waits", "end"),
    [
        ([CallFailed("status", 500), CallFailed("status", 503)], [0.5, 1.0], "ok"),
        ([CallFailed("status", 429, "0.25")], [0.25], "ok"),
        ([CallFailed("status", 429, "soon")], [0.5], "ok"),
        ([CallFailed("status", 429, "900")], [120.0], "ok"),
        ([CallFailed("status", 500)] * 3, [0.5, 1.0], "paused"),
        ([CallFailed("status", 400)], [], "error"),
        ([CallFailed("connect"), TimeoutError()], [0.5, 1.0], "ok"),
        ([ValueError("x")], [], "error"),
    ],
)
def test_resilience(failures, waits, end):
    left, slept = list(failures), []

    def call():
        if left:
            raise left.pop(0)
        return "ok"

    got = resilient(call, base=0.5, sleep=slept.append)
    assert slept == waits and (got.value, got.paused, got.error is not None) == {"ok": ("ok", False, False), "paused": (None, True, True), "error": (None, False, True)}[end]
    assert delay(ValueError(), 1) is None


def test_models_and_fingerprints():
    assert resolve_model("m:cloud", ["m"]) == "m" and resolve_model("m", ["m", "m:cloud"]) == "m"
    with pytest.raises(ValueError):
        resolve_model("x", ["m"])
    every = [fingerprint(**{k: v for k, v in o.items() if v != DEFAULTS[k]}) for o in options_rows()]
    assert len(set(every)) == len(DEFAULTS) and every[0] == fingerprint()
    with pytest.raises(TypeError):
        fingerprint(unknown=1)


def test_ablation(spark, tmp_path):
    got = conversion.ablation(spark, str(tmp_path), pages(spark, "a", n=1), MODELS, {"with": Settings(), "without": Settings(ocr_enabled=False)})
    assert {(r.arm, r.reason) for r in got.collect()} == {("with", "completed"), ("without", "completed")}
    assert spark.read.parquet(f"{tmp_path}/manifest").count() == 2
