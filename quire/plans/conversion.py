"""Conversion of many documents at once.

What a page needs of others is only the text of the pages before it. So references (native text or recognition) are made for all pages in one parallel stage, and
transcription runs in waves: a wave takes the first open page of every job, each with its context, and appends their checkpoints. Between waves the job
control is asked; a crash loses one page a job at most, and a run picks up where the store ends.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import spec
from quire.functions import text as X
from quire.operators import assembly, envelope, gating, store
from quire.plans.resilience import Outcome, resilient
from quire.sources import schemas
from quire.sources.settings import Settings, options, overridden
from quire.streaming.control import Admission, Control


@dataclass(frozen=True)
class Reply:
    raw: str
    prompt_tokens: int = 0
    completion_tokens: int = 0


@dataclass(frozen=True)
class Models:
    """Injected calls; they must pickle. ``recognise(job, page, dpi)`` gives text and may raise, ``transcribe`` and ``verify`` take (job, page, reference or candidate, context, outline, dpi) and give a Reply."""

    transcribe: Callable[..., Reply]
    verify: Callable[..., Reply]
    recognise: Callable[[str, int, int], str] | None = None
    sleep: Callable[[float], None] = field(default=time.sleep)


def recognised(models: Models, job: str, page: int, dpi: int, native: str) -> tuple[str, int, Outcome]:
    """Text of a page down the ladder of resolutions: a timeout or a degenerate text tries the next, an outage pauses, and when all fail the native text stands in."""
    last = Outcome(error="no recognition")
    for step in spec.ladder(dpi):
        last = resilient(lambda: models.recognise(job, page, step), sleep=models.sleep, name="ocr")  # noqa: B023
        if last.error is None and not spec.degenerate(last.value):
            return last.value, step, last
        if last.paused and last.kind != "timeout":
            return "", step, last
        if last.error is None:
            last = Outcome(error="degenerate recognition")
        models.sleep(1.0)
    return (native, 72, Outcome(native)) if native.strip() else ("", dpi, Outcome(error=last.error))


REFERENCE = "job_id string, page_number int, text string, reference_kind string, reference string, dpi int, error string, paused boolean"


def references(pages: DataFrame, settings: Settings, models: Models) -> DataFrame:
    """Reference of every page (job_id, page_number, text). Pages with viable native text are split off first, so recognition is never called for them."""
    viable = X.native_viable(F.col("text"), settings.native_text_min_words) & F.lit(settings.native_text_first)
    constant = lambda kind, text: [F.lit(kind).alias("reference_kind"), text.alias("reference"), F.lit(settings.render_dpi).alias("dpi"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("paused")]
    base = ["job_id", F.col("page_number").cast("int").alias("page_number"), "text"]
    native = pages.where(viable).select(*base, *constant("native", F.col("text")))
    rest = pages.where(~viable).select(*base)
    if not settings.ocr_enabled or models.recognise is None:
        return native.union(rest.select("*", *constant("vision", F.lit(""))))

    def recognise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                text, dpi, outcome = recognised(models, r.job_id, r.page_number, settings.render_dpi, r.text or "")
                out.append((r.job_id, r.page_number, r.text, "ocr", text, dpi, outcome.error, outcome.paused))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REFERENCE.split(", ")])

    return native.union(rest.mapInPandas(recognise, REFERENCE))


def page_attempts(row, settings: Settings, models: Models) -> list[dict]:
    """All attempts at one page, up to the first that passes. Envelopes are asked for again once within an attempt, with what was wrong."""
    note, dpi, reference, out = "", row.dpi, row.reference, []
    for attempt in range(settings.max_page_retries + 1):
        if attempt:
            dpi = min(400, dpi + 100)
            if row.reference_kind == "ocr" and models.recognise:
                reference, dpi, again = recognised(models, row.job_id, row.page_number, dpi, row.text or "")
                if again.error:
                    return [*out, {"attempt": attempt, "dpi": dpi, "envelope_error": again.error, "paused": again.paused}]
        began, own = time.perf_counter(), {"attempt": attempt, "dpi": dpi, "reference": reference, "prompt_tokens": 0, "completion_tokens": 0, "misses": [], "paused": False}
        out.append(own)
        context, parsed = (row.context + note).strip(), {"error": "no reply"}
        for _ in range(envelope.MOST_ATTEMPTS):
            asked = time.perf_counter()
            got = resilient(lambda: models.transcribe(row.job_id, row.page_number, reference, context, row.outline, dpi), sleep=models.sleep, name="transcribe")  # noqa: B023
            own["transcribe_ms"] = own.get("transcribe_ms", 0.0) + (time.perf_counter() - asked) * 1000
            if got.error:
                return [*out[:-1], own | {"envelope_error": got.error, "paused": got.paused}]
            parsed = envelope.attempted(envelope.transcription, got.value.raw)
            own["raw"] = got.value.raw
            if parsed["error"] is None:
                own["prompt_tokens"] += got.value.prompt_tokens
                own["completion_tokens"] += got.value.completion_tokens
                break
            context = (context + "\n\nThe response was malformed: " + parsed["error"]).strip()
        own["envelope_error"] = parsed["error"]
        if parsed["error"] is None:
            own |= {"markdown": parsed["markdown"], "figures": json.dumps(parsed["figures"]), "notes": parsed["notes"]}
            asked = time.perf_counter()
            got = resilient(lambda: models.verify(row.job_id, row.page_number, own["markdown"], reference, row.outline, dpi), sleep=models.sleep, name="verify")  # noqa: B023
            own["verify_ms"] = (time.perf_counter() - asked) * 1000
            if got.error:
                return [*out[:-1], own | {"envelope_error": got.error, "paused": got.paused}]
            own["prompt_tokens"] += got.value.prompt_tokens
            own["completion_tokens"] += got.value.completion_tokens
            judged = envelope.attempted(envelope.verdict, got.value.raw)
            if judged["error"]:
                judged = {"coverage": 0, "verdict": "retry", "misses": ["unparseable verdict"]}
            score = spec.recall(reference, own["markdown"], settings.coverage_floor_min_tokens)
            failure = spec.floor_failure(score, settings.coverage_floor)
            own |= {"coverage": judged["coverage"], "verdict": judged["verdict"], "misses": judged["misses"], "floor_score": score}
            if judged["verdict"] == "pass" and judged["coverage"] >= settings.coverage_threshold and failure is None:
                own["ms"] = (time.perf_counter() - began) * 1000
                return out
            note = f"\n\nThe coverage floor FAILED ({failure}). Transcribe the COMPLETE page again, word for word." if failure else f"\n\nMisses to fix: {judged['misses']}"
        else:
            note = f"\n\nThe previous attempt was malformed ({parsed['error']}); send it again with care."
        own["ms"] = (time.perf_counter() - began) * 1000
    return out


def attempts(frontier: DataFrame, settings: Settings, models: Models) -> DataFrame:
    """The attempt table of a wave of pages (job_id, page_number, text, reference_kind, reference, dpi, context, outline)."""
    columns = [c.split()[0] for c in schemas.ATTEMPTS.replace("\n", " ").split(", ")] + ["paused"]

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"job_id": r.job_id, "page_number": r.page_number, "reference_kind": r.reference_kind} | a for r in frame.itertuples() for a in page_attempts(r, settings, models)]
            out = pd.DataFrame(rows, columns=columns)
            for c in ("prompt_tokens", "completion_tokens"):
                out[c] = out[c].fillna(0).astype("int64")
            out["coverage"] = out["coverage"].astype("Int32")
            yield out.astype({"paused": bool})

    return frontier.mapInPandas(call, schemas.ATTEMPTS + ", paused boolean")


@dataclass
class Summary:
    reason: str  # completed, paused or cancelled
    waves: int
    error: str | None = None


def run(spark: SparkSession, path: str, pages: DataFrame, models: Models, settings: Settings | None = None, control: Control | None = None) -> Summary:
    """Converts all pages (job_id, page_number, text) to final checkpoints in ``path``/checkpoints; attempts are kept in ``path``/attempts. A second run goes on where the first ended."""
    settings, control = settings or Settings(), control or Control("transcribing")
    stored = f"{path}/references"
    if not _exists(spark, stored):
        references(pages, settings, models).write.mode("overwrite").parquet(stored)
    held = spark.read.parquet(stored)
    jobs = held.groupBy("job_id").agg(F.max("page_number").alias("page_count"))
    bad = held.where("error is not null").select("paused", "error").first()
    if bad is not None:
        return Summary("paused" if bad["paused"] else "failed", 0, bad["error"])
    wave = 0
    while True:
        if control.cancel_requested:
            return Summary("cancelled", wave)
        if control.paused:
            return Summary("paused", wave)
        now = spark.read.parquet(f"{path}/checkpoints") if _exists(spark, f"{path}/checkpoints") else spark.createDataFrame([], CHECKPOINT)
        now = store.latest(now, ["job_id", "page_number"])
        open_ = store.resume_points(jobs, now).where("page_number is not null")
        before = now.where(store.is_final(F.col("status"))).select(F.col("job_id").alias("doc_id"), "page_number", F.col("markdown").alias("text"))
        marks = open_.select(F.col("job_id").alias("doc_id"), "page_number")
        context = assembly.frontier_context(before, marks, settings.rolling_context_pages).withColumnRenamed("doc_id", "job_id")
        frontier = held.join(context, ["job_id", "page_number"])
        tried = f"{path}/attempts/wave={int(time.time() * 1e6)}"
        attempts(frontier.repartition("job_id"), settings, models).write.mode("overwrite").parquet(tried)
        got = spark.read.parquet(tried)
        if got.isEmpty():
            return Summary("completed", wave)
        stopped = got.where("paused").select("envelope_error").first()
        done = got.join(got.where("paused").select("job_id").distinct(), "job_id", "left_anti")
        reduced = gating.reduced(done, settings.coverage_threshold, settings.coverage_floor)
        reduced = reduced.withColumn("model", F.lit(settings.agent_model)).withColumn("effort", F.lit(settings.thinking_transcribe)).withColumn("version", F.unix_micros(F.current_timestamp()))
        store.append(store.admitted(now, reduced, ["job_id", "page_number"]), f"{path}/checkpoints")
        wave += 1
        if stopped is not None:
            return Summary("paused", wave, stopped["envelope_error"])


CHECKPOINT = "job_id string, page_number int, status string, render_dpi int, reference_kind string, markdown string, coverage_score int, retries int, needs_review boolean, floor_score double, notes string, figures string, token_usage struct<prompt:bigint,completion:bigint>, ms double, transcribe_ms double, verify_ms double, reference_hash string, markdown_hash string, model string, effort string, version bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def documents(spark: SparkSession, path: str, settings: Settings | None = None) -> DataFrame:
    """(job_id, document): the finished pages of a store without running furniture, joined, with contents."""
    settings = settings or Settings()
    now = store.latest(spark.read.parquet(f"{path}/checkpoints"), ["job_id", "page_number"])
    pages = now.select(F.col("job_id").alias("doc_id"), "page_number", F.col("markdown").alias("text"))
    clean = assembly.without_furniture(pages, assembly.furniture_similar(pages))
    return assembly.joined_pages(clean).select(F.col("doc_id").alias("job_id"), assembly.assembled(F.col("document"), settings.toc_enabled).alias("document"))


class Conflict(RuntimeError):
    """A job that can't be restarted as it is."""


def restart(spark: SparkSession, path: str, job_id: str, pages: DataFrame, models: Models, admission: Admission) -> Summary:
    """Goes on with a job that ended early, on its checkpoints and with the options of its own snapshot (JSON in the jobs log). One job runs at a time."""
    job = store.latest(spark.read.parquet(f"{path}/jobs"), ["job_id"]).where(F.col("job_id") == job_id).first()
    if job is None:
        raise KeyError(f"unknown job {job_id}")
    if job["status"] == "completed":
        raise Conflict(f"already completed: {job_id}")
    own = pages.where(F.col("job_id") == job_id)
    if own.isEmpty():
        raise Conflict(f"nothing to resume: {job_id}")
    if not admission.admit(job_id):
        raise Conflict("another job is running")
    try:
        settings = overridden(Settings(), options(job["options"]))
        store.append(store.status_rows(store.latest(spark.read.parquet(f"{path}/jobs"), ["job_id"]), job_id, "transcribing", "restart"), f"{path}/jobs")
        got = run(spark, f"{path}/{job_id}", own, models, settings)
        status = {"completed": "assembling"}.get(got.reason, got.reason)
        store.append(store.status_rows(store.latest(spark.read.parquet(f"{path}/jobs"), ["job_id"]), job_id, status, None), f"{path}/jobs")
        return got
    finally:
        admission.release(job_id)


def ablation(spark: SparkSession, path: str, pages: DataFrame, models: Models, arms: dict[str, Settings]) -> DataFrame:
    """Runs every arm over all jobs into a store of its own and returns the manifest (arm, reason, waves, seconds)."""
    rows = []
    for name, settings in arms.items():
        began = time.perf_counter()
        got = run(spark, f"{path}/{name}", pages, models, settings)
        rows.append((name, got.reason, got.waves, time.perf_counter() - began))
    manifest = spark.createDataFrame(rows, "arm string, reason string, waves int, seconds double")
    store.append(manifest, f"{path}/manifest")
    return manifest
