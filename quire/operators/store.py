"""The job store as append-only tables: checkpoints, events, images, jobs.

Every change is a new row with a higher ``version``; the current state is a view. A page that is verified or needs review is final until it is
invalidated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
JOB_STATUSES = ("queued", "preflight", "rendering", "ocr", "transcribing", "assembling", "qa", "paused", "completed", "failed", "cancelled")
PAGE_STATUSES = ("pending", "ocr", "transcribed", "verified", "needs_review", "failed")
FINAL_PAGES = ("verified", "needs_review")
FINAL_JOBS = ("completed", "failed", "cancelled")
TRANSITIONS = {
    "queued": ("preflight", "paused", "cancelled"),
    "preflight": ("rendering", "failed", "cancelled"),
    "rendering": ("ocr", "paused", "failed", "cancelled"),
    "ocr": ("transcribing", "paused", "failed", "cancelled"),
    "transcribing": ("assembling", "paused", "failed", "cancelled"),
    "assembling": ("completed", "paused", "failed", "cancelled"),
    "qa": ("completed", "paused", "failed", "cancelled"),
    "paused": ("queued", "preflight", "rendering", "ocr", "transcribing", "assembling", "cancelled"),
}
HISTORY = 50


def latest(log: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The row of the highest version of each key; a grouped maximum, so no key's rows are gathered or sorted."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*").select(*log.columns)


def is_final(status: Column) -> Column:
    return status.isin(*FINAL_PAGES)


def admitted(log: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new checkpoints that may be appended: not those of pages that are final now."""
    return new.join(latest(log, keys).where(is_final(F.col("status"))).select(*keys), keys, "left_anti")


def invalidation(log: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append that reopen pages: the current row with status pending and the next version."""
    now = latest(log, keys).join(targets.select(*keys).distinct(), keys, "left_semi")
    out = now.withColumn("status", F.lit("pending")).withColumn("version", F.col("version") + 1)
    return out.withColumn("needs_review", F.lit(False)) if "needs_review" in log.columns else out


def resume_points(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """(job_id, page_number): the smallest page of 1..page_count that isn't final, null if all are. ``pages`` is the current view."""
    expected = jobs.select("job_id", F.explode(F.sequence(F.lit(1), F.greatest("page_count", F.lit(1)))).alias("page_number"), "page_count").where("page_number <= page_count")
    open_ = expected.join(pages.where(is_final(F.col("status"))).select("job_id", "page_number"), ["job_id", "page_number"], "left_anti")
    return jobs.select("job_id").join(open_.groupBy("job_id").agg(F.min("page_number").alias("page_number")), "job_id", "left")


def history(jobs: DataFrame, limit: int = HISTORY) -> DataFrame:
    """The newest jobs."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def incomplete(jobs: DataFrame, limit: int = HISTORY) -> DataFrame:
    """Of the newest jobs, those that haven't ended: the limit comes first."""
    return history(jobs, limit).where(~F.col("status").isin(*FINAL_JOBS))


def without_job(table: DataFrame, gone: DataFrame) -> DataFrame:
    """A child table without the rows of some jobs: a cascade, written back by the caller partition by partition."""
    return table.join(gone.select("job_id").distinct(), "job_id", "left_anti")


def transition_table(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "status string, next string")


def illegal_transitions(log: DataFrame, order: str = "seq") -> DataFrame:
    """Rows of a status log (job_id, seq, status) whose step from the row before isn't allowed. Cancelling is allowed from every status that isn't final."""
    steps = log.withColumn("before", F.lag("status").over(Window.partitionBy("job_id").orderBy(order))).where("before is not null and before <> status")
    allowed = transition_table(log.sparkSession)
    cancelled = (F.col("status") == "cancelled") & ~F.col("before").isin(*FINAL_JOBS)
    return steps.where(~cancelled).join(F.broadcast(allowed.select(F.col("status").alias("before"), F.col("next").alias("status"))), ["before", "status"], "left_anti").select("job_id", order, "before", "status")


def created(jobs: DataFrame) -> DataFrame:
    """Rows of new jobs (job_id, filename, page_count, and options as JSON and other columns as given): queued, not started, the first version."""
    never = F.lit(None).cast("timestamp")
    given = jobs if "options" in jobs.columns else jobs.withColumn("options", F.lit("{}"))
    return given.select("*", F.lit("queued").alias("status"), F.lit(None).cast("string").alias("stage"), F.current_timestamp().alias("created_at"), never.alias("started_at"), never.alias("finished_at"), F.lit(0).cast("long").alias("version"))


def status_rows(jobs: DataFrame, job_id: str, status: str, stage: str | None = None) -> DataFrame:
    """The row to append that gives a job of the current view a status: it starts when it first leaves the queue and is finished in a final status, until it goes on. An unknown job is a KeyError."""
    own = jobs.where(F.col("job_id") == job_id)
    if own.isEmpty():
        raise KeyError(f"unknown job {job_id}")
    now = F.current_timestamp()
    return (
        own.withColumn("status", F.lit(status))
        .withColumn("stage", F.lit(stage) if stage is not None else F.col("stage"))
        .withColumn("started_at", F.coalesce("started_at", now) if status != "queued" else F.col("started_at"))
        .withColumn("finished_at", now if status in FINAL_JOBS else F.lit(None).cast("timestamp"))
        .withColumn("version", F.col("version") + 1)
        .select(*jobs.columns)
    )


def job(jobs: DataFrame, job_id: str) -> DataFrame:
    """A job's row of the current view; none if it is unknown."""
    return jobs.where(F.col("job_id") == job_id)


def page_list(pages: DataFrame) -> DataFrame:
    """What a list of pages shows of the current view, in order within each job by the caller."""
    return pages.select("job_id", "page_number", "status", "coverage_score", "needs_review")


def append(table: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Appends rows to a store table, partitioned by ``keys``."""
    writer = table.write.mode("append")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def replace_job(table: DataFrame, path: str) -> None:
    """Overwrites the partitions of the jobs in ``table`` and no others: clearing and writing a job's rows is one idempotent step."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def logged(job_id: Column, level: Column, stage: Column, message: Column) -> list[Column]:
    """Columns of an event row; a level of more than 16 characters is an error."""
    checked = F.when(F.length(level) <= 16, level).otherwise(F.raise_error(F.concat(F.lit("level too long: "), level)))
    return [job_id.alias("job_id"), F.current_timestamp().alias("ts"), checked.alias("level"), stage.alias("stage"), message.alias("message")]
