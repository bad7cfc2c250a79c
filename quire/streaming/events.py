"""The progress-event log as streams.

The log is arrival-ordered and keyed by job: (job_id, seq, ts, event, payload). Any Spark source that gives these columns will do. A durable log has no slow
subscribers to drop events for, so no reader loses any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.store import FINAL_JOBS, TRANSITIONS

SCHEMA = "job_id string, seq long, ts timestamp, event string, payload string"
KEPT, IDLE_SECONDS = 1000, 20


def subscribe(spark: SparkSession, path: str, schema: str = SCHEMA, per_trigger: int = 1000) -> DataFrame:
    """A stream over an append-only folder of event files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def publish(events: DataFrame, path: str) -> None:
    """Appends events to the log; every subscriber reads them on its own."""
    events.write.mode("append").parquet(path)


def replay(events: DataFrame, keys: list[str], kept: int = KEPT, order: str = "seq") -> DataFrame:
    """Batch: the last ``kept`` events of each key. The rank limit is applied before the shuffle too, so a busy key moves ``kept`` rows a partition at most."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return events.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= kept).drop("_n")


def replay_stream(events: DataFrame, kept: int = KEPT) -> DataFrame:
    """Stream: after each trigger the bounded buffer of every job that got events, oldest first, as one row (job_id, first_seq, last_seq, payloads)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, payloads = (list(x) for x in state.get) if state.exists else ([], [])
        new = pd.concat(list(frames)).sort_values("seq")
        seqs, payloads = (seqs + new["seq"].tolist())[-kept:], (payloads + new["payload"].tolist())[-kept:]
        state.update((seqs, payloads))
        yield pd.DataFrame({"job_id": [key[0]], "first_seq": [seqs[0]], "last_seq": [seqs[-1]], "payloads": [payloads]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string, first_seq long, last_seq long, payloads array<string>", "seqs array<long>, payloads array<string>", "update", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (job_id, seq) once: what a reader who reconnects sees. On a stream the memory is bounded by the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "seq"])
    return events.dropDuplicates(["job_id", "seq"])


def idle_gaps(events: DataFrame, keys: list[str], seconds: int = IDLE_SECONDS, time: str = "ts", order: str = "seq") -> DataFrame:
    """Batch: pauses of more than ``seconds`` between a key's events, which a live reader sees as pings."""
    following = F.lead(time).over(Window.partitionBy(*keys).orderBy(time, order))
    return events.select(*keys, F.col(time).alias("from_ts"), following.alias("to_ts")).where(F.timestamp_diff("MICROSECOND", "from_ts", "to_ts") > seconds * 1_000_000)


def heartbeats(events: DataFrame, seconds: int = IDLE_SECONDS) -> DataFrame:
    """Stream: the events' jobs, and a ping for each job that is idle for ``seconds`` of processing time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0]
            state.setTimeoutDuration(seconds * 1000)
            yield pd.DataFrame({"job_id": [key[0]], "event": ["ping"], "n": [n]})
            return
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({"job_id": [key[0]], "event": ["events"], "n": [n]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string, event string, n long", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def audited(events: DataFrame) -> DataFrame:
    """Stream: every status change (payload of stage_changed events) with the status before it and whether the step is allowed; an illegal one doesn't move the job."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "queued"
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            legal = row.payload in TRANSITIONS.get(now, ()) or (row.payload == "cancelled" and now not in FINAL_JOBS)
            out.append((key[0], row.seq, now, row.payload, legal))
            now = row.payload if legal else now
        state.update((now,))
        yield pd.DataFrame(out, columns=["job_id", "seq", "before", "status", "legal"])

    changes = events.where(F.col("event") == "stage_changed").select("job_id", "seq", "payload")
    return changes.groupBy("job_id").applyInPandasWithState(step, "job_id string, seq long, before string, status string, legal boolean", "status string", "append", GroupStateTimeout.NoTimeout)


def page_states(events: DataFrame) -> DataFrame:
    """The last status of each page, from page_update events with payload {"page": n, "status": s}; batch or stream (update mode)."""
    own = F.from_json("payload", "page int, status string")
    updates = events.where(F.col("event") == "page_update").select("job_id", "seq", own.alias("p")).select("job_id", F.col("p.page").alias("page"), "seq", F.col("p.status").alias("status"))
    return updates.groupBy("job_id", "page").agg(F.max_by("status", "seq").alias("status"))


def checkpoint_sink(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands over non-empty batches; ``write`` names its output by the batch's number, so a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            if not held.isEmpty():
                write(held, number)
        finally:
            held.unpersist()

    return each


def ext_windowed_counts(events: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Extension: events by kind in tumbling event-time windows, late ones up to ``delay``; batch or stream."""
    own = events.withWatermark("ts", delay) if events.isStreaming else events
    return own.groupBy(F.window("ts", width).alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")
