import datetime

import pytest
from pyspark.sql import functions as F

from quire.streaming import events as E
from quire.streaming.control import Admission, Control, IllegalTransition

T0 = datetime.datetime(2024, 1, 1)


def rows(*events):
    return [(j, s, T0 + datetime.timedelta(seconds=10 * s), e, p) for j, s, e, p in events]


@pytest.fixture
def log(spark, tmp_path):
    """Publishes batches; reads a stream of them to its end."""

    class Log:
        path = str(tmp_path / "log")
        n = 0

        def publish(self, *events):
            E.publish(spark.createDataFrame(rows(*events), E.SCHEMA), self.path)

        def read(self, make, mode="append"):
            Log.n += 1
            name = f"out{Log.n}"
            query = make(E.subscribe(spark, self.path)).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
            return spark.table(name).collect()

    return Log()


def test_replay_is_bounded(log, spark):
    log.publish(*[("j", i, "log", f"m{i}") for i in range(5)], ("k", 0, "log", "x"))
    got = {r.job_id: r.payloads for r in log.read(lambda s: E.replay_stream(s, 3), "update")}
    assert got == {"j": ["m2", "m3", "m4"], "k": ["x"]}
    batch = E.replay(spark.read.parquet(log.path), ["job_id"], 3)
    assert sorted((r.job_id, r.payload) for r in batch.collect()) == [("j", "m2"), ("j", "m3"), ("j", "m4"), ("k", "x")]


def test_duplicates(log):
    log.publish(("j", 1, "log", "a"), ("j", 2, "log", "b"))
    log.publish(("j", 2, "log", "b"), ("j", 3, "log", "c"))
    assert sorted(r.seq for r in log.read(E.deduplicated)) == [1, 2, 3]


def test_audit(log):
    log.publish(*[("j", i, "stage_changed", s) for i, s in enumerate(["preflight", "paused", "rendering", "completed", "cancelled", "queued"])])
    assert [r.legal for r in sorted(log.read(E.audited), key=lambda r: r.seq)] == [True, False, True, False, True, False]


def test_page_states(log):
    log.publish(("j", 1, "page_update", '{"page": 1, "status": "pending"}'), ("j", 2, "page_update", '{"page": 1, "status": "verified"}'), ("j", 3, "log", "x"))
    assert [(r.page, r.status) for r in log.read(E.page_states, "complete")] == [(1, "verified")]


def test_gaps_and_windows(log, spark):
    log.publish(("j", 1, "log", "a"), ("j", 2, "log", "b"), ("j", 9, "log", "c"))
    batch = spark.read.parquet(log.path)
    assert [(r.from_ts, r.to_ts) for r in E.idle_gaps(batch, ["job_id"], 20).collect()] == [(T0 + datetime.timedelta(seconds=20), T0 + datetime.timedelta(seconds=90))]
    assert E.ext_windowed_counts(batch, "1 minute").agg(F.sum("n")).first()[0] == 3


def test_checkpoint_sink(log, spark, tmp_path):
    log.publish(("j", 1, "log", "a"))
    out = str(tmp_path / "sink")
    sink = E.checkpoint_sink(lambda frame, n: frame.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    for _ in range(2):  # a repeated batch replaces itself
        sink(spark.read.parquet(log.path), 0)
    assert spark.read.parquet(out).count() == 1


def test_control():
    c = Control()
    with pytest.raises(IllegalTransition):
        c.transition("ocr")
    c.transition("preflight")
    with pytest.raises(IllegalTransition):
        c.pause()
    c.transition("rendering")
    c.pause()
    assert c.paused and c.status == "paused" and not c.wait(0.01)
    c.resume()
    assert c.status == "rendering" and c.wait(0.01)
    with pytest.raises(IllegalTransition):
        c.resume()
    c.cancel()
    assert c.cancel_requested
    with pytest.raises(IllegalTransition):
        c.cancel()
    a = Admission()
    assert a.admit("x") and not a.admit("y")
    a.release("x")
    assert a.admit("y")
