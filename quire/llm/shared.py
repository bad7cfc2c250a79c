"""Tables that a job writes and reads again: they cut lineage and survive lost executors."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

#: Folders of this machine, by application: of local sessions that name none.
_local: dict[str, str] = {}
#: Scratch folders opened inside ``swept``, innermost last.
_watched: list[list[Scratch]] = []


def _on(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder that goes when its JVM ends; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        path, system = _on(spark, _local[app])
        system.deleteOnExit(path)
    return _local[app]


def fitted(rows: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """Runs ``fit`` over a bounded sample in one task and brings its result alone to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else empty
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table))], pa.binary())], names=["model"])

    empty = to_arrow_schema(rows.schema).empty_table()
    got = rows.repartition(1).mapInArrow(work, "model binary").first()
    return pickle.loads(got["model"]) if got else fit(empty)


class Scratch:
    """Parquet tables in a folder of their own under the shared folder.

    An operator drops the tables that its result doesn't read. The rest goes with ``remove``, at the end of a ``with`` block or of ``swept``, when the result is
    written; else when the application's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{folder(spark)}/{uuid.uuid4().hex}"
        path, system = _on(spark, self.root)
        system.deleteOnExit(path)
        if _watched:
            _watched[-1].append(self)

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that nothing will read any more; names that weren't saved don't matter."""
        for name in names:
            path, system = _on(self.spark, f"{self.root}/{name}")
            system.delete(path, True)

    def remove(self) -> None:
        path, system = _on(self.spark, self.root)
        system.delete(path, True)
        system.cancelDeleteOnExit(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.remove()


@contextmanager
def swept() -> Iterator[None]:
    """Removes the scratch folders that operators open inside, at the end: by then their results must be written."""
    _watched.append([])
    try:
        yield
    finally:
        for scratch in _watched.pop():
            scratch.remove()
