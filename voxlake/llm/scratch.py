"""Places for intermediate results that every executor can read."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..sources import shared

#: Bytes of an Arrow batch. Spark's own bound is 256 MB, of which a task holds several at once on either side.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, unless it has a bound of its own. Texts are handed to Python in these."""
    if spark.conf.get(_BATCH, "268435456").rstrip("bB") in ("268435456", "256m"):
        spark.conf.set(_BATCH, BATCH_BYTES)


#: What has been made by the run that is on, see ``run``; without one, by the session.
_made: ContextVar[list[str]] = ContextVar("made", default=[])  # noqa: B039 - one list for all that is outside a run


@contextmanager
def run() -> Iterator[None]:
    """Folders made inside are those of this run alone: ``mark`` and ``clear`` know of no other's, such as those of a run in another thread. What is left at the end becomes the surrounding run's."""
    outer, token = _made.get(), _made.set([])
    try:
        yield
    finally:
        left = _made.get()
        _made.reset(token)
        outer.extend(left)


def mark() -> int:
    """How many folders the run has made so far: what ``clear`` can go back to."""
    return len(_made.get())


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove what operators have written to the shared folder in this run, or since a mark, but for the last ``keep`` folders. Tables read from removed ones can't be read any more."""
    made = _made.get()
    for path in made[since : len(made) - keep]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del made[since : len(made) - keep]


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets; it is removed by ``clear``, or when the driver ends."""
    path = shared.new_dir(spark, name)
    _made.get().append(path)
    return path


#: Spark's own removal of a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds between two collections of the driver's garbage, at least: executors hold broadcast tables until the driver has collected what stands for them.
COLLECT_EVERY = 2.0
_collected = [0.0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage, lets several readers use one computation, and outlives the executors that made it. The shuffle files of the
    finished job are of no use any more, so Spark is told to remove them at its end; the session's own setting is as before afterwards.
    """
    spark = df.sparkSession
    path = f"{new_dir(spark, name)}/data"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    if time.monotonic() - _collected[0] > COLLECT_EVERY:
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)
