"""A small list that is kept between sessions: versions in a folder, and a pointer to the last.

A list is written whole as a version of its own, and only then does the pointer move to it, by a rename. So a list that is derived from the saved one can
be saved, a reader never meets half a list, and a save that fails leaves the old one. The version before the last stays, for those who are still reading it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import RECENT

POINTER = "CURRENT"


class Changed(RuntimeError):
    """Another session has saved meanwhile."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, folder: str) -> str | None:
    """The name of the saved version; none before the first save."""
    at, fs = _fs(spark, f"{folder}/{POINTER}")
    if not fs.exists(at):
        return None
    f = fs.open(at)
    try:
        return bytes(f.readAllBytes()).decode()
    finally:
        f.close()


def restore(spark: SparkSession, folder: str, schema: str = "path string, rank int") -> DataFrame:
    """The saved list; an empty one of the ``schema`` before the first save."""
    name = current(spark, folder)
    return spark.createDataFrame([], schema) if name is None else spark.read.parquet(f"{folder}/{name}")


_UNASKED = object()


def save(items: DataFrame, folder: str, expected: object = _UNASKED) -> str:
    """Keep ``items`` (a few rows) as the list; returns the version's name. With ``expected`` (a name, or none), a list that is no more that one is left, and ``Changed`` is raised."""
    spark, name = items.sparkSession, f"v-{uuid.uuid4().hex}"
    before = current(spark, folder)
    items.coalesce(1).write.parquet(f"{folder}/{name}")
    if expected is not _UNASKED and current(spark, folder) != expected:
        at, fs = _fs(spark, f"{folder}/{name}")
        fs.delete(at, True)
        raise Changed(f"{folder}: the list is no more {expected}")
    _point(spark, folder, name)
    at, fs = _fs(spark, folder)
    for x in fs.listStatus(at):
        if x.getPath().getName().startswith("v-") and x.getPath().getName() not in (name, before):
            fs.delete(x.getPath(), True)
    return name


def _point(spark: SparkSession, folder: str, name: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, fs = _fs(spark, f"{folder}/{POINTER}.{name}")
    f = fs.create(new, True)
    f.write(bytearray(name.encode()))
    f.close()
    to = fs.makeQualified(_fs(spark, f"{folder}/{POINTER}")[0])
    options = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(fs.makeQualified(new), to, how)


def merged(saved: DataFrame, opened: DataFrame, item: str, order: list[str], k: int = RECENT) -> DataFrame:
    """The list after items are opened: those opened last come first, each once, then the saved ones that weren't, in their order; the first k. Columns item, rank.

    Opened items are aggregated, and cut to k, before they meet the saved list, so a few rows are ranked.
    """
    from .events import mru_topk

    new = mru_topk(opened, [], item, order, k).select(item, F.struct(F.lit(0).alias("age"), F.col("rank").alias("at")).alias("_place"))
    old = saved.select(item, F.struct(F.lit(1).alias("age"), F.col("rank").cast("int").alias("at")).alias("_place"))
    both = new.unionByName(old).groupBy(item).agg(F.min("_place").alias("_place")).orderBy("_place").limit(k)
    ranks = both.agg(F.array_sort(F.collect_list(F.struct("_place", item))).alias("_list"))  # k rows
    return ranks.select(F.posexplode("_list").alias("_i", "_x")).select(F.col(f"_x.{item}").alias(item), (F.col("_i") + 1).alias("rank"))


def cleared(spark: SparkSession, folder: str) -> None:
    """An empty list, with the columns it has."""
    save(spark.createDataFrame([], restore(spark, folder).schema), folder)
