import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from voxlake.streaming import events as ev
from voxlake.streaming import stateful


@pytest.fixture
def source(spark, tmp_path):
    """Events in time order, in files that a stream reads one by one."""
    e = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    for i, part in enumerate(sorted((tmp_path / "in").glob("part-*"))):  # files are taken by their time of change
        os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return e, stream, str(tmp_path)


def drained(spark, df, name, path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def same(a, b):
    key = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert key(a) == key(b)
    return True


def test_stateful_forms_equal_batch(spark, source):
    batch, stream, path = source
    w = ["ts", "event_id"]
    # one file may hold later events than the next only if ranges overlap; they don't
    got = drained(spark, stateful.baseline_stream(stream), "baseline", path)
    assert same(got, ev.baseline_retained(batch, ["user_id"], "value", w).select("user_id", "event_id", "value", "baseline"))
    got = drained(spark, stateful.dedupe_stream(stream), "dedupe", path)
    assert same(got, ev.dedupe_consecutive(batch, ["user_id"], ["value"], w).select("user_id", "event_id", "value"))
    got = drained(spark, stateful.combine_latest_stream(stream, ("click", "view", "purchase")), "combined", path)
    want = ev.combine_latest(batch, ["user_id"], {"click": "x", "view": "y", "purchase": "z"}, "value", w, "event_type")
    assert same(got, want.select("user_id", "event_id", "x", "y", "z"))


def test_nulls_keep_what_was_latest(spark, tmp_path):
    """Null values, several files and keys: the stream tells what the batch does."""
    rows = [(1, 1, 0, "click", 5.0), (2, 1, 1, "click", None), (3, 1, 2, "view", 7.0), (4, 2, 3, "view", None), (5, 1, 4, "click", None), (6, 2, 5, "view", 1.0), (7, 1, 6, "click", 2.0), (8, 2, 7, "buy", None), (9, 2, 8, "view", None), (10, 2, 9, "view", None)]
    batch = spark.createDataFrame(rows, "event_id long, user_id long, s long, event_type string, value double").select("event_id", "user_id", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "event_type", "value")
    for i, (a, b) in enumerate(((0, 3), (3, 6), (6, 9))):
        part = batch.where(F.unix_seconds("ts").between(1000 + a, 1000 + (b - 1 if b < 9 else 9))).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*"):
            if f.stat().st_mtime > 1_700_001_000:
                os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    w = ["ts", "event_id"]
    got = drained(spark, stateful.combine_latest_stream(stream, ("click", "view")), "nulls_combined", str(tmp_path))
    assert same(got, ev.combine_latest(batch, ["user_id"], {"click": "x", "view": "y"}, "value", w, "event_type").select("user_id", "event_id", "x", "y"))
    got = drained(spark, stateful.dedupe_stream(stream), "nulls_dedupe", str(tmp_path))
    assert same(got, ev.dedupe_consecutive(batch, ["user_id"], ["value"], w).select("user_id", "event_id", "value"))
    got = drained(spark, stateful.baseline_stream(stream), "nulls_baseline", str(tmp_path))
    assert same(got, ev.baseline_retained(batch, ["user_id"], "value", w).select("user_id", "event_id", "value", "baseline"))


class Held:
    """A key's state as the operators see it."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms


def test_state_expires_and_late_events_are_dropped():
    seen = {}

    class Grouped:
        def withWatermark(self, *_):
            return self

        def groupBy(self, key):
            return self

        def applyInPandasWithState(self, run, *more):
            seen["run"], seen["timeout"] = run, more[-1]

    stateful.baseline_stream(Grouped(), expire=1234)
    frame = lambda *rows: [pd.DataFrame([(i, pd.Timestamp(t, unit="s"), v) for i, t, v in rows], columns=["event_id", "ts", "value"])]
    tell = lambda held, *rows: [tuple(r) for out in seen["run"]((7,), iter(frame(*rows)), held) for r in out.itertuples(index=False)]
    held = Held()
    assert tell(held, (2, 20, 5.0), (1, 10, 4.0)) == [(7, 1, 4.0, 4.0), (7, 2, 5.0, 4.0)] and held.timeout == 20_000 + 1234
    assert tell(held, (3, 15, 9.0), (2, 20, 5.0), (4, 30, 6.0)) == [(7, 4, 6.0, 4.0)]
    held.hasTimedOut = True
    assert tell(held) == [] and held.value is None
    held.hasTimedOut = False
    assert tell(held, (5, 99, 8.0)) == [(7, 5, 8.0, 8.0)]


def test_fanout_and_selection_streams(spark, source):
    batch, stream, path = source
    view = F.when(F.col("event_id") % 2 == 0, "XY").otherwise("VOLUME")
    got = drained(spark, stateful.fanout_stream(stream, view, ("VOLUME", "YZ", "XY")).select("event_id", "target"), "fanout", path)
    assert same(got, ev.fanout_except_source(batch, view, ("VOLUME", "YZ", "XY")).select("event_id", "target"))
    got = drained(spark, stateful.exclusive_selection_stream(stream), "selected", path, "complete")
    assert same(got, ev.exclusive_selection(batch, ["user_id"], "event_type", ["ts", "event_id"]))


def test_debounced_stream_tells_closed_bursts_only(spark, source):
    """All bursts that the watermark has passed, and no other."""
    batch, stream, path = source
    got = {r.event_id for r in drained(spark, stateful.debounce_stream(stream, "user_id", "1 hour", "0 seconds"), "quiet", path).collect()}
    end = batch.agg(F.max("ts")).first()[0]
    want = ev.debounce(batch, ["user_id"], 3600).where(F.col("ts") + F.expr("INTERVAL 1 HOUR") <= F.lit(end))
    assert got == {r.event_id for r in want.collect()}
