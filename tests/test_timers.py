import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from voxlake.streaming import events as ev
from voxlake.streaming import timers

WIDE, FAR = "event_id long, user_id long, ts timestamp, kind string, value double, view string, window double, level double, lo int, hi int, tracking boolean", 4_000_000_000


@pytest.fixture(scope="module")
def store(spark):
    before = spark.conf.get(timers._STORE)
    timers.use_rocksdb(spark)
    yield
    spark.conf.set(timers._STORE, before)


def files(batch, path, parts):
    """Rows in files, one a trigger; a last file moves the watermark past everything. ``parts`` says which file a row is in."""
    spark = batch.sparkSession
    last = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.timestamp_seconds(F.lit(FAR)).alias("ts"))
    rows = batch.withColumn("part", parts).unionByName(last.withColumn("part", F.lit(10**6)), allowMissingColumns=True)
    n = 0
    for (k,) in sorted(rows.select("part").distinct().collect()):
        rows.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
        new = [f for f in (os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-")) if os.path.getmtime(f) > 1_700_500_000]
        for f in new:
            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
        n += 1
    return lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, df, path, name="q"):
    q = df.writeStream.format("parquet").option("path", f"{path}/out-{name}").option("checkpointLocation", f"{path}/cp-{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out-{name}").where("user_id >= 0")


def same(a, b):
    key = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    got, want = key(a), key(b)
    assert got == want and got
    return True


#: A burst with a gate that closes in it; a change at the very moment of firing; a commit; changes behind the gate; a null; another key.
BURSTS = [
    (1, 1, 0, "window", 10.0), (2, 1, 20, "level", 5.0), (3, 1, 70, "window", 11.0), (4, 1, 75, "interactive", 0.0), (5, 1, 100, "level", 6.0),
    (6, 1, 200, "window", 12.0), (7, 1, 210, "commit", None), (8, 1, 220, "interactive", 1.0), (9, 1, 300, "level", 7.0), (10, 1, 360, "window", 13.0), (11, 1, 400, "window", None),
    (12, 2, 0, "window", 1.0), (13, 2, 500, "level", 2.0), (14, 2, 500, "level", 3.0), (15, 2, 559, "commit", None), (16, 1, 1000, "level", 8.0),
]
TOLD = [(1, 3, 130, "changed", 11.0, 6.0), (1, 7, 210, "committed", 12.0, 6.0), (1, 9, 360, "changed", 12.0, 7.0), (1, 10, 420, "changed", 13.0, 7.0), (1, 16, 1060, "changed", 13.0, 8.0), (2, 14, 560, "changed", 1.0, 3.0), (2, 15, 559, "committed", 1.0, 3.0)]


def bursts(spark):
    rows = spark.createDataFrame(BURSTS, "event_id long, user_id long, ms long, kind string, value double")
    return rows.select("event_id", "user_id", F.timestamp_millis(F.col("ms") + 1_000_000_000_000).alias("ts"), "kind", "value")


def test_controller_batch(spark):
    got = timers.controller(bursts(spark), "user_id").withColumn("ts", F.unix_millis("ts") - 1_000_000_000_000)
    assert sorted(map(tuple, got.collect())) == TOLD
    assert timers.controller(bursts(spark).where("user_id = 9"), "user_id").count() == 0


def test_controller_stream_equals_batch(spark, store, tmp_path):
    batch = bursts(spark)
    # file by file, with rows of a file older than rows of the one before it
    stream = files(batch, str(tmp_path / "in"), F.col("event_id") % 3 + F.floor(F.col("event_id") / 6) * 2)
    same(drained(spark, timers.controller_stream(stream(), "user_id", "1 second"), tmp_path), timers.controller(batch, "user_id"))


def test_controller_restarts_within_a_burst(spark, store, tmp_path):
    batch = bursts(spark)
    at = F.unix_millis("ts") - 1_000_000_000_000
    first, path = batch.where(at < 80), str(tmp_path / "in")
    n = F.floor(at / 25)
    stream = files(first, path, n)
    os.remove(max((os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-")), key=os.path.getmtime))  # no end yet
    df = lambda: timers.controller_stream(stream(), "user_id", "10 milliseconds")
    assert drained(spark, df(), tmp_path).count() == 0  # the timer is running when the query stops
    files(batch.where(at >= 80), path, n + 100)
    same(drained(spark, df(), tmp_path), timers.controller(batch, "user_id"))


@pytest.fixture(scope="module")
def events(spark):
    k = F.col("event_id") % 50
    kind = F.when(k.isin(0, 7), "link").when(k == 25, "unlink").otherwise("edit")
    view = F.get(F.array(*map(F.lit, ("VOLUME", "YZ", "XZ", "XY"))), (F.col("event_id") % 4).cast("int"))
    e = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"), view.alias("view"))
    return e.select("*", F.col("value").alias("window"), (-F.col("value")).alias("level"), (F.col("event_id") % 30).cast("int").alias("lo"), (F.col("event_id") % 17).cast("int").alias("hi"), (F.col("event_id") % 3 > 0).alias("tracking")).cache()


def shuffled(events):
    """Which file a row is in: by time, but every fifth row comes two files later than it should."""
    hour = F.unix_seconds("ts") / 3600
    return F.floor((hour - 473_000) / 100) + F.when(F.col("event_id") % 5 == 0, 2).otherwise(0)


def cases(e):
    w = ["ts", "event_id"]
    base = ev.baseline_retained(e, ["user_id", "view"], "value", w).select("user_id", "event_id", "view", "value", "baseline")
    link = ev.linked(e, ["user_id"], w).select("user_id", "event_id", "target", "shown_window", "shown_level")
    pos = ev.positions(e, ["user_id"], w, "lo", "hi", (2, 25), F.col("tracking"), (3, 9)).select("user_id", "event_id", "position_lo", "position_hi", "value_lo", "value_hi")
    return {
        "baselines": (base, lambda s, i: timers.baselines_stream(s, "user_id", "300 hours", i), lambda h: timers.baselines_after(h, "user_id")),
        "linked": (link, lambda s, i: timers.linked_stream(s, "user_id", "300 hours", i), lambda h: timers.linked_after(h, "user_id")),
        "positions": (pos, lambda s, i: timers.positions_stream(s, "user_id", (2, 25), (3, 9), "300 hours", i), lambda h: timers.positions_after(h, "user_id", (2, 25), (3, 9))),
    }


@pytest.mark.parametrize("name", ["baselines", "linked", "positions"])
def test_keyed_state_equals_batch_with_late_rows(spark, store, events, tmp_path, name):
    want, run, _ = cases(events)[name]
    stream = files(events, str(tmp_path / "in"), shuffled(events))
    same(drained(spark, run(stream(), None), tmp_path), want)


@pytest.mark.parametrize("name", ["baselines", "linked", "positions"])
def test_keyed_state_goes_on_from_the_batch(spark, store, events, tmp_path, name):
    """History in batch, the rest as a stream that is handed the batch's state: together what one batch gives."""
    want, run, after = cases(events)[name]
    half = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    history, rest = events.where(F.col("ts") <= half), events.where(F.col("ts") > half)
    after(history).write.parquet(str(tmp_path / "state"))
    stream = files(rest, str(tmp_path / "in"), shuffled(rest))
    got = drained(spark, run(stream(), spark.read.parquet(str(tmp_path / "state"))), tmp_path)
    same(got, want.join(rest.select("event_id"), "event_id", "left_semi").select(*want.columns))


def test_idle_state_goes(spark, store, tmp_path):
    rows = [(1, 1, 0, 5.0), (2, 1, 10, 6.0), (3, 2, 100, 1.0), (4, 1, 200, 7.0)]
    batch = spark.createDataFrame(rows, "event_id long, user_id long, s long, value double").select("event_id", "user_id", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"), F.lit("XY").alias("view"), "value")
    stream = files(batch, str(tmp_path / "in"), F.col("event_id"))
    got = {r.event_id: r.baseline for r in drained(spark, timers.baselines_stream(stream(), "user_id", "1 second", expire=60_000), tmp_path).collect()}
    assert got == {1: 5.0, 2: 5.0, 3: 1.0, 4: 7.0}
