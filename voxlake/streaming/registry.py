"""The window/level bus: a registry of frames, and edits told to all live frames that show the same image.

A frame is registered by an event that names its image and link mode. It is out when it is unregistered, or when nothing is heard of
it for ``expire`` seconds; registering again renews it, with its image and mode as they are now, and never makes it two. In the batch form registrations become intervals of
validity; on a stream the registry is a small table that every trigger reads, joins and writes anew.

Rows are ``event_id``, ``ts``, ``frame``, ``kind`` ('register', 'unregister' or 'edit'), ``image_id``, ``link_mode``, and for edits ``window`` and ``level``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scan

#: Seconds after which a frame of which nothing is heard is dropped.
EXPIRE = 24 * 3600
#: Edits of an image that are looked up together. A block of the next tier is FAN blocks of the one before, and there are TIERS.
BLOCK_EDITS, FAN, TIERS = 128, 4, 4
#: Frames of a block that are told together, and edits to a task of the join, about.
TOGETHER, TASK_EDITS = 256, 4096
_END, _EDIT, _FROM = range(3)
_FRAME = "frame long, image_id long, link_mode string, ts timestamp, event_id long"


def intervals(control: DataFrame, expire: int = EXPIRE) -> DataFrame:
    """frame, image_id, link_mode, from, until, end: a row for each registration, valid after the event ``from`` (time and id), before the event ``until``, and before the time ``end``."""
    c = control.where(F.col("kind").isin("register", "unregister"))
    then = F.lead(F.struct("ts", "event_id")).over(Window.partitionBy("frame").orderBy("ts", "event_id"))
    rows = c.withColumn("until", then).where("kind = 'register'")
    return rows.select("frame", "image_id", "link_mode", F.struct("ts", "event_id").alias("from"), "until", (F.col("ts") + F.make_dt_interval(secs=F.lit(expire))).alias("end"))


def broadcast(events: DataFrame, valid: DataFrame, expire: int = EXPIRE, block_edits: int = BLOCK_EDITS) -> DataFrame:
    """Each edit once for its own frame and every other frame of its image that is registered at that moment: event_id, target, window, level.

    An edit whose mode is Disabled is told to none; a frame whose mode is Disabled is told nothing of others. An edit without an image stays
    its own. The edits of an image are numbered in their order, and an interval holds those of one run of numbers. Edits and intervals meet by image and
    block of numbers. A run is cut into the largest blocks that it holds whole, of ``block_edits``, FAN times as many and so on, and at most two blocks of ``block_edits`` that hold edits that aren't told to it:
    all pairs looked at are those told and twice ``block_edits`` an interval, and an interval of many edits has few pieces.
    The frames of a block are put in lists of TOGETHER, and all its edits are told to one list before the next. There may be far more rows told than events; told so, those of an edit
    follow each other, and the same frames come again with each edit, so that files by columns hold a row in a fraction of a byte.
    Intervals without any edit of their image meet none. (``expire`` is in the ends of the intervals already.)
    """
    edits = events.where((F.col("kind") == "edit") & (F.coalesce("link_mode", F.lit("Disabled")) != "Disabled"))
    told = _numbered(edits, valid)
    # an edit's number counts itself; a registration's and an end's are those of the edits before
    in_tiers = F.array(*(F.struct(F.lit(tier).alias("tier"), F.floor((F.col("n") - 1) / size).alias("block")) for tier, size in _tiers(block_edits)))
    at = told.where(F.col("mark") == _EDIT).select("image_id", "n", "event_id", "frame", "window", "level", F.inline(in_tiers))
    runs = told.where(F.col("mark") != _EDIT).groupBy("image_id", F.col("frame").alias("target"), "from").agg(*(F.max(F.when(F.col("mark") == mark, F.col("n"))).alias(name) for mark, name in ((_FROM, "after"), (_END, "upto"))))
    ranges = runs.where("upto > after").select("image_id", "target", "after", "upto", F.inline(_pieces(F.col("after"), F.col("upto"), block_edits))).where("first < past")
    pieces = ranges.select("image_id", "target", "after", "upto", "tier", F.explode(F.sequence("first", F.col("past") - 1)).alias("block"))
    # few bytes may make very many rows, so that the number of tasks isn't left to bytes; a task of few blocks has few frames and edits, which its file then keeps in dictionaries
    spark, met = events.sparkSession, ["image_id", "tier", "block"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, edits.count() // TASK_EDITS)
    at, pieces = (x.repartition(tasks, *met) for x in (at, pieces))
    # frames that are told of the whole block come first, then those with alike ends
    size = F.lit(block_edits) * F.pow(F.lit(FAN), "tier").cast("long")
    pieces = pieces.withColumns({"after": F.greatest("after", F.col("block") * size), "upto": F.least("upto", (F.col("block") + 1) * size)})
    nth = F.row_number().over(Window.partitionBy(*met).orderBy("after", F.desc("upto"), "target"))
    lists = pieces.withColumns({"cut": F.col("upto") - F.col("after") < size, "list": F.floor((nth - 1) / TOGETHER)}).groupBy(*met, "list").agg(F.max("cut").alias("cut"), F.collect_list(F.struct("target", "after", "upto")).alias("of"))
    lists = lists.select(*met, "cut", "of.target", *(F.when(F.col("cut"), F.col(f"of.{x}")).alias(x) for x in ("after", "upto")))
    # the coalesce, to the tasks that there are, parts the join from the lists' rows: in one step, Spark holds all rows of a list and all its edits before it hands on the first
    pairs = lists.join(at.hint("merge"), met).select("event_id", "n", "frame", "window", "level", "cut", "after", "upto", "target").coalesce(tasks)
    pairs = pairs.select("event_id", "n", "frame", "window", "level", "cut", "after", "upto", F.posexplode("target").alias("i", "target"))
    heard = ~F.col("cut") | ((F.col("n") > F.get("after", F.col("i"))) & (F.col("n") <= F.get("upto", F.col("i"))))
    peers = pairs.where((F.col("target") != F.col("frame")) & heard)
    return edits.select("event_id", F.col("frame").alias("target"), "window", "level").unionByName(peers.select("event_id", "target", "window", "level"))


def _tiers(block_edits: int) -> list[tuple[int, int]]:
    """Each tier with the edits of its blocks."""
    return [(tier, block_edits * FAN**tier) for tier in range(TIERS)]


def _pieces(after: Column, upto: Column, block_edits: int) -> Column:
    """The blocks whose edits together are those numbered over ``after`` and up to ``upto``, as ranges ``first`` to ``past`` of a tier, some empty: whole ones of the highest tier that has them, and of the lowest those cut by an end."""
    whole = lambda size: (F.ceil(after / size), F.floor(upto / size))
    first, past = whole(block_edits)
    ranges = [(0, F.floor(after / block_edits), first), (0, F.greatest(first, past), F.floor((upto - 1) / block_edits) + 1)]
    for tier, size in _tiers(block_edits):
        (first, past), (up, down) = whole(size), whole(size * FAN)
        higher = (up < down) if tier < TIERS - 1 else F.lit(False)
        ranges += [(tier, first, F.when(higher, up * FAN).otherwise(past)), (tier, F.when(higher, down * FAN).otherwise(past), past)]
    return F.array(*(F.struct(F.lit(tier).alias("tier"), first.alias("first"), past.alias("past")) for tier, first, past in ranges))


def _numbered(edits: DataFrame, valid: DataFrame) -> DataFrame:
    """Edits, and the first and last moments of intervals, each with the number ``n`` of its image's edits up to it. Of the same moment, an end comes before an edit, and an edit before a registration."""
    moment = lambda ts, event_id, mark: (ts.alias("ts"), event_id.alias("event_id"), F.lit(mark).alias("mark"))
    start, until, end = F.col("from"), F.col("until"), F.col("end")
    open_ = valid.where("link_mode != 'Disabled' AND image_id IS NOT NULL AND frame IS NOT NULL AND from.ts IS NOT NULL")
    timed = until.isNull() | (until["ts"] >= end)  # nothing of the time ``end`` is told: a null id comes before all others
    rows = edits.where("image_id IS NOT NULL AND ts IS NOT NULL").select("image_id", *moment(F.col("ts"), F.col("event_id"), _EDIT), "frame", "window", "level")
    for m in (moment(start["ts"], start["event_id"], _FROM), moment(F.when(timed, end).otherwise(until["ts"]), F.when(~timed, until["event_id"]), _END)):
        rows = rows.unionByName(open_.select("image_id", *m, "frame", "from"), allowMissingColumns=True)
    return scan.scanned(rows, ["image_id"], ["ts", "event_id", "mark"], {"n": scan.total((F.col("mark") == _EDIT).cast("int"))})


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The whole versions of the registry in a folder, in order."""
    at, fs = _fs(spark, folder)
    if not fs.exists(at):
        return []
    names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(at)]
    return sorted(int(n[2:]) for n, p in names if n.startswith("v=") and fs.exists(_fs(spark, f"{p}/_SUCCESS")[0]))


def live(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The registry as the last trigger (or the last before a given one) left it: frame, image_id, link_mode, and ts and event_id of its last registration."""
    found = [v for v in _versions(spark, folder) if before is None or v < before]
    return spark.read.schema(_FRAME).parquet(f"{folder}/v={found[-1]}") if found else spark.createDataFrame([], _FRAME)


def on_trigger(registry: str, told: str, expire: int = EXPIRE) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` runs: edits of a trigger are joined to the registry, with the trigger's own registrations in their order, and told; then the registry is upserted.

    Both go to folders named by the trigger (``told``/trigger=n, ``registry``/v=n), and the registry before it is read by number, so that a trigger that runs again after a failure
    writes the same once more. Rows of a trigger are taken in order; rows that come triggers late meet the registry as it is then.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = live(spark, registry, n).withColumn("kind", F.lit("register"))
        rows = batch.persist()
        try:
            control = rows.select(*before.columns).where(F.col("kind").isin("register", "unregister")).unionByName(before)
            broadcast(rows, intervals(control, expire), expire).write.mode("overwrite").parquet(f"{told}/trigger={n}")
            last = control.groupBy("frame").agg(F.max_by(F.struct("kind", "image_id", "link_mode", "ts", "event_id"), F.struct("ts", "event_id")).alias("r")).select("frame", "r.*")
            now = rows.agg(F.max("ts")).first()[0]
            kept = last.where("kind = 'register'")
            if now is not None:
                kept = kept.where(F.col("ts") + F.make_dt_interval(secs=F.lit(expire)) > F.lit(now))
            kept.select(*(x.split()[0] for x in _FRAME.split(", "))).coalesce(1).write.mode("overwrite").parquet(f"{registry}/v={n}")
        finally:
            rows.unpersist()
        for v in [v for v in _versions(spark, registry) if v < n - 1]:
            at, fs = _fs(spark, f"{registry}/v={v}")
            fs.delete(at, True)

    return run
