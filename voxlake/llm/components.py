"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to the least node of its neighbourhood. Rows are as many as edges; no neighbourhood is gathered."""
    around = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    # written, so that it is dealt anew for the join, whose large keys Spark can then split
    least = stored(around.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least")), "least")
    joined = around.join(least, "src")
    moved = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")) if large else joined.select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionAll(least.select("src", F.col("least").alias("dst")))
    return moved.where("src != dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (src, dst: long): root is the component's least node. Loops and repeated edges do no harm; no edges give no rows."""
    now = stored(edges.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
    before = mark(now)
    for _ in range(ROUNDS):
        if not before[0]:
            break
        now = stored(_star(_star(now, True), False), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise ValueError(f"no end after {ROUNDS} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionAll(now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
