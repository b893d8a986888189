"""The blocked layout of volumes: bricks cut along all three axes, in the order of a space-filling key, with a zone map.

A block row has its index range along each axis, the least and greatest finite value, and its samples with x fastest. A table of blocks is
dealt by image and key and sorted, so blocks that are close in space lie in the same files and row groups: predicates on the ranges and
on the values prune whole files and row groups along any axis, and the columns of ranges and values can be read without a sample.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import is_finite

#: Samples of a block along each axis.
EDGE = (32, 32, 32)
BLOCK = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("key", T.LongType()),
        *(T.StructField(f"{a}{i}", T.IntegerType()) for a in "xyz" for i in (0, 1)),
        T.StructField("vmin", T.DoubleType()),
        T.StructField("vmax", T.DoubleType()),
        T.StructField("data", T.ArrayType(T.DoubleType())),
    ]
)
#: Bits of a block index in the key.
KEY_BITS = 21


def space_filling_key(x: Column, y: Column, z: Column) -> Column:
    """Block indices (their ``KEY_BITS`` lowest bits) with bits interleaved, x lowest."""
    bit = lambda c, i, at: F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1)), at)
    return reduce(Column.bitwiseOR, (bit(c, i, 3 * i + k) for i in range(KEY_BITS) for k, c in enumerate((x, y, z))))


def from_planes(planes: DataFrame, nx: Column | int, edge: tuple[int, int, int] = EDGE) -> DataFrame:
    """Blocks of brick rows (image_id, z, data) whose rows have ``nx`` samples, with x and y counted from 0.

    Each plane is cut into tiles by ``slice``, and the tiles of a block meet in one task: samples travel once, in arrays. A volume whose planes
    are repeated or missing within a block is an error. Empty planes give no block.
    """
    ex, ey, ez = edge
    nx = F.lit(nx) if isinstance(nx, int) else nx
    p = planes.where(F.size("data") > 0).select("image_id", "z", "data", nx.cast("int").alias("nx")).withColumn("ny", F.floor(F.size("data") / F.col("nx")).cast("int"))

    def tile(bx: Column, by: Column) -> Column:
        rows = F.sequence(by * ey, F.least(by * ey + ey, F.col("ny")) - 1)
        width = F.least(F.lit(ex), F.col("nx") - bx * ex)
        return F.struct(bx.alias("bx"), by.alias("by"), width.alias("width"), F.flatten(F.transform(rows, lambda y: F.slice("data", y * F.col("nx") + bx * ex + 1, width))).alias("data"))

    across = lambda n, e: F.sequence(F.lit(0), F.floor((F.col(n) - 1) / e).cast("int"))
    tiles = F.flatten(F.transform(across("ny", ey), lambda by: F.transform(across("nx", ex), lambda bx: tile(bx, by))))
    cut = p.select("image_id", "z", F.explode(tiles).alias("t")).select("image_id", "z", "t.*").withColumn("bz", F.floor(F.col("z") / ez).cast("int"))
    whole = cut.groupBy("image_id", "bx", "by", "bz").agg(F.array_sort(F.collect_list(F.struct("z", "data"))).alias("tiles"), F.max("width").alias("width"))
    first, last, n = F.get("tiles", F.lit(0))["z"], F.element_at("tiles", -1)["z"], F.size("tiles")
    data = F.when(last - first + 1 == n, F.flatten(F.transform("tiles", lambda t: t["data"]))).otherwise(F.raise_error(F.lit("a block has missing or repeated planes")).cast("array<double>"))
    out = whole.select("image_id", "bx", "by", "bz", "width", first.cast("int").alias("z0"), last.cast("int").alias("z1"), n.alias("nz"), data.cast("array<double>").alias("data"))
    finite = F.filter("data", is_finite)
    return out.select(
        F.col("image_id").cast("long").alias("image_id"),
        space_filling_key(F.col("bx"), F.col("by"), F.col("bz")).alias("key"),
        (F.col("bx") * ex).alias("x0"),
        (F.col("bx") * ex + F.col("width") - 1).alias("x1"),
        (F.col("by") * ey).alias("y0"),
        (F.col("by") * ey + (F.size("data") / F.col("nz") / F.col("width")).cast("int") - 1).alias("y1"),
        "z0",
        "z1",
        F.array_min(finite).alias("vmin"),
        F.array_max(finite).alias("vmax"),
        "data",
    )


def write(blocks: DataFrame, path: str, partitions: int, row_group_bytes: int | None = None) -> None:
    """Blocks in ranges of image and key, and sorted, so that statistics of files and row groups prune along every axis."""
    order = ["image_id", "key"]
    out = blocks.repartitionByRange(partitions, *order).sortWithinPartitions(*order).write
    (out.option("parquet.block.size", row_group_bytes) if row_group_bytes else out).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(path)
