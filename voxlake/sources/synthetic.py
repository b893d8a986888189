"""Volumes that are made, and conversions between the long and the blocked form."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sinusoid(spark: SparkSession, nx: int = 64, ny: int = 128, nz: int = 32, amplitude: float = 255.0, period: float = 32.0, direction: tuple[float, float, float] = (0.5, -0.5, 1 / sqrt(2)), image_id: int = 1) -> DataFrame:
    """The default volume: amplitude * cos(2 pi / period * direction . (x, y, z)), x fastest, as voxel rows. It is generated by the executors."""
    i = F.col("id")
    x, y, z = (i % nx), (F.floor(i / nx) % ny), F.floor(i / (nx * ny))
    at = F.lit(direction[0]) * F.col("x") + F.lit(direction[1]) * F.col("y") + F.lit(direction[2]) * F.col("z")
    cells = spark.range(nx * ny * nz).select(F.lit(image_id).cast("long").alias("image_id"), x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z"))
    return cells.withColumn("v", F.lit(amplitude) * F.cos(F.lit(2 * pi / period) * at))


def raster(df: DataFrame, key: str, array: str) -> DataFrame:
    """An array column as a 2-D raster: key, pos, v."""
    return df.select(F.col(key), F.posexplode(array).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def to_bricks(voxels: DataFrame) -> DataFrame:
    """One row a plane: image_id, z, data in the order of y, then x. A plane's samples meet in one task, whatever the number of planes."""
    cell = F.struct("y", "x", "v")
    return voxels.groupBy("image_id", "z").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["v"]).alias("data"))


def to_voxels(bricks: DataFrame, nx: int) -> DataFrame:
    """The samples of bricks whose rows have nx samples, counted from index 0."""
    out = bricks.select("image_id", "z", F.posexplode("data").alias("i", "v"))
    return out.select("image_id", (F.col("i") % nx).cast("int").alias("x"), F.floor(F.col("i") / nx).cast("int").alias("y"), "z", "v")


def write_voxels(voxels: DataFrame, path: str, partitions: int) -> None:
    """Voxels in ranges of image, z, y and x and sorted, so that row-group statistics prune slices and boxes."""
    order = ["image_id", "z", "y", "x"]
    voxels.repartitionByRange(partitions, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def loadable(volumes: DataFrame) -> DataFrame:
    """Headers of volumes with more than one sample along each axis."""
    e = F.col("extent")
    return volumes.where((e["x1"] > e["x0"]) & (e["y1"] > e["y0"]) & (e["z1"] > e["z0"]))


def or_default(spark: SparkSession, volumes: DataFrame, voxels: DataFrame) -> DataFrame:
    """The voxels of loadable volumes; the default volume if there is none."""
    good = loadable(volumes)
    return sinusoid(spark) if good.isEmpty() else voxels.join(good.select("image_id"), "image_id", "left_semi")
