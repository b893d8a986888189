"""Selection and compositing on the blocked layout.

Blocks are chosen by predicates on their ranges and zone maps, which reach the scan; those chosen are cut with ``slice``, so no sample
becomes a row before the result is asked for as samples.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import AXES, PLANE_AXES, U16_MAX
from . import mapping


def crop(blocks: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Blocks cut to inclusive index ranges by axis ('x', 'y', 'z'). Only blocks that meet the box are read. Zone maps stay those of the whole blocks."""
    for a, (lo, hi) in bounds.items():
        blocks = blocks.where((F.col(f"{a}0") <= hi) & (F.col(f"{a}1") >= lo))
    lo = {a: F.greatest(F.col(f"{a}0"), F.lit(bounds[a][0])) if a in bounds else F.col(f"{a}0") for a in AXES}
    hi = {a: F.least(F.col(f"{a}1"), F.lit(bounds[a][1])) if a in bounds else F.col(f"{a}1") for a in AXES}
    nx, ny = (F.col(f"{a}1") - F.col(f"{a}0") + 1 for a in "xy")

    def row(y: Column, z: Column) -> Column:
        return F.slice("data", ((z - F.col("z0")) * ny + y - F.col("y0")) * nx + lo["x"] - F.col("x0") + 1, hi["x"] - lo["x"] + 1)

    cut = F.flatten(F.transform(F.sequence(lo["z"], hi["z"]), lambda z: F.flatten(F.transform(F.sequence(lo["y"], hi["y"]), lambda y: row(y, z)))))
    every = lambda tests: reduce(Column.__and__, tests, F.lit(True))
    inside = every((F.col(f"{a}0") >= b[0]) & (F.col(f"{a}1") <= b[1]) for a, b in bounds.items())
    meets = every(lo[a] <= hi[a] for a in bounds)  # Spark may look at the data before it drops a row
    ends = [c.alias(f"{a}{i}") for a in AXES for i, c in ((0, lo[a]), (1, hi[a]))]
    # the data first: in one select, the ranges in its lambdas would be taken for the new ones
    return blocks.withColumn("data", F.when(inside, F.col("data")).when(meets, cut)).select("image_id", "key", *ends, "vmin", "vmax", "data")


def slice_plane(blocks: DataFrame, orientation: str, index: int) -> DataFrame:
    """The tiles of an orthogonal plane: image_id, u0, u1, v0, v1, data (u fastest)."""
    u, v, w = (AXES[i] for i in PLANE_AXES[orientation])
    return crop(blocks, {w: (index, index)}).select("image_id", *(F.col(f"{a}{i}").alias(f"{n}{i}") for n, a in (("u", u), ("v", v)) for i in (0, 1)), "data")


def plane_samples(tiles: DataFrame) -> DataFrame:
    """The samples of tiles: image_id, u, v, value."""
    nu = F.col("u1") - F.col("u0") + 1
    return tiles.select("*", F.posexplode("data").alias("i", "value")).select("image_id", (F.col("u0") + F.col("i") % nu).alias("u"), (F.col("v0") + F.floor(F.col("i") / nu)).cast("int").alias("v"), "value")


def samples(blocks: DataFrame) -> DataFrame:
    """The samples of blocks: image_id, x, y, z, v."""
    nx, ny = (F.col(f"{a}1") - F.col(f"{a}0") + 1 for a in "xy")
    i = F.col("i")
    at = [F.col("x0") + i % nx, F.col("y0") + F.floor(i / nx) % ny, F.col("z0") + F.floor(i / nx / ny)]
    return blocks.select("*", F.posexplode("data").alias("i", "v")).select("image_id", *(c.cast("int").alias(a) for c, a in zip(at, AXES, strict=True)), "v")


def valued_between(blocks: DataFrame, lo: float, hi: float) -> DataFrame:
    """The samples with values from lo to hi (inclusive). Blocks whose zone map excludes them are not read, and samples are dropped before they become rows."""
    return _hits(blocks.where((F.col("vmin") <= hi) & (F.col("vmax") >= lo)), lambda v: v.between(lo, hi))


def mapped_between(blocks: DataFrame, lo: int, hi: int, shift: float, scale: float) -> DataFrame:
    """The samples whose 16-bit mapped value is from lo to hi, as a range of native values, which the zone map prunes by. At the ends of the domain it holds what saturates there."""
    low, high = lo / scale - shift, (hi + 1) / scale - shift
    if lo > 0:
        blocks = blocks.where(F.col("vmax") >= low)
    if hi < U16_MAX:
        blocks = blocks.where(F.col("vmin") < high)
    return _hits(blocks, lambda v: mapping.mapped_between(v, lo, hi, shift, scale))


def _hits(blocks: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    nx, ny = (F.col(f"{a}1") - F.col(f"{a}0") + 1 for a in "xy")
    numbered = F.transform("data", lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    hits = blocks.select("*", F.explode(F.filter(numbered, lambda s: test(s["v"]))).alias("s"))
    i = F.col("s.i")
    at = [F.col("x0") + i % nx, F.col("y0") + F.floor(i / nx) % ny, F.col("z0") + F.floor(i / nx / ny)]
    return hits.select("image_id", *(c.cast("int").alias(a) for c, a in zip(at, AXES, strict=True)), F.col("s.v").alias("v"))


def ranges(blocks: DataFrame, *keys: str) -> DataFrame:
    """vmin and vmax by ``keys`` from zone maps alone; 0 and 1 where there is no finite value."""
    return blocks.groupBy(*keys).agg(F.coalesce(F.min("vmin"), F.lit(0.0)).alias("vmin"), F.coalesce(F.max("vmax"), F.lit(1.0)).alias("vmax"))


def composite(
    blocks: DataFrame,
    opacity: Sequence[tuple[float, float]],
    colours: Sequence[tuple[float, ...]],
    axis: str = "z",
    channels: Sequence[str] = ("colour",),
    step_over_unit: float = 1.0,
) -> DataFrame:
    """Front-to-back compositing of rays along an axis: image_id, the two other axes, a column for each channel, and opacity.

    ``opacity`` are nodes (value, opacity), ``colours`` nodes (value, a number for each channel); both are linear between nodes and constant outside. An
    opacity is that of one unit distance; a step is ``step_over_unit`` of it, so what a step lets through is the unit's clearness to that
    power. "Over" is associative: a block becomes one (colour, clearness) pair for each of its rays, and pairs are merged in the order of
    blocks, so a block is one row of the shuffle and no ray's samples are gathered. Samples that aren't numbers are clear.
    """
    import numpy as np
    import pyarrow as pa

    u, v = (a for a in AXES if a != axis)
    place = [f"{u}0", f"{u}1", f"{v}0", f"{v}1"]
    nodes, shades = np.asarray(opacity, dtype=float), np.asarray(colours, dtype=float)
    lists = [f"{c} array<double>" for c in (*channels, "clear")]
    schema = "image_id long, " + ", ".join(f"{p} int" for p in place) + f", {axis}0 int, " + ", ".join(lists)

    def over(o: np.ndarray, c: list[np.ndarray]) -> list[np.ndarray]:
        """Samples along the first axis to (colour of each channel, clearness)."""
        clear = np.cumprod(1 - o, axis=0)
        before = np.concatenate([np.ones((1, *o.shape[1:])), clear[:-1]])
        return [*((before * o * x).sum(axis=0) for x in c), clear[-1]]

    def reduce_block(batches):
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                r = {n: batch.column(n)[i].as_py() for n in ("image_id", *(f"{a}{k}" for a in AXES for k in (0, 1)))}
                grid = batch.column("data")[i].values.to_numpy(zero_copy_only=False).reshape([r[f"{a}1"] - r[f"{a}0"] + 1 for a in "zyx"])
                grid = np.moveaxis(grid, 2 - AXES.index(axis), 0)  # then v, u
                known = np.isfinite(grid)
                value = np.where(known, grid, 0)
                o = np.where(known, 1 - (1 - np.clip(np.interp(value, nodes[:, 0], nodes[:, 1]), 0, 1)) ** step_over_unit, 0)
                done = over(o, [np.interp(value, shades[:, 0], shades[:, k + 1]) for k in range(len(channels))])
                rows.append([r["image_id"], *(r[p] for p in place), r[f"{axis}0"], *(x.reshape(-1) for x in done)])
            if rows:
                kinds = [pa.int64(), *[pa.int32()] * 5, *[pa.list_(pa.float64())] * (len(channels) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*(["image_id", *place, f"{axis}0"]), *channels, "clear"])

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by(f"{axis}0")
        grid = {c: np.stack([x.values.to_numpy() for x in group.column(c)]) for c in (*channels, "clear")}
        before = np.concatenate([np.ones((1, grid["clear"].shape[1])), np.cumprod(grid["clear"], axis=0)[:-1]])
        first = {p: group.column(p)[0].as_py() for p in ("image_id", *place)}
        nu = first[f"{u}1"] - first[f"{u}0"] + 1
        at = np.arange(grid["clear"].shape[1])
        out = [pa.array(np.full(len(at), first["image_id"], np.int64)), pa.array((first[f"{u}0"] + at % nu).astype(np.int32)), pa.array((first[f"{v}0"] + at // nu).astype(np.int32))]
        return pa.Table.from_arrays([*out, *(pa.array((before * grid[c]).sum(axis=0)) for c in channels), pa.array(1 - np.prod(grid["clear"], axis=0))], ["image_id", u, v, *channels, "opacity"])

    parts = blocks.select("image_id", *(f"{a}{i}" for a in AXES for i in (0, 1)), "data").mapInArrow(reduce_block, schema)
    return parts.groupBy("image_id", *place).applyInArrow(merge, f"image_id long, {u} int, {v} int, " + ", ".join(f"{c} double" for c in channels) + ", opacity double")
