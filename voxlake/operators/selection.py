"""Slices, boxes and intervals. All are predicates or expressions on index columns, so they reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp
from ..model import AXES, PLANE_AXES


def slice_plane(voxels: DataFrame, orientation: str, index: int) -> DataFrame:
    """The samples of an orthogonal plane, with in-plane axes u and v: image_id, u, v, value."""
    u, v, w = (AXES[i] for i in PLANE_AXES[orientation])
    return voxels.where(F.col(w) == index).select("image_id", F.col(u).alias("u"), F.col(v).alias("v"), F.col("v").alias("value"))


def slice_range(voxels: DataFrame, orientation: str) -> DataFrame:
    """The valid slice indices of each image: image_id, lo, hi."""
    w = AXES[PLANE_AXES[orientation][2]]
    return voxels.groupBy("image_id").agg(F.min(w).alias("lo"), F.max(w).alias("hi"))


def crop_box(df: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows inside inclusive index ranges by column. No ranges: no crop."""
    return df.where(reduce(Column.__and__, (F.col(c).between(lo, hi) for c, (lo, hi) in bounds.items()))) if bounds else df


def crop_normalize(lo: Column, hi: Column, bound_lo: Column, bound_hi: Column) -> tuple[Column, Column]:
    """Bounds clamped to the extent, in order, and widened by one if they are equal: upwards, or downwards at the upper end."""
    a, b = interval_normalize(lo, hi, bound_lo, bound_hi)
    up, down = (a == b) & (b < bound_hi), (a == b) & (b >= bound_hi) & (a > bound_lo)
    return F.when(down, a - 1).otherwise(a), F.when(up, b + 1).otherwise(b)


def interval_normalize(lo: Column, hi: Column, bound_lo: Column, bound_hi: Column) -> tuple[Column, Column]:
    """An interval in order, inside its bounds."""
    a, b = clamp(lo, bound_lo, bound_hi), clamp(hi, bound_lo, bound_hi)
    return F.least(a, b), F.greatest(a, b)


def set_lower(lo: Column, hi: Column, new: Column, bound_lo: Column, bound_hi: Column) -> tuple[Column, Column]:
    """The interval with a new lower end, which pushes the upper one along; both inside the bounds."""
    return interval_normalize(new, F.greatest(hi, new), bound_lo, bound_hi)


def set_upper(lo: Column, hi: Column, new: Column, bound_lo: Column, bound_hi: Column) -> tuple[Column, Column]:
    return interval_normalize(F.least(lo, new), new, bound_lo, bound_hi)


def drag_lower(lo: Column, hi: Column, new: Column, bound_lo: Column, bound_hi: Column, symmetric: bool = False) -> tuple[Column, Column]:
    """The lower handle dragged, as far as the upper one; if symmetric, the upper one goes as far the other way. Each end stops at its bound."""
    at = F.least(new, hi)
    return interval_normalize(at, hi + lo - at if symmetric else hi, bound_lo, bound_hi)


def drag_upper(lo: Column, hi: Column, new: Column, bound_lo: Column, bound_hi: Column, symmetric: bool = False) -> tuple[Column, Column]:
    """The upper handle dragged, as far as the lower one; if symmetric, the lower one goes as far the other way."""
    at = F.greatest(lo, new)
    return interval_normalize(lo - (at - hi) if symmetric else lo, at, bound_lo, bound_hi)


def drag_both(lo: Column, hi: Column, delta: Column, bound_lo: Column, bound_hi: Column) -> tuple[Column, Column]:
    """The interval moved by delta: half its width on either side of its moved middle. Each end stops at its bound, so the interval shrinks there."""
    middle = F.floor((lo + hi) / 2).cast("int") + delta
    return interval_normalize(middle - F.floor((hi - lo) / 2).cast("int"), middle + F.ceil((hi - lo) / 2).cast("int"), bound_lo, bound_hi)


def nearest_handle(at: Column, lo: Column, hi: Column) -> Column:
    """Which end of an interval is nearer: 'lower', or 'upper' (also if both are)."""
    return F.when(F.abs(at - lo) < F.abs(at - hi), "lower").otherwise("upper")


def step(value: Column, by: Column, bound_lo: Column, bound_hi: Column) -> Column:
    """A key or wheel step, inside the bounds."""
    return clamp(value + by, bound_lo, bound_hi)


def rescale(x: Column, from_lo: Column, from_hi: Column, to_lo: Column, to_hi: Column) -> Column:
    """Pixel to value or back; an empty source range gives its lower end's image."""
    return F.when(from_hi == from_lo, to_lo).otherwise(to_lo + (x - from_lo) * (to_hi - to_lo) / (from_hi - from_lo))


def clamp_index(index: Column, lo: Column, hi: Column) -> Column:
    return clamp(index, lo, hi)


def three_planes(voxels: DataFrame, x: int, y: int, z: int, extent: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The three orthogonal planes through an index, tagged by orientation; samples on two of them come twice.

    With an extent (inclusive ranges by axis), indices outside it are taken to its ends. One scan: each sample is exploded to the planes it is on.
    """
    at = {"x": x, "y": y, "z": z}
    for axis, (lo, hi) in (extent or {}).items():
        at[axis] = min(max(at[axis], lo), hi)
    on = F.filter(F.array(*(F.when(F.col(a) == at[a], F.lit(p)) for p, a in (("YZ", "x"), ("XZ", "y"), ("XY", "z")))), lambda p: p.isNotNull())
    return voxels.where((F.col("x") == at["x"]) | (F.col("y") == at["y"]) | (F.col("z") == at["z"])).select(F.explode(on).alias("plane"), *voxels.columns)


def shown_mode(mode: Column, view: Column) -> Column:
    """The interpolation that a view shows: volumes have no cubic one and show linear."""
    return F.when((view == "VOLUME") & (mode == "Cubic"), "Linear").otherwise(mode)


def sampled(plane: DataFrame, position: float, axis: str, mode: str = "Linear") -> DataFrame:
    """A slice at a fractional position along ``axis`` (of voxel rows): nearest takes the rounded index, linear blends the two around it, cubic the four around it.

    Cubic is the convolution with the parameter -1/2. Planes that aren't there have no weight. Only the neighbouring planes are read.
    """
    from math import floor

    others = [a for a in AXES if a != axis]
    if mode == "Nearest":
        return plane.where(F.col(axis) == floor(position + 0.5)).select("image_id", *others, "v")
    lo = floor(position)
    t = position - lo
    if mode == "Cubic":
        parts = {lo - 1: -t / 2 + t**2 - t**3 / 2, lo: 1 - 2.5 * t**2 + 1.5 * t**3, lo + 1: t / 2 + 2 * t**2 - 1.5 * t**3, lo + 2: -(t**2) / 2 + t**3 / 2}
    else:
        parts = {lo: 1 - t, lo + 1: t}
    parts = {k: w for k, w in parts.items() if w}
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)), F.col(axis))
    return plane.where(F.col(axis).isin(*parts)).groupBy("image_id", *others).agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("v"))


#: Reach of each interpolation's kernel, in samples.
REACH = {"Nearest": 0.5, "Linear": 1.0, "Cubic": 2.0}


def kernel(mode: str, t: Column) -> Column:
    """The weight of a sample at a distance of t samples: nearest (a tie goes to the upper sample), linear, or the cubic convolution with the parameter -1/2."""
    if mode == "Nearest":
        return F.when((t > -0.5) & (t <= 0.5), 1.0).otherwise(0.0)
    d = F.abs(t)
    if mode == "Linear":
        return F.greatest(1.0 - d, F.lit(0.0))
    return F.when(d <= 1, (1.5 * d - 2.5) * d * d + 1.0).when(d < 2, ((-0.5 * d + 2.5) * d - 4.0) * d + 2.0).otherwise(0.0)


def scattered(rows: DataFrame, along: str, across: list[str], values: list[str], first: float | Column, step: float, pixels: int, mode: str) -> DataFrame:
    """``values`` summed at the pixels along one axis, each sample weighted by its kernel. A sample goes to the pixels in its reach only. ``first`` may differ by what ``across`` has.

    A pixel outside the samples by more than half of one gets nothing; ``_near`` says whether one was near enough.
    """
    at, first = F.col(along).cast("double"), first if isinstance(first, Column) else F.lit(first)
    lo, hi = ((at + sign * REACH[mode] - first) / step for sign in (-1, 1))
    # a touch wider than the reach, so that no rounding drops a pixel; weights are exact
    pixel = F.sequence(F.greatest(F.ceil(lo - 1e-9), F.lit(0)).cast("int"), F.least(F.floor(hi + 1e-9), F.lit(pixels - 1)).cast("int"))
    some = F.greatest(F.ceil(lo - 1e-9), F.lit(0)) <= F.least(F.floor(hi + 1e-9), F.lit(pixels - 1))
    t = first + F.col("_pixel") * step - at
    spread = rows.where(some).withColumn("_pixel", F.explode(F.when(some, pixel)))
    near = (t > -0.5 - 1e-9) & (t <= 0.5 + 1e-9)
    sums = [F.sum(kernel(mode, t) * F.col(v)).alias(v) for v in values]
    return spread.groupBy(*across, "_pixel").agg(*sums, F.max(near & F.col("_near")).alias("_near")).withColumnRenamed("_pixel", along)


def resampled(plane: DataFrame, width: int, height: int, first: tuple[float, float] = (0.0, 0.0), step: tuple[float, float] = (1.0, 1.0), mode: str = "Linear") -> DataFrame:
    """A plane (image_id, u, v, value) on a view's grid of ``width`` by ``height`` pixels: image_id, u, v (pixels from 0), value.

    Pixel i is at ``first + i * step`` samples, at any scale, finer or coarser than the samples. Samples scatter to the pixels in their reach, first along u, then along v:
    the stencil of a pixel (1, 4 or 16 samples) is never gathered, sums combine before the shuffle, and an axis at a time costs 2 and 4 rows a sample in place of 4 and 16.
    Samples that aren't there, at the rim or in holes, have no weight. Pixels further than half a sample from every sample have no row.
    """
    rows = plane.where(F.col("value").isNotNull()).select("image_id", "u", "v", F.col("value").cast("double").alias("_top"), F.lit(1.0).alias("_weight"), F.lit(True).alias("_near"))
    rows = scattered(rows, "u", ["image_id", "v"], ["_top", "_weight"], first[0], step[0], width, mode)
    rows = scattered(rows, "v", ["image_id", "u"], ["_top", "_weight"], first[1], step[1], height, mode)
    return rows.where("_near").select("image_id", "u", "v", (F.col("_top") / F.col("_weight")).alias("value"))
