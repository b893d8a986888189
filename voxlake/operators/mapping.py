"""The mapped 16-bit domain: shift and scale, and window/level arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, finite_or, is_finite
from ..model import U16_MAX

UNSIGNED = ("uchar", "ushort")
SIGNED_CHAR = ("char", "schar")


def scalar_range(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Least and greatest finite value by ``keys`` (or of all rows), as vmin and vmax; 0 and 1 where there is none."""
    v = F.col(value).cast("double")
    seen = F.when(is_finite(v), v)
    return df.groupBy(*keys).agg(F.coalesce(F.min(seen), F.lit(0.0)).alias("vmin"), F.coalesce(F.max(seen), F.lit(1.0)).alias("vmax"))


def ordered_range(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A range with its ends finite (else 0 and 1) and in order."""
    a, b = finite_or(lo, F.lit(0.0)), finite_or(hi, F.lit(1.0))
    return F.least(a, b), F.greatest(a, b)


def shift_scale_params(scalar_type: Column, vmin: Column, vmax: Column) -> tuple[Column, Column]:
    """Shift and scale by native type. Types other than 8 and 16 bits go by range: only negatives are shifted, and nothing is scaled up."""
    width = vmax - vmin
    by_type = F.when(scalar_type.isin(*UNSIGNED), 0.0).when(scalar_type.isin(*SIGNED_CHAR), 128.0).when(scalar_type == "short", 32768.0)
    shift = by_type.otherwise(F.when(vmin < 0, -vmin).otherwise(0.0))
    fixed = scalar_type.isin(*UNSIGNED, *SIGNED_CHAR, "short")
    scale = F.when(fixed | (width <= 0), 1.0).otherwise(F.least(F.lit(float(U16_MAX)) / width, F.lit(1.0)))
    return shift, scale


def shift_scale_u16(v: Column, shift: Column, scale: Column) -> Column:
    """(v + shift) * scale, saturated to 0..65535 and truncated. NaN saturates upwards."""
    return F.floor(clamp((v + shift) * scale, F.lit(0.0), F.lit(float(U16_MAX)))).cast("int")


def mapped(voxels: DataFrame, volumes: DataFrame, value: str = "v", key: str = "image_id") -> DataFrame:
    """``voxels`` with a ``mapped`` column, by their volume's type and range.

    One pass for the ranges (a row for each volume), one for the samples; the ranges are joined on the key, so Catalyst broadcasts them where they are small.
    """
    stats = scalar_range(voxels, value, key).join(volumes.select(key, "scalar_type"), key)
    shift, scale = shift_scale_params(F.col("scalar_type"), F.col("vmin"), F.col("vmax"))
    params = stats.select(key, shift.alias("shift"), scale.alias("scale"))
    return voxels.join(params, key).select(*(voxels[c] for c in voxels.columns), shift_scale_u16(F.col(value).cast("double"), F.col("shift"), F.col("scale")).alias("mapped"))


def mapped_between(value: Column, lo: float, hi: float, shift: float, scale: float) -> Column:
    """lo <= mapped value <= hi as a predicate on the native value, which the scan can push down (the affine isn't inverted by the optimizer)."""
    low, high = lo / scale - shift, (hi + 1) / scale - shift
    tests = []
    if lo > 0:
        tests.append(value >= low)
    if hi < U16_MAX:
        tests.append(value < high)
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def baseline_wl(vmin: Column, vmax: Column) -> tuple[Column, Column]:
    """Window and level of the range without 1 % at either end; the window is at least 1."""
    lb, ub = trimmed(vmin, vmax)
    return F.greatest(ub - lb, F.lit(1.0)), (lb + ub) * 0.5


def trimmed(vmin: Column, vmax: Column) -> tuple[Column, Column]:
    d = vmax - vmin
    return vmin + d * 0.01, vmax - d * 0.01


def wl_native_to_mapped(window: Column, level: Column, shift: Column, scale: Column, floor: float | None = None) -> tuple[Column, Column]:
    """Window and level in the mapped domain; ``floor`` is the least window (1.0 where an image is displayed, none for baselines)."""
    w = F.abs(window) * scale
    return (w if floor is None else F.greatest(w, F.lit(floor))), (level + shift) * scale


def wl_mapped_to_native(window: Column, level: Column, shift: Column, scale: Column) -> tuple[Column, Column]:
    """Window (at least 1) and level in the native domain."""
    lower = (level - F.abs(window) * 0.5) / scale - shift
    upper = (level + F.abs(window) * 0.5) / scale - shift
    return F.greatest(upper - lower, F.lit(1.0)), (upper + lower) * 0.5


def wl_drag(window: Column, level: Column, from_x: Column, from_y: Column, to_x: Column, to_y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Window (at least 0.01) and level after a drag: a quarter of the viewport changes either by its own size, by 0.01 at least."""

    def gain(delta, now):
        scaled = delta * F.when(F.abs(now) > 0.01, now).when(now < 0, -0.01).otherwise(0.01)
        return F.when(now < 0, -scaled).otherwise(scaled)

    dx = gain((to_x - from_x) * 4.0 / width, window)
    dy = gain((from_y - to_y) * 4.0 / height, level)
    return F.greatest(window + dx, F.lit(0.01)), level - dy
