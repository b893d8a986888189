"""Transfer functions: piecewise-linear opacity and colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, is_finite
from ..functions.vector import bound
from ..model import U16_MAX
from . import selection
from .mapping import trimmed


def window_bounds(window: Column, level: Column, vmin: Column, vmax: Column) -> tuple[Column, Column]:
    half = F.abs(window) * 0.5
    return F.greatest(level - half, vmin), F.least(level + half, vmax)


def ramp(v: Column, lb: Column, ub: Column, lo: Column, hi: Column) -> Column:
    """lo up to lb, hi from ub on, linear between. Where lb >= ub, lb is looked at first."""
    return F.when(v <= lb, lo).when(v >= ub, hi).otherwise(lo + (hi - lo) * (v - lb) / (ub - lb))


def opacity(v: Column, window: Column, level: Column, vmin: Column, vmax: Column) -> Column:
    """Opacity of a sample; a negative window inverts it."""
    lb, ub = window_bounds(window, level, vmin, vmax)
    lo, hi = F.when(window < 0, 1.0).otherwise(0.0), F.when(window < 0, 0.0).otherwise(1.0)
    return ramp(v, lb, ub, lo, hi)


def opacity_nodes(window: Column, level: Column, vmin: Column, vmax: Column) -> Column:
    """The four nodes of ``opacity``."""
    lb, ub = window_bounds(window, level, vmin, vmax)
    lo, hi = F.when(window < 0, 1.0).otherwise(0.0), F.when(window < 0, 0.0).otherwise(1.0)
    return F.array(*(node(x, y) for x, y in ((vmin, lo), (lb, lo), (ub, hi), (vmax, hi))))


def node(x: Column, y: Column, midpoint: float = 0.5, sharpness: float = 0.0) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(midpoint).alias("midpoint"), F.lit(sharpness).alias("sharpness"))


#: Opacity 0 to 1, and black to white, over the mapped domain.
DEFAULT_NODES, DEFAULT_COLOURS = [(0.0, 0.0), (float(U16_MAX), 1.0)], [(0.0, 0.0, 0.0, 0.0), (float(U16_MAX), 1.0, 1.0, 1.0)]


def default_nodes() -> Column:
    """``DEFAULT_NODES`` as a column."""
    return F.array(*(node(F.lit(x), F.lit(y)) for x, y in DEFAULT_NODES))


def colour_node(x: Column, red: Column, green: Column, blue: Column, midpoint: float = 0.5, sharpness: float = 0.0) -> Column:
    parts = {"x": x, "red": red, "green": green, "blue": blue}
    return F.struct(*(c.cast("double").alias(n) for n, c in parts.items()), F.lit(midpoint).alias("midpoint"), F.lit(sharpness).alias("sharpness"))


def _black_to_white(lo: Column, hi: Column) -> Column:
    return F.array(*(colour_node(x, *[F.lit(y)] * 3) for x, y in ((lo, 0.0), (hi, 1.0))))


def default_colours() -> Column:
    """Black to white over the mapped domain."""
    return _black_to_white(F.lit(0.0), F.lit(float(U16_MAX)))


def range_colours(vmin: Column, vmax: Column) -> Column:
    """Black to white over an image's range without 1 % at either end (an empty range as it is)."""
    return _black_to_white(*trimmed(vmin, vmax))


def evaluate_colour(nodes: Column | list[tuple[float, float, float, float]], v: Column) -> Column:
    """Red, green and blue of colour nodes at v, each linear between nodes. An empty list gives nulls. Nodes known beforehand may be tuples (x, red, green, blue)."""
    if isinstance(nodes, list):
        return F.struct(*(_chain([(n[0], n[k]) for n in nodes], v).alias(name) for k, name in ((1, "red"), (2, "green"), (3, "blue"))))
    return _interpolated(nodes, v, lambda at: F.struct(*(at(name).alias(name) for name in ("red", "green", "blue"))))


def gray_ramp(v: Column, vmin: Column, vmax: Column) -> Column:
    """Grey value over the range without 1 % at either end; it doesn't follow window and level."""
    lb, ub = trimmed(vmin, vmax)
    return ramp(v, lb, ub, F.lit(0.0), F.lit(1.0))


def tf_remap(nodes: Column, shift: Column, scale: Column) -> Column:
    """Nodes, of opacity or colour, with mapped positions; values and shape parameters stay."""
    return F.transform(nodes, lambda n: n.withField("x", (n["x"] + shift) * scale))


def _chain(nodes: list[tuple[float, float]], v: Column) -> Column:
    """Nodes known beforehand as conditions one after the other, which are compiled with the query."""
    if not nodes:
        return F.lit(None).cast("double")
    x = v.cast("double")
    out = F.when(x.isNull(), F.lit(None).cast("double")).when(x < float(nodes[0][0]), float(nodes[0][1]))
    for (a, ya), (b, yb) in zip(nodes, nodes[1:], strict=False):
        out = out.when(x < float(b), float(ya) + float(yb - ya) * (x - float(a)) / float(b - a)) if b > a else out
    return out.otherwise(float(nodes[-1][1]))


def evaluate(nodes: Column | list[tuple[float, float]], v: Column) -> Column:
    """A node list at v: linear between nodes in order, constant outside. An empty list gives null, NaN the last node's value, a null v null.

    Nodes that come from columns are bound once and searched for each value; nodes known beforehand may be tuples (x, y), and become compiled conditions.
    """
    if isinstance(nodes, list):
        return _chain(nodes, v)
    return _interpolated(nodes, v, lambda at: at("y"))


def _interpolated(nodes: Column, v: Column, use) -> Column:
    """``use(at)``, where ``at(name)`` is a field of ``nodes`` at v. Nodes, v and the segment are evaluated once, for however many fields."""

    def between(s: Column, x: Column, name: str) -> Column:
        a, b = s["a"], s["b"]  # the same node before the first and after the last
        return F.when(b["x"] > a["x"], a[name] + (b[name] - a[name]) * (x - a["x"]) / (b["x"] - a["x"])).otherwise(a[name])

    def segment(n: Column, i: Column) -> Column:
        return F.struct(F.get(n, F.greatest(i - 1, F.lit(0))).alias("a"), F.coalesce(F.get(n, i), F.element_at(n, -1)).alias("b"))

    def on(n: Column, x: Column) -> Column:
        return bound(F.size(F.filter(n, lambda k: k["x"] <= x)), lambda i: bound(segment(n, i), lambda s: use(lambda name: between(s, x, name))))

    both = F.struct(nodes.alias("n"), v.cast("double").alias("v"))
    return bound(both, lambda s: F.when((F.size(s["n"]) > 0) & s["v"].isNotNull(), on(s["n"], s["v"])))


#: Samples of a ray that are gathered at once.
RAY_BLOCK = 64


def composite(voxels: DataFrame, opacity_column: str, colour_column: str, axis: str = "z", step_over_unit: float = 1.0) -> DataFrame:
    """Front-to-back compositing along an axis: the colour and opacity of each ray.

    Opacities are those of one unit distance (see ``scalar.mean_spacing``), of which a step is ``step_over_unit``. "Over" is associative: runs of ``RAY_BLOCK`` indices
    become one (colour, clearness) pair each, and a ray's pairs are merged in order. On the blocked layout, ``blocked.composite`` does so without a row a sample.
    """
    others = [a for a in ("x", "y", "z") if a != axis]
    o = F.col(opacity_column).cast("double")
    sample = F.struct(F.col(axis).alias("at"), F.col(colour_column).cast("double").alias("colour"), (1.0 - o if step_over_unit == 1.0 else F.pow(1.0 - o, F.lit(step_over_unit))).alias("clear"))
    start = F.struct(F.lit(0.0).alias("colour"), F.lit(1.0).alias("clear"))
    step = lambda s, x: F.struct((s["colour"] + s["clear"] * (1.0 - x["clear"]) * x["colour"]).alias("colour"), (s["clear"] * x["clear"]).alias("clear"))
    over = lambda s, x: F.struct((s["colour"] + s["clear"] * x["colour"]).alias("colour"), (s["clear"] * x["clear"]).alias("clear"))
    ordered = lambda c: F.array_sort(F.collect_list(c))
    runs = voxels.groupBy("image_id", *others, F.floor(F.col(axis) / RAY_BLOCK).alias("run")).agg(F.aggregate(ordered(sample), start, step).alias("pair"))
    rays = runs.groupBy("image_id", *others).agg(F.aggregate(ordered(F.struct("run", "pair.colour", "pair.clear")), start, over).alias("ray"))
    return rays.select("image_id", *others, "ray.colour", (1.0 - F.col("ray.clear")).alias("opacity"))


def oblique(
    voxels: DataFrame,
    size: tuple[int, int],
    opacity: Column | list[tuple[float, float]],
    colour: Column | list[tuple[float, float]],
    shear: tuple[float, float] = (0.0, 0.0),
    first: tuple[float, float] = (0.0, 0.0),
    axis: str = "z",
    step_over_unit: float = 1.0,
    mode: str = "Linear",
) -> DataFrame:
    """Rays that aren't along an axis: image_id, u, v, colour, opacity for a view of ``size`` rays (u and v are the two other axes, in their order).

    Ray (u, v) crosses plane w of the ``axis`` that it is nearest to at ``first + (u, v) + shear * w``. In each plane samples scatter to the rays in their reach (see ``selection.resampled``), so
    values are interpolated before they get opacity and colour from nodes; then rays are composited in the order of planes. A step is as long as
    the ray's way from plane to plane: ``step_over_unit`` is that over the unit distance (see ``ray_step``). Planes that a ray passes outside of are clear to it.
    """
    u, v = (a for a in ("x", "y", "z") if a != axis)
    rows = voxels.where(is_finite(F.col("v"))).select("image_id", F.col(axis).alias("w"), F.col(u).alias("a"), F.col(v).alias("b"), F.col("v").cast("double").alias("_top"), F.lit(1.0).alias("_weight"), F.lit(True).alias("_near"))
    rows = selection.scattered(rows, "a", ["image_id", "w", "b"], ["_top", "_weight"], F.lit(first[0]) + F.col("w") * shear[0], 1.0, size[0], mode)
    rows = selection.scattered(rows, "b", ["image_id", "w", "a"], ["_top", "_weight"], F.lit(first[1]) + F.col("w") * shear[1], 1.0, size[1], mode)
    value = F.col("_top") / F.col("_weight")
    cells = rows.where("_near").select("image_id", F.col("a").alias("x"), F.col("b").alias("y"), F.col("w").alias("z"), clamp(evaluate(opacity, value), F.lit(0.0), F.lit(1.0)).alias("o"), evaluate(colour, value).alias("c"))
    return composite(cells, "o", "c", "z", step_over_unit).select("image_id", F.col("x").alias("u"), F.col("y").alias("v"), "colour", "opacity")


def ray_step(shear: tuple[float, float], spacing: tuple[float, float, float]) -> float:
    """The way of a ray from plane to plane over the unit distance; ``spacing`` is that of the two in-plane axes, and between planes."""
    a, b, c = (shear[0] * spacing[0], shear[1] * spacing[1], spacing[2])
    return (a * a + b * b + c * c) ** 0.5 / (sum(spacing) / 3)


def mapped_opacity(nodes: Column | list[tuple[float, float]], v: Column) -> Column:
    return clamp(evaluate(nodes, v), F.lit(0.0), F.lit(1.0))
