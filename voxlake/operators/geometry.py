"""Index and world geometry, orientations and camera placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import bound, camera_basis, dot, norm
from ..model import ORIENTATIONS, PLANE_AXES


def index_to_world(index: Column, origin: Column, spacing: Column) -> Column:
    return origin + spacing * index


def index_to_world_directed(index: Column, origin: Column, spacing: Column, direction: Column) -> Column:
    """World position (array of 3) of an index (array of 3) with a 3 x 3 direction matrix in rows; without a matrix of nine entries, its rows are the axes."""
    scaled = F.zip_with(index, spacing, lambda i, s: i * s)
    plain = F.zip_with(origin, scaled, lambda o, s: o + s)
    turned = F.zip_with(origin, F.array(*(dot(F.slice(direction, F.lit(3 * r + 1), F.lit(3)), scaled) for r in range(3))), lambda o, s: o + s)
    return F.when(F.size(direction) == 9, turned).otherwise(plain)


def axes_of(orientation: Column) -> Column:
    """In-plane axes u, v and the normal w of an orientation, as a struct of axis numbers."""
    out = None
    for name, (u, v, w) in PLANE_AXES.items():
        one = F.struct(F.lit(u).alias("u"), F.lit(v).alias("v"), F.lit(w).alias("w"))
        out = F.when(orientation == name, one) if out is None else out.when(orientation == name, one)
    return out


def label_lookup(label: Column, current: Column) -> Column:
    """An orientation's code by its label; an unknown label keeps the current one."""
    out = current
    for name, code in ORIENTATIONS.items():
        out = F.when(label == name, code).otherwise(out)
    return out


def bounds_center(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Bounds and centre of world columns."""
    aggs = []
    for c in columns:
        lo, hi = F.min(c), F.max(c)
        aggs += [lo.alias(f"{c}_min"), hi.alias(f"{c}_max"), (0.5 * (lo + hi)).alias(f"{c}_center")]
    return df.groupBy(*keys).agg(*aggs)


def aligned_axis(direction: Column, tolerance_degrees: float = 180.0) -> Column:
    """The principal axis nearest to a direction by angle (the lower one where two are), or -1 beyond the tolerance or for a zero vector."""
    n = norm(direction)
    angles = F.transform(F.slice(direction, F.lit(1), F.lit(3)), lambda x: F.degrees(F.acos(F.least(F.abs(x.cast("double")) / n, F.lit(1.0)))))
    least = F.array_min(angles)
    return F.when((n > 0) & (least <= tolerance_degrees), (F.array_position(angles, least) - 1).cast("int")).otherwise(F.lit(-1))


def plane_outline(u0: Column, u1: Column, v0: Column, v1: Column, w: Column, orientation: str) -> Column:
    """The closed rectangle of a plane: five points, counter-clockwise in (u, v)."""
    u, v, _ = PLANE_AXES[orientation]

    def point(a, b):
        place = {u: a, v: b}
        return F.struct(*(place.get(i, w).cast("double").alias(n) for i, n in enumerate("xyz")))

    return F.array(point(u0, v0), point(u1, v0), point(u1, v1), point(u0, v1), point(u0, v0))


def corner_extent(bounds: list[Column], right: Column, up: Column) -> tuple[Column, Column]:
    """The greatest distances from the centre of a box's corners along two unit vectors. By symmetry half the sides' weights add up; no corner is enumerated."""
    half = F.array(*((bounds[2 * i + 1] - bounds[2 * i]) * 0.5 for i in range(3)))
    reach = lambda axis: F.aggregate(F.zip_with(half, axis, lambda h, a: F.abs(h * a)), F.lit(0.0), lambda s, x: s + x)
    return reach(right), reach(up)


def fit_view(bounds: list[Column], direction: Column, up: Column, width: Column, height: Column, view_angle: Column, distance: Column) -> Column:
    """How a camera shows a whole box with 5 % to spare: parallel_scale, and the distance for a perspective of ``view_angle`` degrees (the present one where the angle is degenerate)."""
    right, true_up = camera_basis(direction, up)
    u, v = corner_extent(bounds, right, true_up)
    aspect = F.when((width > 0) & (height > 0), width / height).otherwise(1.0)
    tan_v = F.tan(F.radians(view_angle) * 0.5)
    tan_h = tan_v * aspect

    def fitted(e):
        far = F.greatest(F.when(tan_v > 1e-12, e["v"] / tan_v).otherwise(distance), F.when(tan_h > 1e-12, e["u"] / tan_h).otherwise(distance))
        return F.struct((F.greatest(e["v"], e["u"] / aspect) * 1.05).alias("parallel_scale"), (far * 1.05).alias("distance"))

    return bound(F.struct(u.alias("u"), v.alias("v")), fitted)


def _point(x: list[Column]) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip(x, "xyz", strict=True)))


def slice_camera(extent: list[tuple[Column, Column]], origin: list[Column], spacing: list[Column], orientation: str) -> Column:
    """A slice view's camera at first: focal, position, up. It looks at the middle of the plane at the extent's low face (for XZ the high face), from a sample's distance along the normal; the second in-plane axis is up."""
    u, v, w = PLANE_AXES[orientation]
    focal = [origin[i] + 0.5 * spacing[i] * (extent[i][0] + extent[i][1]) for i in range(3)]
    focal[w] = origin[w] + spacing[w] * (extent[w][1] if orientation == "XZ" else extent[w][0])
    position = list(focal)
    position[w] = focal[w] + spacing[w]
    return F.struct(_point(focal).alias("focal"), _point(position).alias("position"), _point([F.lit(1.0 if i == v else 0.0) for i in range(3)]).alias("up"))


def follow_slice(camera: Column, origin: list[Column], spacing: list[Column], orientation: str, index: Column, distance: Column) -> Column:
    """The camera moved along the normal to a slice, at a distance from it. The first slice shown is ``centre_index`` of the extent."""
    w = PLANE_AXES[orientation][2]
    axis = "xyz"[w]
    focal = camera["focal"].withField(axis, (origin[w] + spacing[w] * index).cast("double"))
    position = focal.withField(axis, focal[axis] + distance)
    return F.struct(focal.alias("focal"), position.alias("position"), camera["up"].alias("up"))
