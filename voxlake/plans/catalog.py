"""The driver's queries over its tables, each with the DuckDB statement that must give the same rows."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar, vector
from ..model import INTERPOLATIONS, PLANE_AXES
from ..operators import blocked, geometry, mapping, selection, transfer
from ..sources import blocks, dicom, paths, shared, synthetic, volume_files
from ..streaming import events as ev
from ..streaming import registry, saved, scan, timers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.raster(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


L, D = F.lit, lambda x: F.lit(float(x))
RASTER = "r AS (SELECT vec_id, u.pos::INT AS pos, embedding[u.pos + 1]::DOUBLE AS v FROM embeddings, unnest(range(0, len(embedding))) AS u(pos))"


@_query(f"WITH {RASTER} SELECT pos, coalesce(min(v) FILTER (isfinite(v)), 0) AS vmin, coalesce(max(v) FILTER (isfinite(v)), 1) AS vmax FROM r GROUP BY pos")
def scalar_range(spark, sf_dir):
    return mapping.scalar_range(_raster(spark, sf_dir), "v", "pos")


_TYPED = "CASE vec_id % 5 WHEN 0 THEN 'uchar' WHEN 1 THEN 'schar' WHEN 2 THEN 'short' WHEN 3 THEN 'int' ELSE 'double' END"
_PARAMS = f"""s AS (SELECT vec_id, {_TYPED} AS scalar_type, min(v) AS vmin, max(v) AS vmax FROM r GROUP BY vec_id),
p AS (SELECT vec_id, scalar_type, CASE scalar_type WHEN 'uchar' THEN 0.0 WHEN 'schar' THEN 128.0 WHEN 'short' THEN 32768.0 ELSE CASE WHEN vmin < 0 THEN -vmin ELSE 0.0 END END::DOUBLE AS shift,
 CASE WHEN scalar_type IN ('uchar', 'schar', 'short') OR vmax <= vmin THEN 1.0::DOUBLE ELSE least(65535.0::DOUBLE / (vmax - vmin), 1.0::DOUBLE) END AS scale FROM s)"""


def _typed(spark, sf_dir):
    kind = F.col("vec_id") % 5
    return F.when(kind == 0, "uchar").when(kind == 1, "schar").when(kind == 2, "short").when(kind == 3, "int").otherwise("double")


# samples of 10000 times their value, so that ranges of more than 65535 occur
_WIDE = "r AS (SELECT vec_id, u.pos::INT AS pos, embedding[u.pos + 1]::DOUBLE * 1000000 AS v FROM embeddings, unnest(range(0, len(embedding))) AS u(pos))"


@_query(f"WITH {_WIDE}, {_PARAMS} SELECT * FROM p")
def shift_scale_params(spark, sf_dir):
    r = _raster(spark, sf_dir).withColumn("v", F.col("v") * 1000000)
    s = mapping.scalar_range(r, "v", "vec_id").withColumn("scalar_type", _typed(spark, sf_dir))
    shift, scale = mapping.shift_scale_params(F.col("scalar_type"), F.col("vmin"), F.col("vmax"))
    return s.select("vec_id", "scalar_type", shift.alias("shift"), scale.alias("scale"))


@_query(f"WITH {_WIDE}, {_PARAMS} SELECT vec_id, pos, floor(least(greatest((v + shift) * scale, 0), 65535))::INT AS mapped FROM r JOIN p USING (vec_id)")
def shift_scale_u16(spark, sf_dir):
    r = _raster(spark, sf_dir).withColumn("v", F.col("v") * 1000000)
    volumes = _table(spark, sf_dir, "embeddings").select("vec_id").withColumn("scalar_type", _typed(spark, sf_dir))
    return mapping.mapped(r, volumes, "v", "vec_id").select("vec_id", "pos", "mapped")


_PRICES = "s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT lo, hi, lo + (hi - lo) * 0.01::DOUBLE AS lb, hi - (hi - lo) * 0.01::DOUBLE AS ub FROM s)"


def _price_range(spark, sf_dir):
    return mapping.scalar_range(_table(spark, sf_dir, "lineitem"), "l_extendedprice")


@_query(f"WITH {_PRICES} SELECT greatest(ub - lb, 1.0::DOUBLE) AS win, (lb + ub) * 0.5::DOUBLE AS level FROM b")
def baseline_wl(spark, sf_dir):
    w, l = mapping.baseline_wl(F.col("vmin"), F.col("vmax"))
    return _price_range(spark, sf_dir).select(w.alias("win"), l.alias("level"))


def _ramp(spark, sf_dir, column, **more):
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
    return li.crossJoin(F.broadcast(_price_range(spark, sf_dir))).select("l_orderkey", "l_linenumber", column.alias("y"))


@_query(
    f"WITH {_PRICES}, w AS (SELECT *, greatest(ub - lb, 1.0::DOUBLE) AS win, (lb + ub) * 0.5::DOUBLE AS level FROM b), k AS (SELECT greatest(level - win * 0.5::DOUBLE, lo) AS a, least(level + win * 0.5::DOUBLE, hi) AS z FROM w) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice <= a THEN 0.0::DOUBLE WHEN l_extendedprice >= z THEN 1.0::DOUBLE ELSE (l_extendedprice - a) / (z - a) END AS y FROM lineitem, k"
)
def opacity_tf(spark, sf_dir):
    w, l = mapping.baseline_wl(F.col("vmin"), F.col("vmax"))
    return _ramp(spark, sf_dir, transfer.opacity(F.col("v"), w, l, F.col("vmin"), F.col("vmax")))


@_query(
    "WITH k AS (SELECT greatest(40000::DOUBLE - 15000, min(l_extendedprice)) AS a, least(40000::DOUBLE + 15000, max(l_extendedprice)) AS z FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice <= a THEN 1.0::DOUBLE WHEN l_extendedprice >= z THEN 0.0::DOUBLE ELSE 1.0::DOUBLE + (-1.0::DOUBLE) * (l_extendedprice - a) / (z - a) END AS y FROM lineitem, k"
)
def opacity_tf_inverted(spark, sf_dir):
    return _ramp(spark, sf_dir, transfer.opacity(F.col("v"), D(-30000), D(40000), F.col("vmin"), F.col("vmax")))


@_query(f"WITH {_PRICES} SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice <= lb THEN 0.0::DOUBLE WHEN l_extendedprice >= ub THEN 1.0::DOUBLE ELSE (l_extendedprice - lb) / (ub - lb) END AS y FROM lineitem, b")
def gray_ramp(spark, sf_dir):
    return _ramp(spark, sf_dir, transfer.gray_ramp(F.col("v"), F.col("vmin"), F.col("vmax")))


_PART_WL = "SELECT p_partkey, p_retailprice - 1000 AS win, p_size::DOUBLE * 10 AS level FROM part"


def _part_wl(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") - 1000).alias("win"), (F.col("p_size").cast("double") * 10).alias("level"))


@_query(
    f"WITH w AS ({_PART_WL}), k AS (SELECT *, greatest(level - abs(win) * 0.5::DOUBLE, -200) AS lb, least(level + abs(win) * 0.5::DOUBLE, 900) AS ub, CASE WHEN win < 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS lo FROM w) "
    "SELECT p_partkey, u.i::INT AS node, ([-200, lb, ub, 900][u.i + 1] + 200) * 0.5::DOUBLE AS x, [lo, lo, 1 - lo, 1 - lo][u.i + 1] AS y, 0.5::DOUBLE AS midpoint, 0.0::DOUBLE AS sharpness FROM k, unnest(range(0, 4)) AS u(i)"
)
def tf_remap(spark, sf_dir):
    nodes = transfer.opacity_nodes(F.col("win"), F.col("level"), D(-200), D(900))
    out = _part_wl(spark, sf_dir).select("p_partkey", F.posexplode(transfer.tf_remap(nodes, D(200), D(0.5))).alias("node", "n"))
    return out.select("p_partkey", "node", "n.x", "n.y", "n.midpoint", "n.sharpness")


@_query("SELECT l_orderkey, l_linenumber, least(l_extendedprice / 65535, 1) AS opacity, least(l_extendedprice / 65535, 1) AS red, least(l_extendedprice / 65535, 1) AS blue FROM lineitem")
def default_functions(spark, sf_dir):
    """Opacity and colour of the default nodes over the mapped domain."""
    v = F.col("l_extendedprice")
    out = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", transfer.mapped_opacity(transfer.DEFAULT_NODES, v).alias("opacity"), transfer.evaluate_colour(transfer.DEFAULT_COLOURS, v).alias("c"))
    return out.select("l_orderkey", "l_linenumber", "opacity", "c.red", "c.blue")


@_query(
    f"WITH w AS ({_PART_WL}), k AS (SELECT p_partkey, level, level + 500 AS hi FROM w) "
    "SELECT p_partkey, u.i::INT AS node, (CASE u.i WHEN 0 THEN level + (hi - level) * 0.01::DOUBLE ELSE hi - (hi - level) * 0.01::DOUBLE END + 200) * 0.5::DOUBLE AS x, u.i::DOUBLE AS red, u.i::DOUBLE AS green, u.i::DOUBLE AS blue, 0.5::DOUBLE AS midpoint, 0.0::DOUBLE AS sharpness FROM k, unnest(range(0, 2)) AS u(i)"
)
def colour_remap(spark, sf_dir):
    """An image's black-to-white nodes, in the mapped domain."""
    nodes = transfer.range_colours(F.col("level"), F.col("level") + 500)
    return _part_wl(spark, sf_dir).select("p_partkey", F.posexplode(transfer.tf_remap(nodes, D(200), D(0.5))).alias("node", "n")).select("p_partkey", "node", "n.*")


@_query(
    "WITH p AS (SELECT p_partkey, p_retailprice AS v FROM part) SELECT p_partkey, "
    + ", ".join(f"CASE WHEN v < 1000 THEN {a} WHEN v >= 2000 THEN {c} WHEN v < 1500 THEN {a} + ({b} - {a}) * (v - 1000) / 500 ELSE {b} + ({c} - {b}) * (v - 1500) / 500 END::DOUBLE AS {n}" for n, a, b, c in (("red", 0.0, 1.0, 0.5), ("green", 0.25, 0.0, 1.0), ("blue", 1.0, 0.5, 0.0)))
    + " FROM p"
)
def colour_function(spark, sf_dir):
    rgb = ((1000, 0, 0.25, 1), (1500, 1, 0, 0.5), (2000, 0.5, 1, 0))
    nodes = F.array(*(transfer.colour_node(*map(D, n)) for n in rgb))
    return _table(spark, sf_dir, "part").select("p_partkey", transfer.evaluate_colour(nodes, F.col("p_retailprice")).alias("c")).select("p_partkey", "c.*")


@_query(f"WITH w AS ({_PART_WL}) SELECT p_partkey, abs(win) * 0.25::DOUBLE AS win_mapped, greatest(abs(win) * 0.25::DOUBLE, 1) AS win_shown, (level + 50) * 0.25::DOUBLE AS level_mapped FROM w")
def wl_native_to_mapped(spark, sf_dir):
    w, l = mapping.wl_native_to_mapped(F.col("win"), F.col("level"), D(50), D(0.25))
    shown, _ = mapping.wl_native_to_mapped(F.col("win"), F.col("level"), D(50), D(0.25), 1.0)
    return _part_wl(spark, sf_dir).select("p_partkey", w.alias("win_mapped"), shown.alias("win_shown"), l.alias("level_mapped"))


@_query(
    f"WITH w AS ({_PART_WL}), k AS (SELECT p_partkey, (level - abs(win) * 0.5::DOUBLE) / 0.25::DOUBLE - 50 AS a, (level + abs(win) * 0.5::DOUBLE) / 0.25::DOUBLE - 50 AS z FROM w) "
    "SELECT p_partkey, greatest(z - a, 1) AS win_native, (z + a) * 0.5::DOUBLE AS level_native FROM k"
)
def wl_mapped_to_native(spark, sf_dir):
    w, l = mapping.wl_mapped_to_native(F.col("win"), F.col("level"), D(50), D(0.25))
    return _part_wl(spark, sf_dir).select("p_partkey", w.alias("win_native"), l.alias("level_native"))


@_query(
    "WITH e AS (SELECT event_id, value - 20 AS w, 10 - value AS l, (event_id % 640)::DOUBLE AS x, (event_id % 480)::DOUBLE AS y FROM events), "
    "d AS (SELECT *, (x - 320) * 4.0::DOUBLE / 640 AS dx, (240 - y) * 4.0::DOUBLE / 480 AS dy FROM e), "
    "g AS (SELECT *, dx * CASE WHEN abs(w) > 0.01 THEN w WHEN w < 0 THEN -0.01 ELSE 0.01 END::DOUBLE AS gx, dy * CASE WHEN abs(l) > 0.01 THEN l WHEN l < 0 THEN -0.01 ELSE 0.01 END::DOUBLE AS gy FROM d) "
    "SELECT event_id, greatest(w + CASE WHEN w < 0 THEN -gx ELSE gx END, 0.01) AS win, l - CASE WHEN l < 0 THEN -gy ELSE gy END AS level FROM g"
)
def wl_drag(spark, sf_dir):
    w, l = F.col("value") - 20, 10 - F.col("value")
    x, y = (F.col("event_id") % 640).cast("double"), (F.col("event_id") % 480).cast("double")
    win, level = mapping.wl_drag(w, l, D(320), D(240), x, y, D(640), D(480))
    return _events(spark, sf_dir).select("event_id", win.alias("win"), level.alias("level"))


def _cells(spark, sf_dir) -> DataFrame:
    """The raster as voxels: x the vector, z the position."""
    return _raster(spark, sf_dir).select(L(0).alias("image_id"), F.col("vec_id").alias("x"), L(0).alias("y"), F.col("pos").alias("z"), "v")


@_query(f"WITH {RASTER} SELECT vec_id, v FROM r WHERE pos = 15")
def slice_xy(spark, sf_dir):
    return selection.slice_plane(_cells(spark, sf_dir), "XY", 15).select(F.col("u").alias("vec_id"), F.col("value").alias("v"))


@_query(f"WITH {RASTER} SELECT pos, v FROM r WHERE vec_id = 7")
def slice_yz(spark, sf_dir):
    return selection.slice_plane(_cells(spark, sf_dir), "YZ", 7).select(F.col("v").alias("pos"), F.col("value").alias("v"))


@_query(f"WITH {RASTER} SELECT vec_id, pos, v FROM r")
def crop_reset(spark, sf_dir):
    """A crop that is switched off is no predicate."""
    return selection.crop_box(_raster(spark, sf_dir), {})


@_query(f"WITH {RASTER} SELECT 'XY' AS plane, vec_id, pos, v FROM r WHERE pos = 63 UNION ALL SELECT 'YZ', vec_id, pos, v FROM r WHERE vec_id = 3 UNION ALL SELECT 'XZ', vec_id, pos, v FROM r")
def three_planes_clamped(spark, sf_dir):
    """Indices outside the extent show its ends."""
    p = selection.three_planes(_cells(spark, sf_dir), 3, 9, 1000, {"x": (0, 400), "y": (0, 0), "z": (0, 63)})
    return p.select("plane", F.col("x").alias("vec_id"), F.col("z").alias("pos"), "v")


@_query(f"WITH {RASTER} SELECT vec_id, pos, v FROM r WHERE vec_id BETWEEN 10 AND 40 AND pos BETWEEN 5 AND 11")
def crop_box(spark, sf_dir):
    emb = selection.crop_box(_table(spark, sf_dir, "embeddings"), {"vec_id": (10, 40)})
    return selection.crop_box(synthetic.raster(emb, "vec_id", "embedding"), {"pos": (5, 11)})


@_query(f"WITH {RASTER} SELECT 'XY' AS plane, vec_id, pos, v FROM r WHERE pos = 3 UNION ALL SELECT 'YZ', vec_id, pos, v FROM r WHERE vec_id = 9")
def three_planes(spark, sf_dir):
    cells = _raster(spark, sf_dir).select(F.col("vec_id").alias("x"), L(1).alias("y"), F.col("pos").alias("z"), "v")
    return selection.three_planes(cells, 9, -1, 3).select("plane", F.col("x").alias("vec_id"), F.col("z").alias("pos"), "v")


@_query(f"WITH {RASTER} SELECT vec_id, min(pos) AS lo, max(pos) AS hi FROM r GROUP BY vec_id")
def slice_bounds(spark, sf_dir):
    cells = _raster(spark, sf_dir).select(F.col("vec_id").alias("image_id"), F.col("pos").alias("z"))
    return selection.slice_range(cells, "XY").withColumnRenamed("image_id", "vec_id")


@_query(f"WITH {RASTER} SELECT vec_id, sum(v * CASE pos WHEN 4 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END) AS v FROM r WHERE pos IN (4, 5) GROUP BY vec_id")
def slice_linear(spark, sf_dir):
    cells = _raster(spark, sf_dir).select(L(0).alias("image_id"), F.col("vec_id").alias("x"), L(0).alias("y"), F.col("pos").alias("z"), "v")
    return selection.sampled(cells, 4.25, "z").select(F.col("x").alias("vec_id"), "v")


_CUBIC = "CASE pos WHEN 3 THEN -0.0703125 WHEN 4 THEN 0.8671875 WHEN 5 THEN 0.2265625 ELSE -0.0234375 END::DOUBLE"


@_query(f"WITH {RASTER} SELECT vec_id, sum(v * {_CUBIC}) AS v FROM r WHERE pos BETWEEN 3 AND 6 GROUP BY vec_id")
def slice_cubic(spark, sf_dir):
    return selection.sampled(_cells(spark, sf_dir), 4.25, "z", "Cubic").select(F.col("x").alias("vec_id"), "v")


@_query("SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id % 3 = 2 THEN 'Linear' ELSE ['Nearest', 'Linear', 'Cubic'][event_id % 3 + 1] END AS mode FROM events")
def shown_interpolation(spark, sf_dir):
    mode = F.get(F.array(*map(L, INTERPOLATIONS)), (F.col("event_id") % 3).cast("int"))
    return _events(spark, sf_dir).select("event_id", selection.shown_mode(mode, _view()).alias("mode"))


_LINE_INTS = "SELECT l_orderkey, l_linenumber, (l_quantity::INT - 10) AS lo, (l_linenumber * 7 - 3)::INT AS hi FROM lineitem"


def _line_ints(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") - 10).alias("lo"), (F.col("l_linenumber") * 7 - 3).cast("int").alias("hi"))


@_query(
    f"WITH i AS ({_LINE_INTS}), c AS (SELECT l_orderkey, l_linenumber, least(greatest(lo, 0), 20) AS a, least(greatest(hi, 0), 20) AS b FROM i), o AS (SELECT l_orderkey, l_linenumber, least(a, b) AS lo, greatest(a, b) AS hi FROM c) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN lo = hi AND hi >= 20 AND lo > 0 THEN lo - 1 ELSE lo END AS lo, CASE WHEN lo = hi AND hi < 20 THEN hi + 1 ELSE hi END AS hi FROM o"
)
def crop_normalize(spark, sf_dir):
    lo, hi = selection.crop_normalize(F.col("lo"), F.col("hi"), L(0), L(20))
    return _line_ints(spark, sf_dir).select("l_orderkey", "l_linenumber", lo.alias("lo"), hi.alias("hi"))


@_query(f"WITH i AS ({_LINE_INTS}), c AS (SELECT l_orderkey, l_linenumber, least(greatest(lo, 0), 20) AS a, least(greatest(hi, 0), 20) AS b FROM i) SELECT l_orderkey, l_linenumber, least(a, b) AS lo, greatest(a, b) AS hi FROM c")
def interval_normalize(spark, sf_dir):
    lo, hi = selection.interval_normalize(F.col("lo"), F.col("hi"), L(0), L(20))
    return _line_ints(spark, sf_dir).select("l_orderkey", "l_linenumber", lo.alias("lo"), hi.alias("hi"))


@_query(f"WITH i AS ({_LINE_INTS}) SELECT l_orderkey, l_linenumber, least(greatest(lo, 2), 30) AS idx, CASE WHEN lo + hi >= 0 THEN floor((lo + hi) / 2) ELSE ceil((lo + hi) / 2) END::INT AS centre FROM i")
def clamp_index(spark, sf_dir):
    return _line_ints(spark, sf_dir).select("l_orderkey", "l_linenumber", selection.clamp_index(F.col("lo"), L(2), L(30)).alias("idx"), scalar.centre_index(F.col("lo"), F.col("hi")).alias("centre"))


_ORDERED = f"o AS (SELECT l_orderkey, l_linenumber, least(lo, hi) AS lo, greatest(lo, hi) AS hi FROM ({_LINE_INTS}))"
_IN = lambda x: f"least(greatest({x}, -5), 35)"


def _line_ranges(spark, sf_dir):
    return _line_ints(spark, sf_dir).select("l_orderkey", "l_linenumber", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))


@_query(
    f"WITH {_ORDERED} SELECT l_orderkey, l_linenumber, {_IN('12')} AS lower_lo, {_IN('greatest(hi, 12)')} AS lower_hi, {_IN('least(lo, 40)')} AS upper_lo, {_IN('40')} AS upper_hi, "
    f"CASE WHEN abs(12 - lo) < abs(12 - hi) THEN 'lower' ELSE 'upper' END AS handle, {_IN('lo + l_linenumber')} AS stepped FROM o"
)
def interval_edit(spark, sf_dir):
    """One end set, which pushes the other; the nearest handle, the upper one of equals; a step."""
    lo, hi, bounds = F.col("lo"), F.col("hi"), (L(-5), L(35))
    lower, upper = selection.set_lower(lo, hi, L(12), *bounds), selection.set_upper(lo, hi, L(40), *bounds)
    ends = [c.alias(f"{n}_{e}") for n, pair in (("lower", lower), ("upper", upper)) for e, c in zip(("lo", "hi"), pair, strict=True)]
    return _line_ranges(spark, sf_dir).select("l_orderkey", "l_linenumber", *ends, selection.nearest_handle(L(12), lo, hi).alias("handle"), selection.step(lo, F.col("l_linenumber"), *bounds).alias("stepped"))


_MOVES = {
    "lower": ("least(12, hi)", "hi"),
    "mirrored": ("least(12, hi)", "hi + lo - least(12, hi)"),
    "upper": ("lo", "greatest(lo, 3)"),
    "widened": ("lo - (greatest(lo, 3) - hi)", "greatest(lo, 3)"),
    "moved": ("floor((lo + hi) / 2)::INT - 7 - (hi - lo) // 2", "floor((lo + hi) / 2)::INT - 7 + (hi - lo + 1) // 2"),
}


@_query(
    f"WITH {_ORDERED}, m AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{a} AS {k}_a, {b} AS {k}_b" for k, (a, b) in _MOVES.items()) + " FROM o) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{f}({_IN(k + '_a')}, {_IN(k + '_b')}) AS {k}_{e}" for k in _MOVES for e, f in (("lo", "least"), ("hi", "greatest"))) + " FROM m"
)
def interval_drag(spark, sf_dir):
    """Handles dragged one by one, mirrored, and both."""
    lo, hi, bounds = F.col("lo"), F.col("hi"), (L(-5), L(35))
    moves = {
        "lower": selection.drag_lower(lo, hi, L(12), *bounds),
        "mirrored": selection.drag_lower(lo, hi, L(12), *bounds, symmetric=True),
        "upper": selection.drag_upper(lo, hi, L(3), *bounds),
        "widened": selection.drag_upper(lo, hi, L(3), *bounds, symmetric=True),
        "moved": selection.drag_both(lo, hi, L(-7), *bounds),
    }
    return _line_ranges(spark, sf_dir).select("l_orderkey", "l_linenumber", *(c.alias(f"{k}_{e}") for k, pair in moves.items() for e, c in zip(("lo", "hi"), pair, strict=True)))


@_query(
    "WITH e AS (SELECT event_id, user_id, ts, (event_id % 30)::INT - 5 AS lo, floor(value)::INT AS hi, event_type <> 'view' AS tracking FROM events), b AS (SELECT *, least(greatest(lo, 0), 20) AS a, least(greatest(hi, 0), 20) AS z FROM e), "
    "o AS (SELECT event_id, user_id, ts, tracking, least(a, z) AS lo, greatest(a, z) AS hi FROM b), "
    "m AS (SELECT *, lo <> coalesce(lag(lo) OVER w, 3) OR hi <> coalesce(lag(hi) OVER w, 9) AS moved FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "v AS (SELECT *, last_value(CASE WHEN moved AND tracking THEN lo END IGNORE NULLS) OVER w AS vl, last_value(CASE WHEN moved AND tracking THEN hi END IGNORE NULLS) OVER w AS vh FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) "
    "SELECT event_id, lo AS position_lo, hi AS position_hi, coalesce(vl, 3) AS value_lo, coalesce(vh, 9) AS value_hi FROM v WHERE moved"
)
def range_positions(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts", ((F.col("event_id") % 30).cast("int") - 5).alias("lo"), F.floor("value").cast("int").alias("hi"), (F.col("event_type") != "view").alias("tracking"))
    return ev.positions(e, ["user_id"], ["ts", "event_id"], "lo", "hi", (0, 20), F.col("tracking"), (3, 9)).select("event_id", "position_lo", "position_hi", "value_lo", "value_hi")


@_query("SELECT l_orderkey, l_linenumber, -50 + (l_quantity - 1) * 450::DOUBLE / 49 AS value, 7.0::DOUBLE AS flat FROM lineitem")
def rescale(spark, sf_dir):
    """Pixels to values, and an empty range of pixels."""
    x = F.col("l_quantity")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", selection.rescale(x, D(1), D(50), D(-50), D(400)).alias("value"), selection.rescale(x, D(1), D(1), D(7), D(9)).alias("flat"))


@_query("SELECT vec_id, (abs(embedding[1]::DOUBLE) + abs(embedding[2]::DOUBLE) + abs(embedding[3]::DOUBLE)) / 3 AS distance FROM embeddings")
def mean_spacing(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", scalar.mean_spacing(*(F.abs(F.get("embedding", L(i)).cast("double")) for i in range(3))).alias("distance"))


@_query("SELECT page_id, regexp_extract(url, '[^/]*$') || ' (' || left(md5(url), 7) || ')' AS title FROM pages")
def window_title(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", scalar.window_title(scalar.basename(F.col("url")), F.md5(F.col("url"))).alias("title"))


@_query("WITH e AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 0.0 WHEN event_id % 6 = 3 THEN 0.0 ELSE 30 - value END::DOUBLE AS a, CASE event_id % 5 WHEN 0 THEN 1.0 ELSE value END::DOUBLE AS b FROM events) SELECT event_id, least(a, b) AS lo, greatest(a, b) AS hi FROM e")
def ordered_range(spark, sf_dir):
    odd = F.when(F.col("event_id") % 6 == 0, D("nan")).when(F.col("event_id") % 3 == 0, D("-inf")).otherwise(30 - F.col("value"))
    lo, hi = mapping.ordered_range(odd, F.when(F.col("event_id") % 5 == 0, D("inf")).otherwise(F.col("value")))
    return _events(spark, sf_dir).select("event_id", lo.alias("lo"), hi.alias("hi"))


@_query(f"WITH {RASTER} SELECT vec_id, pos, -12.5::DOUBLE + 0.25::DOUBLE * vec_id AS wx, 3.0::DOUBLE + 0.5::DOUBLE * pos AS wy FROM r")
def index_to_world(spark, sf_dir):
    return _raster(spark, sf_dir).select("vec_id", "pos", geometry.index_to_world(F.col("vec_id"), D(-12.5), D(0.25)).alias("wx"), geometry.index_to_world(F.col("pos"), D(3), D(0.5)).alias("wy"))


@_query(f"WITH {RASTER} SELECT vec_id, pos, 1.0::DOUBLE - 0.5::DOUBLE * pos AS wx, 2.0::DOUBLE + 0.25::DOUBLE * vec_id AS wy, 3.0::DOUBLE + 2.0::DOUBLE * 4 AS wz FROM r")
def index_to_world_directed(spark, sf_dir):
    doubles = lambda *x: F.array(*map(D, x))
    w = geometry.index_to_world_directed(F.array(F.col("vec_id").cast("double"), F.col("pos").cast("double"), D(4)), doubles(1, 2, 3), doubles(0.25, 0.5, 2), doubles(0, -1, 0, 1, 0, 0, 0, 0, 1))
    return _raster(spark, sf_dir).select("vec_id", "pos", w.alias("w")).select("vec_id", "pos", *(F.col("w")[i].alias(f"w{a}") for i, a in enumerate("xyz")))


@_query(
    f"WITH {RASTER}, w AS (SELECT vec_id % 10 AS g, -12.5::DOUBLE + 0.25::DOUBLE * vec_id AS wx, 3.0::DOUBLE + 0.5::DOUBLE * pos AS wy FROM r) "
    "SELECT g, min(wx) AS wx_min, max(wx) AS wx_max, 0.5::DOUBLE * (min(wx) + max(wx)) AS wx_center, min(wy) AS wy_min, max(wy) AS wy_max, 0.5::DOUBLE * (min(wy) + max(wy)) AS wy_center FROM w GROUP BY g"
)
def bounds_center(spark, sf_dir):
    w = _raster(spark, sf_dir).select((F.col("vec_id") % 10).alias("g"), geometry.index_to_world(F.col("vec_id"), D(-12.5), D(0.25)).alias("wx"), geometry.index_to_world(F.col("pos"), D(3), D(0.5)).alias("wy"))
    return geometry.bounds_center(w, ["wx", "wy"], "g")


@_query(
    "WITH a AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: abs(x::DOUBLE)) AS c FROM embeddings), n AS (SELECT vec_id, c, sqrt(c[1] * c[1] + c[2] * c[2] + c[3] * c[3]) AS n, greatest(c[1], c[2], c[3]) AS m FROM a) "
    "SELECT vec_id, (list_position(c, m) - 1)::INT AS axis, CASE WHEN degrees(acos(least(m / n, 1))) <= 30 THEN list_position(c, m) - 1 ELSE -1 END::INT AS axis_within_30 FROM n"
)
def aligned_axis(spark, sf_dir):
    v = F.slice("embedding", L(1), L(3))
    return _table(spark, sf_dir, "embeddings").select("vec_id", geometry.aligned_axis(v).alias("axis"), geometry.aligned_axis(v, 30.0).alias("axis_within_30"))


@_query(
    "WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS a, list_transform(embedding[4:6], lambda x: x::DOUBLE) AS b FROM embeddings) "
    "SELECT vec_id, round(a[1] * b[1] + a[2] * b[2] + a[3] * b[3], 9) AS d, round(sqrt(a[1] * a[1] + a[2] * a[2] + a[3] * a[3]), 9) AS n, round(a[2] * b[3] - a[3] * b[2], 9) AS cx, round(a[3] * b[1] - a[1] * b[3], 9) AS cy, round(a[1] * b[2] - a[2] * b[1], 9) AS cz FROM e"
)
def vector_dot_norm(spark, sf_dir):
    a, b = F.slice("embedding", L(1), L(3)), F.slice("embedding", L(4), L(3))
    c = vector.cross(a, b)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.dot(a, b), 9).alias("d"), F.round(vector.norm(a), 9).alias("n"), *(F.round(c[i], 9).alias(f"c{x}") for i, x in enumerate("xyz")))


@_query(
    "WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: abs(x::DOUBLE) * 100) AS h FROM embeddings), "
    "s AS (SELECT vec_id, h[1] * 0.5::DOUBLE AS u, h[2] * 0.5::DOUBLE AS v FROM e) "
    "SELECT vec_id, round(greatest(v, u / 1.6::DOUBLE) * 1.05::DOUBLE, 6) AS parallel_scale, round(greatest(v / tan(radians(30.0::DOUBLE) * 0.5::DOUBLE), u / (tan(radians(30.0::DOUBLE) * 0.5::DOUBLE) * 1.6::DOUBLE)) * 1.05::DOUBLE, 6) AS distance FROM s"
)
def fit_view(spark, sf_dir):
    h = [F.abs(F.get("embedding", L(i)).cast("double")) * 100 for i in range(3)]
    bounds = [x for i in range(3) for x in (D(0), h[i])]
    view = geometry.fit_view(bounds, F.array(D(0), D(0), D(-1)), F.array(D(0), D(1), D(0)), D(1280), D(800), D(30), D(1))
    return _table(spark, sf_dir, "embeddings").select("vec_id", view.alias("f")).select("vec_id", F.round("f.parallel_scale", 6).alias("parallel_scale"), F.round("f.distance", 6).alias("distance"))


@_query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE n_regionkey END::INT AS orientation, CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 END::INT AS u, CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END::INT AS w FROM nation")
def label_lookup(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    label = F.when(k == 0, "YZ").when(k == 1, "XZ").when(k == 2, "XY").otherwise(F.col("n_name"))
    axes = geometry.axes_of(label)
    return _table(spark, sf_dir, "nation").select("n_nationkey", geometry.label_lookup(label, F.col("n_regionkey")).cast("int").alias("orientation"), axes["u"].alias("u"), axes["w"].alias("w"))


@_query("SELECT n_nationkey, u.i::INT AS point, CASE WHEN u.i IN (1, 2) THEN n_nationkey + 1.5 ELSE 0.5 END::DOUBLE AS x, CASE WHEN u.i IN (2, 3) THEN 8.0 ELSE -2.0 END::DOUBLE AS z, n_regionkey * 2.0::DOUBLE AS y FROM nation, unnest(range(0, 5)) AS u(i)")
def plane_outline(spark, sf_dir):
    o = geometry.plane_outline(D(0.5), F.col("n_nationkey") + 1.5, D(-2), D(8), F.col("n_regionkey") * 2.0, "XZ")
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(o).alias("point", "p")).select("n_nationkey", "point", "p.x", "p.z", "p.y")


def _isq_of_nations(spark, sf_dir) -> DataFrame:
    """A small ISQ file for each nation, in the shared folder: image_id, path."""
    n, k, r = _table(spark, sf_dir, "nation"), F.col("n_nationkey"), F.col("n_regionkey")
    size = {"nx": k % 5 + 2, "ny": r + 2, "nz": k % 3 + 1}
    sizes = n.select(k.cast("long").alias("image_id"), *(c.cast("int").alias(x) for x, c in size.items()))
    sizes = sizes.select("*", (F.col("nx") * 20).alias("ux"), (F.col("ny") * 30).alias("uy"), (F.col("nz") * 40).alias("uz"))
    z = F.explode(F.sequence(L(0), F.col("nz") - 1))
    cell = F.transform(F.sequence(L(0), F.col("nx") * F.col("ny") - 1), lambda i: (F.col("image_id") * 1000 + F.col("z") * 100 + i - 12000).cast("double"))
    planes = sizes.select("image_id", "nx", "ny", z.alias("z")).select("image_id", "z", cell.alias("data"))
    return volume_files.write_isq(planes, sizes, shared.new_dir(spark, "isq"))


_NATION_SIZES = "n AS (SELECT n_nationkey::BIGINT AS image_id, (n_nationkey % 5 + 2)::INT AS nx, (n_regionkey + 2)::INT AS ny, (n_nationkey % 3 + 1)::INT AS nz FROM nation)"


@_query(
    f"WITH {_NATION_SIZES} SELECT image_id, image_id || '.isq' AS name, 'ISQ' AS format, 'short' AS scalar_type, 0 AS x0, nx - 1 AS x1, ny - 1 AS y1, nz - 1 AS z1, "
    "0.02::DOUBLE AS spacing_x, 0.03::DOUBLE AS spacing_y, 0.04::DOUBLE AS spacing_z, 0.0::DOUBLE AS origin_x, 9 AS entries FROM n"
)
def header_projection(spark, sf_dir):
    """Files written to the shared folder, and their headers alone read back."""
    h = volume_files.headers(spark, _isq_of_nations(spark, sf_dir))
    spacing = [F.round(f"spacing.{a}", 9).alias(f"spacing_{a}") for a in "xyz"]
    return h.select("image_id", scalar.basename(F.col("path")).alias("name"), "format", "scalar_type", "extent.x0", "extent.x1", "extent.y1", "extent.z1", *spacing, F.col("origin.x").alias("origin_x"), F.size("direction").alias("entries"))


@_query(f"WITH {_NATION_SIZES} SELECT image_id, u.z::INT AS z, v.i::INT AS i, (image_id * 1000 + u.z * 100 + v.i - 12000)::DOUBLE AS v FROM n, unnest(range(0, nz)) AS u(z), unnest(range(0, nx * ny)) AS v(i)")
def pixel_scan(spark, sf_dir):
    """The same files' samples, plane by plane."""
    return volume_files.bricks(spark, _isq_of_nations(spark, sf_dir)).select("image_id", "z", F.posexplode("data").alias("i", "v"))


@_query(f"WITH {_NATION_SIZES} SELECT image_id, u.z::INT AS z, (image_id * 1000 + u.z * 100 - 12000)::DOUBLE AS first FROM n, unnest(range(0, nz)) AS u(z) WHERE u.z BETWEEN 1 AND 2")
def plane_range_scan(spark, sf_dir):
    """Planes chosen before any sample is read; the table of planes serves headers and samples."""
    planes = volume_files.planes(spark, _isq_of_nations(spark, sf_dir), "ISQ")
    return volume_files.bricks(spark, planes, planes=(1, 2)).select("image_id", "z", F.get("data", L(0)).alias("first"))


@_query(f"WITH {_NATION_SIZES} SELECT image_id FROM n WHERE nx > 1 AND ny > 1 AND nz > 1")
def loadable_volumes(spark, sf_dir):
    return synthetic.loadable(volume_files.headers(spark, _isq_of_nations(spark, sf_dir))).select("image_id")


@_query("SELECT r_regionkey::BIGINT AS image_id, ['rejected', 'rejected', 'error', 'invalid', 'loaded'][r_regionkey % 5 + 1] AS outcome, CASE r_regionkey % 5 WHEN 2 THEN 'not a DICOM file' END AS detail FROM region")
def load_outcomes(spark, sf_dir):
    """A missing file, an ISQ file with a bad header, a DICOM file that is none, a directory without images, and a good file: a region's, each written by an executor."""
    folder = shared.new_dir(spark, "outcomes")

    def write(batches):
        import pyarrow as pa

        kinds = ("none.isq", "bad.isq", "bad.dcm", "empty/note.txt", "good.isq")
        good = volume_files.ISQ_MAGIC + bytes(28) + struct.pack("<6i", 1, 1, 1, 20, 20, 20) + bytes(444 + 2)
        where, base = volume_files._open(folder)
        for batch in batches:
            paths = []
            for k in batch.column(0).to_pylist():
                name = kinds[k % 5]
                where.create_dir(f"{base}/{k}/empty")
                if k % 5:
                    with where.open_output_stream(f"{base}/{k}/{name}") as f:
                        f.write(good if k % 5 == 4 else b"x" * 600)
                paths.append(f"{folder}/{k}/{name.removesuffix('/note.txt')}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths)], ["image_id", "path"])

    regions = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("image_id")).mapInArrow(write, "image_id long, path string")
    return volume_files.outcomes(spark, regions).select("image_id", "outcome", "detail")


# series of 50 vectors, a frame of 8 by 8 samples each, five frames a file; instance numbers run backwards, and every seventh frame's file isn't there
_SERIES = "f AS (SELECT vec_id // 50 AS image_id, vec_id % 50 AS k, embedding FROM embeddings WHERE vec_id % 50 // 5 <> 7), s AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY k) - 1 AS z FROM f)"


def _dicom_series(spark, sf_dir) -> DataFrame:
    k, file = F.col("vec_id") % 50, F.floor(F.col("vec_id") % 50 / 5)
    frame = F.transform("embedding", lambda v: F.round(v.cast("double") * 1000).cast("int"))
    rows = _table(spark, sf_dir, "embeddings").where(file != 7).groupBy(F.floor(F.col("vec_id") / 50).alias("image_id"), file.alias("file")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), frame.alias("data")))).alias("frames"))
    first = F.get("frames", L(0))["k"]
    files = rows.select("image_id", "file", (1000 - first).cast("int").alias("instance"), (first * 2.0).alias("along"), F.transform("frames", lambda f: f["data"]).alias("frames"))
    compressed = files.withColumn("syntax", F.when(F.col("image_id") % 3 == 0, dicom.RLE).when(F.col("image_id") % 3 == 1, dicom.DEFLATED).otherwise(dicom.EXPLICIT))
    return volume_files.write_dicom(compressed, 8, 8, 2.0, shared.new_dir(spark, "dicom"))


@_query(f"WITH {_SERIES} SELECT image_id::BIGINT AS image_id, z::INT AS z, u.i::INT AS i, round(embedding[u.i + 1]::DOUBLE * 1000)::INT::DOUBLE AS v FROM s, unnest(range(0, 64)) AS u(i)")
def dicom_scan(spark, sf_dir):
    """DICOM files of five frames, in three syntaxes, back as planes in the order of their positions."""
    return volume_files.bricks(spark, _dicom_series(spark, sf_dir)).select("image_id", "z", F.posexplode("data").alias("i", "v"))


@_query(f"WITH {_SERIES} SELECT image_id::BIGINT AS image_id, count(*) AS planes, 2.0::DOUBLE AS spacing, CASE WHEN max(k) > 39 THEN 5 ELSE 0 END::BIGINT AS missing, max(k) <= 39 AS even FROM s GROUP BY image_id")
def series_geometry(spark, sf_dir):
    """The same series: how far apart their planes lie, and how many are missing."""
    return volume_files.series_geometry(spark, _dicom_series(spark, sf_dir)).select("image_id", "planes", "spacing", "missing", "even")


@_query(
    "WITH c AS (SELECT n_nationkey, n_nationkey + 4 AS x1, n_regionkey + 7 AS y1, u.o FROM nation, unnest(['YZ', 'XZ', 'XY']) AS u(o)), "
    "f AS (SELECT *, CASE o WHEN 'YZ' THEN 1.0 ELSE 1 + 0.25 * x1 END::DOUBLE AS fx, CASE o WHEN 'XZ' THEN 2 + 0.25 * y1 ELSE 2 + 0.125 * (2 + y1) END::DOUBLE AS fy, CASE o WHEN 'XY' THEN -3 ELSE 5 END::DOUBLE AS fz FROM c), "
    "g AS (SELECT *, CASE o WHEN 'YZ' THEN 1 + 0.5 * (x1 // 2) ELSE fx END::DOUBLE AS sx, CASE o WHEN 'XZ' THEN 2 + 0.25 * ((2 + y1) // 2) ELSE fy END::DOUBLE AS sy, CASE o WHEN 'XY' THEN 3 + 2 * 1 ELSE fz END::DOUBLE AS sz FROM f) "
    "SELECT n_nationkey, o AS orientation, fx, fy, fz, fx + CASE o WHEN 'YZ' THEN 0.5 ELSE 0 END::DOUBLE AS px, fy + CASE o WHEN 'XZ' THEN 0.25 ELSE 0 END::DOUBLE AS py, fz + CASE o WHEN 'XY' THEN 2 ELSE 0 END::DOUBLE AS pz, "
    "CASE o WHEN 'XY' THEN 1.0 ELSE 0.0 END::DOUBLE AS up_y, CASE o WHEN 'XY' THEN 0.0 ELSE 1.0 END::DOUBLE AS up_z, sx, sy, sz, "
    "sx + CASE o WHEN 'YZ' THEN 10 ELSE 0 END::DOUBLE AS qx, sy + CASE o WHEN 'XZ' THEN 10 ELSE 0 END::DOUBLE AS qy, sz + CASE o WHEN 'XY' THEN 10 ELSE 0 END::DOUBLE AS qz FROM g"
)
def slice_camera(spark, sf_dir):
    """At first on the low face (XZ: the high one); then at the middle slice."""
    extent = [(L(0), F.col("n_nationkey") + 4), (L(2), F.col("n_regionkey") + 7), (L(-3), L(5))]
    origin, spacing = [D(1), D(2), D(3)], [D(0.5), D(0.25), D(2)]
    views = []
    for o, (_, _, w) in PLANE_AXES.items():
        first = geometry.slice_camera(extent, origin, spacing, o)
        views.append(F.struct(L(o).alias("orientation"), first.alias("first"), geometry.follow_slice(first, origin, spacing, o, scalar.centre_index(*extent[w]), D(10)).alias("then")))
    n = _table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*views)).alias("c")).select("n_nationkey", "c.*")
    axes = {"f": "first.focal", "p": "first.position", "s": "then.focal", "q": "then.position"}
    return n.select("n_nationkey", "orientation", *(F.col(f"{c}.{a}").alias(f"{k}{a}") for k, c in axes.items() for a in "xyz"), F.col("first.up.y").alias("up_y"), F.col("then.up.z").alias("up_z"))


_PATHS = "p AS (SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '.ISQ' WHEN 1 THEN '.dcm' WHEN 2 THEN '.aim' WHEN 3 THEN '.txt' WHEN 4 THEN '.DICOM' ELSE '' END AS path, page_id % 7 = 0 AS is_dir, page_id % 11 <> 0 AS permitted FROM pages)"


def _pages(spark, sf_dir):
    k = F.col("page_id") % 6
    end = F.when(k == 0, ".ISQ").when(k == 1, ".dcm").when(k == 2, ".aim").when(k == 3, ".txt").when(k == 4, ".DICOM").otherwise("")
    return _table(spark, sf_dir, "pages").select("page_id", F.concat("url", end).alias("path"), (F.col("page_id") % 7 == 0).alias("is_dir"), (F.col("page_id") % 11 != 0).alias("permitted"))


@_query(f"WITH {_PATHS} SELECT page_id, permitted AND (is_dir OR regexp_matches(lower(path), '\\.(isq|rsq|rad|aim|dcm|dicom)$')) AS readable FROM p")
def readable_probe(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", paths.readable_probe(F.col("path"), L(True), F.col("is_dir"), F.col("permitted")).alias("readable"))


@_query(f"WITH {_PATHS} SELECT page_id, CASE WHEN NOT is_dir AND regexp_matches(lower(path), '\\.(isq|rsq|rad|aim)$') THEN 'ISQ' ELSE 'DICOM' END AS format FROM p")
def format_dispatch(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", paths.format_dispatch(F.col("path"), F.col("is_dir")).alias("format"))


@_query(f"WITH {_PATHS} SELECT page_id, path FROM p WHERE permitted AND (is_dir OR regexp_matches(lower(path), '\\.(isq|rsq|rad|aim|dcm|dicom)$')) ORDER BY page_id LIMIT 1")
def first_readable(spark, sf_dir):
    ok = paths.readable_probe(F.col("path"), L(True), F.col("is_dir"), F.col("permitted"))
    return paths.first_readable(_pages(spark, sf_dir), ok, "page_id").select("page_id", "path")


@_query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P') WHERE n = 1")
def first_series_per_key(spark, sf_dir):
    files = _table(spark, sf_dir, "orders").withColumn("has_pixels", F.col("o_orderstatus") != "P")
    return paths.first_series(paths.with_pixels(files), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@_query("WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id::VARCHAR ELSE event_type END AS said FROM events) SELECT event_id, coalesce(try_cast(said AS INT), -5)::INT AS idx FROM e")
def parse_or_keep(spark, sf_dir):
    said = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(F.col("event_type"))
    return _events(spark, sf_dir).select("event_id", scalar.parse_or_keep(said, L(-5)).alias("idx"))


@_query(
    "WITH l AS (SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM l) "
    "SELECT user_id, event_type, n::INT AS rank FROM r WHERE n <= 2"
)
def mru_topk(spark, sf_dir):
    return ev.mru_topk(_events(spark, sf_dir), ["user_id"], "event_type", ["ts", "event_id"], 2)


@_query("SELECT regexp_extract(url, '[^/]*$') AS name, url FROM (SELECT url, max(page_id) AS last FROM pages GROUP BY url ORDER BY last DESC LIMIT 10)")
def recent_files(spark, sf_dir):
    return ev.mru_topk(_table(spark, sf_dir, "pages"), [], "url", ["page_id"]).select(scalar.basename(F.col("url")).alias("name"), "url")


@_query(
    "WITH l AS (SELECT url, max(page_id) AS last, max(page_id % 2) AS late FROM pages GROUP BY url), o AS (SELECT url, max(page_id) AS last FROM pages WHERE page_id % 2 = 1 GROUP BY url) "
    "SELECT url, row_number() OVER (ORDER BY late DESC, coalesce(o.last, l.last) DESC)::INT AS rank FROM l LEFT JOIN o USING (url) ORDER BY rank LIMIT 10"
)
def saved_recent(spark, sf_dir):
    """A list that is restored, merged and saved twice: the pages of even ids are opened in one session, those of odd ids in the next."""
    folder, pages = shared.new_dir(spark, "recent"), _table(spark, sf_dir, "pages").select("page_id", "url")
    for session in (0, 1):
        before = saved.current(spark, folder)
        kept = saved.restore(spark, folder, "url string, rank int")
        saved.save(saved.merged(kept, pages.where(F.col("page_id") % 2 == session), "url", ["page_id"]), folder, before)
    return saved.restore(spark, folder)


@_query("SELECT event_id FROM (SELECT event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts AS gap FROM events) WHERE gap IS NULL OR gap >= INTERVAL 1 HOUR")
def debounce(spark, sf_dir):
    return ev.debounce(_events(spark, sf_dir), ["user_id"], 3600).select("event_id")


@_query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM before")
def dedupe_consecutive(spark, sf_dir):
    return ev.dedupe_consecutive(_events(spark, sf_dir), ["user_id"], ["event_type"], ["ts", "event_id"]).select("event_id", "event_type")


@_query("WITH b AS (SELECT *, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS baseline FROM events) SELECT event_id, baseline, CASE WHEN event_type = 'click' THEN baseline ELSE value END AS shown FROM b")
def baseline_retained(spark, sf_dir):
    e = ev.baseline_retained(_events(spark, sf_dir), ["user_id"], "value", ["ts", "event_id"]).withColumn("shown", F.col("value"))
    kind = F.when(F.col("event_type") == "click", "reset").otherwise("edit")
    return ev.reset_to_baseline(e.withColumn("kind", kind), "shown").select("event_id", "baseline", "shown")


@_query(
    "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS x, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS y, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS z "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
)
def combine_latest(spark, sf_dir):
    return ev.combine_latest(_events(spark, sf_dir), ["user_id"], {"click": "x", "view": "y", "purchase": "z"}, "value", ["ts", "event_id"], "event_type").select("event_id", "x", "y", "z")


_VIEW = "['VOLUME', 'YZ', 'XZ', 'XY'][(event_id % 4) + 1]"


def _view():
    k = F.col("event_id") % 4
    return F.when(k == 0, "VOLUME").when(k == 1, "YZ").when(k == 2, "XZ").otherwise("XY")


@_query(f"SELECT event_id, target, value FROM events, unnest(['VOLUME', 'YZ', 'XZ', 'XY']) AS t(target) WHERE target <> {_VIEW}")
def fanout_except_source(spark, sf_dir):
    return ev.fanout_except_source(_events(spark, sf_dir), _view()).select("event_id", "target", "value")


@_query("SELECT vec_id, unnest(['VOLUME', 'YZ', 'XZ', 'XY']) AS view FROM embeddings")
def image_to_views(spark, sf_dir):
    return ev.to_all_views(_table(spark, sf_dir, "embeddings").select("vec_id"))


@_query("SELECT event_id, value AS win, 'CONTROLLER' AS target, 'propagated' AS origin FROM events WHERE event_id % 4 = 0")
def controller_echo(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.col("value").alias("win"), _view().alias("view"), L("user").alias("origin"))
    return ev.echoed(e).select("event_id", "win", "target", "origin")


@_query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN 'shading' WHEN event_id % 5 IN (2, 3) AND event_id % 3 <> 0 THEN 'reset' END AS command FROM events")
def key_commands(spark, sf_dir):
    key = F.get(F.array(*map(L, "sSrRx")), (F.col("event_id") % 5).cast("int"))
    return _events(spark, sf_dir).select("event_id", ev.key_command(key, F.col("event_id") % 3 == 0).alias("command"))


@_query(
    f"WITH e AS (SELECT event_id, user_id, ts, coalesce(value, 0) AS value, {_VIEW} AS view, CASE event_id % 50 WHEN 0 THEN 'link' WHEN 7 THEN 'link' WHEN 25 THEN 'unlink' ELSE 'edit' END AS kind FROM events), "
    "s AS (SELECT *, coalesce(last_value(CASE WHEN kind <> 'edit' THEN kind = 'link' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS linked FROM e), "
    "t AS (SELECT *, unnest(['YZ', 'XZ', 'XY']) AS target FROM s), "
    "c AS (SELECT *, CASE WHEN kind = 'link' AND NOT linked THEN 1000 WHEN kind = 'edit' AND view <> 'VOLUME' AND (linked OR view = target) THEN value END::DOUBLE AS w, CASE WHEN kind = 'link' AND NOT linked THEN 500 WHEN kind = 'edit' AND view <> 'VOLUME' AND (linked OR view = target) THEN -value END::DOUBLE AS l FROM t) "
    "SELECT event_id, target, last_value(w IGNORE NULLS) OVER k AS shown_window, last_value(l IGNORE NULLS) OVER k AS shown_level FROM c WINDOW k AS (PARTITION BY user_id, target ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
)
def linked_views(spark, sf_dir):
    """Slice views that share one window and level from link to unlink."""
    k = F.col("event_id") % 50
    kind = F.when(k.isin(0, 7), "link").when(k == 25, "unlink").otherwise("edit")
    value = F.coalesce("value", D(0))
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts", _view().alias("view"), kind.alias("kind"), value.alias("window"), (-value).alias("level"))
    return ev.linked(e, ["user_id"], ["ts", "event_id"]).select("event_id", "target", "shown_window", "shown_level")


_FRAMES = "f AS (SELECT DISTINCT user_id, event_type AS frame, CASE WHEN length(event_type) % 2 = 1 THEN 'Live' WHEN user_id % 3 = 0 THEN 'Disabled' ELSE 'EndOnly' END AS mode FROM events)"


@_query(f"WITH {_FRAMES} SELECT event_id, p.frame AS peer FROM events e JOIN f s ON s.user_id = e.user_id AND s.frame = e.event_type JOIN f p ON p.user_id = e.user_id WHERE s.mode <> 'Disabled' AND p.mode <> 'Disabled' AND p.frame <> e.event_type")
def broadcast_peers(spark, sf_dir):
    mode = F.when(F.length("event_type") % 2 == 1, "Live").when(F.col("user_id") % 3 == 0, "Disabled").otherwise("EndOnly")
    e = _events(spark, sf_dir).select("event_id", "user_id", F.col("event_type").alias("frame"), mode.alias("link_mode"))
    frames = e.select("user_id", "frame", "link_mode").distinct()
    return ev.broadcast_peers(e, frames, "user_id").select("event_id", "peer")


@_query(f"SELECT user_id, arg_max({_VIEW}, (ts, event_id)) AS selected FROM events GROUP BY user_id")
def exclusive_selection(spark, sf_dir):
    return ev.exclusive_selection(_events(spark, sf_dir).withColumn("view", _view()), ["user_id"], "view", ["ts", "event_id"])


@_query("SELECT event_id, value FROM events WHERE value > 20")
def gated_events(spark, sf_dir):
    return ev.gated(_events(spark, sf_dir), F.col("value") > 20).select("event_id", "value")


@_query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def last_of_batch(spark, sf_dir):
    return ev.last_of_batch(_events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@_query("SELECT event_id, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 2 = 1 AS shaded FROM events")
def shading_toggle(spark, sf_dir):
    return ev.toggled(_events(spark, sf_dir), ["user_id"], F.col("event_type") == "click", ["ts", "event_id"]).select("event_id", F.col("on").alias("shaded"))


@_query("SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0")
def committed_user_edits(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("origin", F.when(F.col("event_id") % 2 == 0, "user").otherwise("propagated"))
    return ev.user_only(ev.committed(e, "purchase", "event_type")).select("event_id", "event_type", "value")


@_query(
    "WITH i AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('click', 'view') THEN '--' ELSE event_type END AS item FROM events), k AS (SELECT *, row_number() OVER w AS n, lag(item) OVER w AS before FROM i WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS back FROM k WHERE item <> '--' OR (n > 1 AND before <> '--')) "
    "SELECT user_id, string_agg(item, '|' ORDER BY n) AS items FROM c WHERE NOT (back = 1 AND item = '--') GROUP BY user_id"
)
def separator_collapse(spark, sf_dir):
    item = F.when(F.col("event_type").isin("click", "view"), "--").otherwise(F.col("event_type"))
    lists = _events(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", item.alias("item")))), lambda x: x["item"]).alias("items"))
    out = lists.select("user_id", scalar.separator_collapse(F.col("items")).alias("items"))
    return out.where(F.size("items") > 0).select("user_id", F.array_join("items", "|").alias("items"))


@_query("WITH c AS (SELECT x::INT AS x, y::INT AS y, z::INT AS z FROM range(64) a(x), range(128) b(y), range(32) d(z)) SELECT x, y, z, round(255 * cos(2 * pi() / 32 * (0.5 * x - 0.5 * y + z / sqrt(2))), 6) AS v FROM c WHERE z = 15")
def sinusoid_slice(spark, sf_dir):
    return synthetic.sinusoid(spark).where("z = 15").select("x", "y", "z", F.round("v", 6).alias("v"))


@_query(
    f"WITH {RASTER}, o AS (SELECT vec_id, pos, least(abs(v), 1) AS o, v AS c FROM r), t AS (SELECT *, coalesce(exp(sum(ln(1 - least(o, 0.999999999))) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS clear FROM o) "
    "SELECT vec_id, round(sum(clear * o * c), 6) AS colour FROM t GROUP BY vec_id"
)
def ray_composite(spark, sf_dir):
    return _composited(_raster(spark, sf_dir))


def _composited(r: DataFrame) -> DataFrame:
    cells = r.select(L(0).alias("image_id"), F.col("vec_id").alias("x"), L(0).alias("y"), F.col("pos").alias("z"), F.least(F.abs("v"), D(1)).alias("o"), F.col("v").alias("c"))
    return transfer.composite(cells, "o", "c").select(F.col("x").alias("vec_id"), F.round("colour", 6).alias("colour"))


@_query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1.0 ELSE value END::DOUBLE AS v FROM events")
def finite_guard(spark, sf_dir):
    odd = F.when(F.col("event_id") % 6 == 0, D("nan")).when(F.col("event_id") % 3 == 0, D("-inf")).otherwise(F.col("value"))
    return _events(spark, sf_dir).select("event_id", scalar.finite_or(odd, D(-1)).alias("v"))


@_query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE floor(least(greatest((l_extendedprice - 900) * 0.5, 0), 65535)) BETWEEN 1000 AND 2000")
def mapped_predicate(spark, sf_dir):
    """A range of mapped values as a range of native ones, which the Parquet scan prunes by."""
    return _table(spark, sf_dir, "lineitem").where(mapping.mapped_between(F.col("l_extendedprice"), 1000, 2000, -900.0, 0.5)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@_query(f"WITH {RASTER}, p AS (SELECT vec_id, string_agg(round(v, 6)::DECIMAL(20, 6)::VARCHAR, ',' ORDER BY pos) AS data FROM r GROUP BY vec_id) SELECT vec_id, md5(data) AS md5 FROM p")
def brick_round_trip(spark, sf_dir):
    cells = _raster(spark, sf_dir).select(F.col("vec_id").alias("image_id"), (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), L(0).alias("z"), "v")
    back = synthetic.to_bricks(synthetic.to_voxels(synthetic.to_bricks(cells), 8))
    text = F.array_join(F.transform("data", lambda v: F.round(v, 6).cast("decimal(20,6)").cast("string")), ",")
    return back.select(F.col("image_id").alias("vec_id"), F.md5(text).alias("md5"))


@_query(
    "SELECT event_id, row_number() OVER w AS n, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS click, first_value(value) OVER w AS baseline, lag(event_type) OVER (ORDER BY ts, event_id) AS before "
    "FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
)
def one_key_scan(spark, sf_dir):
    """All events as those of one image, in blocks of about 500 that are scanned by different tasks."""
    e = _events(spark, sf_dir).select("event_id", L(1).alias("image_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    key, order = ["image_id"], ["ts", "event_id"]
    columns = {"n": scan.total(L(1)), "click": scan.last(F.when(F.col("event_type") == "click", F.col("value"))), "baseline": scan.first(F.col("value")), "before": scan.before(F.col("event_type"))}
    out = scan.scanned(e, key, order, columns, scan.blocks_of(e, key, order, 500))
    return out.select("event_id", "n", "click", "baseline", F.col("before.v").alias("before"))


_CONTROL = "e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'window' WHEN 'view' THEN 'level' WHEN 'error' THEN 'interactive' WHEN 'purchase' THEN 'commit' ELSE event_type END AS kind, CASE WHEN event_type = 'error' THEN event_id % 3 ELSE value END::DOUBLE AS value FROM events)"


@_query(
    f"WITH {_CONTROL}, g AS (SELECT *, kind IN ('window', 'level') AND value IS NOT NULL AND coalesce(last_value(CASE WHEN kind = 'interactive' THEN value <> 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), true) AS starts FROM e), "
    "n AS (SELECT *, first_value(CASE WHEN starts THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM g), "
    "b AS (SELECT event_id, user_id, ts, kind, value FROM e UNION ALL SELECT event_id, user_id, ts + INTERVAL 5 HOUR, 'fire', NULL FROM n WHERE starts AND (after IS NULL OR after >= ts + INTERVAL 5 HOUR)), "
    "v AS (SELECT *, last_value(CASE WHEN kind = 'window' THEN value END IGNORE NULLS) OVER w AS win, last_value(CASE WHEN kind = 'level' THEN value END IGNORE NULLS) OVER w AS level FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, kind <> 'fire', event_id ROWS UNBOUNDED PRECEDING)) "
    "SELECT user_id, event_id, epoch_us(ts) AS micros, CASE kind WHEN 'fire' THEN 'changed' ELSE 'committed' END AS told, win, level FROM v WHERE kind IN ('fire', 'commit') AND win IS NOT NULL AND level IS NOT NULL"
)
def wl_controller(spark, sf_dir):
    """Edits behind a restartable timer and a gate, and commits."""
    t = F.col("event_type")
    kind = F.when(t == "click", "window").when(t == "view", "level").when(t == "error", "interactive").when(t == "purchase", "commit").otherwise(t)
    value = F.when(t == "error", (F.col("event_id") % 3).cast("double")).otherwise(F.col("value"))
    e = _events(spark, sf_dir).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), value.alias("value"))
    out = timers.controller(e, "user_id", 5 * 3600 * 1000)
    return out.select("user_id", "event_id", F.unix_micros("ts").alias("micros"), "told", F.col("window").alias("win"), "level")


_BUS = (
    "e AS (SELECT event_id, ts, user_id AS frame, CASE event_type WHEN 'click' THEN 'register' WHEN 'view' THEN 'register' WHEN 'error' THEN 'unregister' ELSE 'edit' END AS kind, (user_id + event_id % 2) % 40 AS image_id, "
    "CASE event_id % 5 WHEN 0 THEN 'Disabled' WHEN 1 THEN 'EndOnly' ELSE 'Live' END AS link_mode, value FROM events)"
)


@_query(
    f"WITH {_BUS}, c AS (SELECT *, lead((ts, event_id)) OVER (PARTITION BY frame ORDER BY ts, event_id) AS until FROM e WHERE kind <> 'edit'), d AS (SELECT * FROM e WHERE kind = 'edit' AND link_mode <> 'Disabled') "
    "SELECT event_id, frame AS target, value AS win, -value AS level FROM d UNION ALL SELECT d.event_id, c.frame, d.value, -d.value FROM d JOIN c ON c.kind = 'register' AND c.link_mode <> 'Disabled' AND c.image_id = d.image_id AND c.frame <> d.frame "
    "AND (d.ts, d.event_id) > (c.ts, c.event_id) AND (c.until IS NULL OR (d.ts, d.event_id) < c.until) AND d.ts < c.ts + INTERVAL 5 DAY"
)
def bus_broadcast(spark, sf_dir):
    """Edits told to the frames of the same image that are registered at that moment, the sender among them."""
    t, k = F.col("event_type"), F.col("event_id") % 5
    kind = F.when(t.isin("click", "view"), "register").when(t == "error", "unregister").otherwise("edit")
    mode = F.when(k == 0, "Disabled").when(k == 1, "EndOnly").otherwise("Live")
    image = (F.col("user_id") + F.col("event_id") % 2) % 40
    e = _events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("frame"), kind.alias("kind"), image.alias("image_id"), mode.alias("link_mode"), F.col("value").alias("window"), (-F.col("value")).alias("level"))
    expire = 5 * 24 * 3600
    return registry.broadcast(e, registry.intervals(e, expire), expire).select("event_id", "target", F.col("window").alias("win"), "level")


# the embeddings as one volume of 8 by 8 samples a plane, a plane for each vector
_VOLUME = "c AS (SELECT u.pos::INT % 8 AS x, u.pos::INT // 8 AS y, vec_id::INT AS z, embedding[u.pos + 1]::DOUBLE AS v FROM embeddings, unnest(range(0, len(embedding))) AS u(pos))"


def _blocked(spark, sf_dir) -> DataFrame:
    """The volume written in the blocked layout, and read back."""
    planes = _table(spark, sf_dir, "embeddings").select(L(0).cast("long").alias("image_id"), F.col("vec_id").cast("int").alias("z"), F.col("embedding").cast("array<double>").alias("data"))
    path = f"{shared.new_dir(spark, 'blocks')}/data"
    blocks.write(blocks.from_planes(planes, 8, (4, 4, 32)), path, 8)
    return blocks.read(spark, path)


@_query(f"WITH {_VOLUME} SELECT y AS u, z AS v, v AS value FROM c WHERE x = 5")
def blocked_slice(spark, sf_dir):
    """A plane across all planes of the file's order: only the blocks that it cuts are read."""
    return blocked.plane_samples(blocked.slice_plane(_blocked(spark, sf_dir), "YZ", 5)).select("u", "v", "value")


@_query(f"WITH {_VOLUME} SELECT x, y, z, v FROM c WHERE x BETWEEN 1 AND 2 AND y BETWEEN 3 AND 6 AND z BETWEEN 30 AND 170")
def blocked_box(spark, sf_dir):
    return blocked.samples(blocked.crop(_blocked(spark, sf_dir), {"x": (1, 2), "y": (3, 6), "z": (30, 170)})).select("x", "y", "z", "v")


@_query(f"WITH {_VOLUME} SELECT x, y, z, v FROM c WHERE v BETWEEN 0.25 AND 9")
def blocked_values(spark, sf_dir):
    """A range of values: blocks are chosen by their zone map."""
    return blocked.valued_between(_blocked(spark, sf_dir), 0.25, 9.0).select("x", "y", "z", "v")


@_query(f"WITH {_VOLUME} SELECT x, y, z, v FROM c WHERE floor(least(greatest((v + 0.5) * 20000, 0), 65535)) BETWEEN 12000 AND 14999")
def blocked_mapped(spark, sf_dir):
    """A range of mapped values on the blocked volume."""
    return blocked.mapped_between(_blocked(spark, sf_dir), 12000, 14999, 0.5, 20000.0).select("x", "y", "z", "v")


@_query(f"WITH {_VOLUME} SELECT z // 32 AS block, min(v) AS vmin, max(v) AS vmax FROM c GROUP BY ALL")
def blocked_ranges(spark, sf_dir):
    """Ranges from the zone map; no sample is read."""
    return blocked.ranges(_blocked(spark, sf_dir).withColumn("block", F.floor(F.col("z0") / 32).cast("int")), "block")


@_query(
    f"WITH {_VOLUME}, o AS (SELECT x, y, z, 1 - pow(1 - least(abs(v), 0.95::DOUBLE) * 0.1::DOUBLE, 0.5::DOUBLE) AS o, v AS k FROM c), t AS (SELECT *, exp(sum(ln(1 - o)) OVER w) / (1 - o) AS clear FROM o WINDOW w AS (PARTITION BY x, y ORDER BY z ROWS UNBOUNDED PRECEDING)) "
    "SELECT x, y, round(sum(clear * o * k), 6) AS colour, round(1 - exp(sum(ln(1 - o))), 6) AS opacity FROM t GROUP BY x, y"
)
def blocked_composite(spark, sf_dir):
    """Rays through all planes, from one pair a ray and block; a step is half the unit distance."""
    rays = blocked.composite(_blocked(spark, sf_dir), [(-0.95, 0.095), (0.0, 0.0), (0.95, 0.095)], [(-100.0, -100.0), (100.0, 100.0)], step_over_unit=0.5)
    return rays.select("x", "y", F.round("colour", 6).alias("colour"), F.round("opacity", 6).alias("opacity"))


@_query(
    f"WITH {_VOLUME}, g AS (SELECT i::INT AS u, j::INT AS v, z, -1.5::DOUBLE + i + 0.01::DOUBLE * z AS pu, 0.25::DOUBLE + j - 0.005::DOUBLE * z AS pv FROM range(9) a(i), range(8) b(j), (SELECT DISTINCT z FROM c)), "
    "s AS (SELECT u, g.v AS j, g.z, sum(c.v * (1 - abs(pu - x)) * (1 - abs(pv - y))) / sum((1 - abs(pu - x)) * (1 - abs(pv - y))) AS value FROM g JOIN c ON c.z = g.z AND abs(pu - x) < 1 AND abs(pv - y) < 1 WHERE pu > -0.5000001 AND pu <= 7.5000001 AND pv > -0.5000001 AND pv <= 7.5000001 GROUP BY ALL), "
    "o AS (SELECT u, j, z, 1 - pow(1 - least(abs(value), 0.95::DOUBLE) * 0.2::DOUBLE, 0.75::DOUBLE) AS o, value AS k FROM s), t AS (SELECT *, exp(sum(ln(1 - o)) OVER w) / (1 - o) AS clear FROM o WINDOW w AS (PARTITION BY u, j ORDER BY z ROWS UNBOUNDED PRECEDING)) "
    "SELECT u, j AS v, round(sum(clear * o * k), 6) AS colour, round(1 - exp(sum(ln(1 - o))), 6) AS opacity FROM t GROUP BY u, j"
)
def oblique_composite(spark, sf_dir):
    """Rays at an angle to all axes, through values interpolated in each plane."""
    cells = synthetic.to_voxels(_table(spark, sf_dir, "embeddings").select(L(0).alias("image_id"), F.col("vec_id").cast("int").alias("z"), F.col("embedding").alias("data")), 8)
    rays = transfer.oblique(cells, (9, 8), [(-0.95, 0.19), (0.0, 0.0), (0.95, 0.19)], [(-100.0, -100.0), (100.0, 100.0)], (0.01, -0.005), (-1.5, 0.25), step_over_unit=0.75)
    return rays.select("u", "v", F.round("colour", 6).alias("colour"), F.round("opacity", 6).alias("opacity"))


# views of the plane of all vectors (u: position, v: vector) on a finer and on a coarser grid than the samples
_GRIDS = {"fine": (40, 50, (0.25, 0.5), (0.375, 0.3)), "coarse": (20, 60, (1.0, 0.75), (3.0, 2.5))}
_NEAREST = "CASE WHEN {t} > -0.5 AND {t} <= 0.5 THEN 1.0 ELSE 0.0 END"
_LINEAR = "greatest(1 - abs({t}), 0)"
_CUBIC = "CASE WHEN abs({t}) <= 1 THEN 1.5 * abs({t}) ** 3 - 2.5 * abs({t}) ** 2 + 1 WHEN abs({t}) < 2 THEN -0.5 * abs({t}) ** 3 + 2.5 * abs({t}) ** 2 - 4 * abs({t}) + 2 ELSE 0 END"


def _view_sql(weight: str) -> str:
    grids = " UNION ALL ".join(
        f"SELECT '{name}' AS grid, a.i::INT AS i, b.j::INT AS j, {u0}::DOUBLE + a.i * {du}::DOUBLE AS pu, {v0}::DOUBLE + b.j * {dv}::DOUBLE AS pv FROM range({w}) a(i), range({h}) b(j)" for name, (w, h, (u0, v0), (du, dv)) in _GRIDS.items()
    )
    kernel = lambda t: "(" + weight.format(t=f"({t})") + ")"
    return (
        f"WITH {RASTER}, g AS ({grids}), s AS (SELECT grid, i, j, v, {kernel('pu - pos')} * {kernel('pv - vec_id')} AS w FROM g JOIN r ON pos > pu - 2 AND pos < pu + 2 AND vec_id > pv - 2 AND vec_id < pv + 2) "
        "SELECT grid, i, j, round(sum(w * v) / sum(w), 6) AS value FROM s GROUP BY ALL"
    )


def _views(spark, sf_dir, mode: str) -> DataFrame:
    plane = _raster(spark, sf_dir).select(L(0).cast("long").alias("image_id"), F.col("pos").alias("u"), F.col("vec_id").cast("int").alias("v"), F.col("v").alias("value"))
    views = [selection.resampled(plane, w, h, first, step, mode).select(L(name).alias("grid"), F.col("u").alias("i"), F.col("v").alias("j"), F.round("value", 6).alias("value")) for name, (w, h, first, step) in _GRIDS.items()]
    return views[0].unionByName(views[1])


@_query(_view_sql(_NEAREST))
def view_nearest(spark, sf_dir):
    return _views(spark, sf_dir, "Nearest")


@_query(_view_sql(_LINEAR))
def view_linear(spark, sf_dir):
    return _views(spark, sf_dir, "Linear")


@_query(_view_sql(_CUBIC))
def view_cubic(spark, sf_dir):
    return _views(spark, sf_dir, "Cubic")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges, shift and scale, mapped samples, baseline window and opacity of a raster, end to end."""
    r = _raster(spark, sf_dir)
    s = mapping.scalar_range(r, "v", "vec_id")
    shift, scale = mapping.shift_scale_params(L("double"), F.col("vmin"), F.col("vmax"))
    w, l = mapping.baseline_wl(F.col("vmin"), F.col("vmax"))
    params = s.select("vec_id", "vmin", "vmax", shift.alias("shift"), scale.alias("scale"), w.alias("win"), l.alias("level"))
    v = F.col("v")
    return r.join(params, "vec_id").select("vec_id", "pos", mapping.shift_scale_u16(v, F.col("shift"), F.col("scale")).alias("mapped"), transfer.opacity(v, F.col("win"), F.col("level"), F.col("vmin"), F.col("vmax")).alias("opacity"))
