from math import nan, pi, sqrt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake.functions import scalar, vector
from voxlake.operators import geometry, mapping, selection, transfer
from voxlake.sources import paths, synthetic
from voxlake.streaming import events as ev

D = lambda x: F.lit(float(x))


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


GRIDS = [
    ("uchar", [0, 255], 0, 1, [0, 255]),
    ("ushort", [0, 65535], 0, 1, [0, 65535]),
    ("schar", [-128, 127], 128, 1, [0, 255]),
    ("short", [-32768, 0, 32767], 32768, 1, [0, 32768, 65535]),
    ("int", [-10, 10], 10, 1, [0, 20]),
    ("int", [0, 131070], 0, 0.5, [0, 65535]),
    ("int", [100000, 100100], 0, 1, [65535, 65535]),  # out of range stays out of range: nothing is shifted down
    ("double", [7, 7], 0, 1, [7, 7]),
    ("double", [nan, 1, -1], 1, 1, None),
]


@pytest.mark.parametrize("kind,values,shift,scale,expected", GRIDS)
def test_shift_scale_by_type(spark, kind, values, shift, scale, expected):
    voxels = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "image_id long, x int, v double")
    s = mapping.scalar_range(voxels, "v", "image_id").withColumn("t", F.lit(kind))
    a, b = mapping.shift_scale_params(F.col("t"), F.col("vmin"), F.col("vmax"))
    assert tuple(s.select(a, b).first()) == (shift, scale)
    if expected:
        got = mapping.mapped(voxels, spark.createDataFrame([(1, kind)], "image_id long, scalar_type string"))
        assert [r.mapped for r in got.orderBy("x").collect()] == expected


def test_range_of_nothing_is_zero_to_one(spark):
    empty = spark.createDataFrame([(1, nan)], "image_id long, v double")
    assert tuple(mapping.scalar_range(empty, "v").first()) == (0.0, 1.0)


def test_sinusoid_chain(spark):
    v = synthetic.sinusoid(spark)
    r = mapping.scalar_range(v, "v")
    shift, scale = mapping.shift_scale_params(F.lit("double"), F.col("vmin"), F.col("vmax"))
    w, l = mapping.baseline_wl(F.col("vmin"), F.col("vmax"))
    got = r.select("vmin", "vmax", shift, scale, w, l).first()
    assert v.count() == 64 * 128 * 32
    assert [round(x, 9) + 0 for x in got] == [-255, 255, 255, 1, 499.8, 0]
    assert v.where("x = 3 and y = 5 and z = 7").first().v == pytest.approx(255 * __import__("math").cos(2 * pi / 32 * (1.5 - 2.5 + 7 / sqrt(2))))


WL = [(100, 50, 0, 200, 0, 0.0), (100, 50, 0, 200, 50, 0.5), (100, 50, 0, 200, 150, 1.0), (-100, 50, 0, 200, 25, 0.75), (0, 50, 0, 200, 50, 0.0), (0, 50, 0, 200, 51, 1.0), (10, -500, 0, 200, 3, 1.0), (10, 900, 0, 200, 3, 0.0), (1000, 100, 0, 200, 100, 0.5)]


@pytest.mark.parametrize("w,l,lo,hi,v,expected", WL)
def test_opacity(spark, w, l, lo, hi, v, expected):
    assert one(spark, transfer.opacity(D(v), D(w), D(l), D(lo), D(hi)))[0] == pytest.approx(expected)


def test_nodes_evaluate_like_the_ramp(spark):
    nodes = transfer.opacity_nodes(D(100), D(50), D(0), D(200))
    for v in (-5, 0, 30, 100, 250):
        a, b = one(spark, transfer.evaluate(nodes, D(v)), transfer.opacity(D(v), D(100), D(50), D(0), D(200)))
        assert a == pytest.approx(b)
    remapped = transfer.tf_remap(nodes, D(10), D(2))
    assert [n.x for n in one(spark, remapped)[0]] == [20, 20, 220, 420]
    assert one(spark, transfer.evaluate(transfer.default_nodes(), D(65535 / 2)))[0] == 0.5


@pytest.mark.parametrize("lo,hi,a,b,x,y", [(2, 8, 0, 9, 2, 8), (8, 2, 0, 9, 2, 8), (-5, 50, 0, 9, 0, 9), (4, 4, 0, 9, 4, 5), (9, 9, 0, 9, 8, 9), (3, 3, 3, 3, 3, 3)])
def test_crop_bounds(spark, lo, hi, a, b, x, y):
    assert one(spark, *selection.crop_normalize(*map(F.lit, (lo, hi, a, b)))) == (x, y)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(2, 5000), st.floats(-1e4, 1e4), st.floats(-100, 100), st.floats(0.5, 1))
def test_mapped_and_back(spark, w, l, shift, scale):
    m = mapping.wl_native_to_mapped(D(w), D(l), D(shift), D(scale))
    assert one(spark, *mapping.wl_mapped_to_native(*m, D(shift), D(scale))) == pytest.approx((w, l), rel=1e-6, abs=1e-6)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(-50, 50), st.integers(-50, 50), st.integers(-20, 20), st.integers(0, 20))
def test_crop_stays_inside(spark, lo, hi, a, width):
    x, y = one(spark, *selection.crop_normalize(*map(F.lit, (lo, hi, a, a + width))))
    assert a <= x <= y <= a + width and (x < y or width == 0)


def test_window_floors_differ(spark):
    assert one(spark, *mapping.wl_native_to_mapped(D(0.1), D(0), D(0), D(1)))[0] == pytest.approx(0.1)
    assert one(spark, *mapping.wl_native_to_mapped(D(0.1), D(0), D(0), D(1), 1.0))[0] == 1.0
    assert one(spark, *mapping.wl_drag(D(1), D(1), D(0), D(0), D(-1000), D(0), D(100), D(100)))[0] == 0.01


def test_mapped_between_is_the_mapped_test(spark):
    df = spark.range(-300, 300).select((F.col("id") / 3).alias("v"))
    a = df.where(mapping.mapped_between(F.col("v"), 5, 20, 10.0, 0.25)).count()
    assert a == df.where(mapping.shift_scale_u16(F.col("v"), D(10), D(0.25)).between(5, 20)).count()


def test_axis_ties_and_tolerance(spark):
    v = lambda *x: F.array(*map(D, x))
    assert one(spark, geometry.aligned_axis(v(1, 1, 0)), geometry.aligned_axis(v(1, 1, 0), 0.1), geometry.aligned_axis(v(0, 0, 0)), geometry.aligned_axis(v(0, 0, -2), 0.1)) == (0, -1, -1, 2)


def test_vectors(spark):
    v = lambda *x: F.array(*map(D, x))
    r, u = vector.camera_basis(v(0, 1, 0), v(0, 2, 0))  # up along the direction, and so is y: no basis
    assert one(spark, vector.cross(v(1, 0, 0), v(0, 1, 0)))[0] == [0, 0, 1]
    r, u = vector.camera_basis(v(0, 0, -1), v(0, 0, 5))
    assert one(spark, r, u) == ([1, 0, 0], [0, 1, 0])


def test_planes_keep_shared_samples(spark):
    v = synthetic.sinusoid(spark, 4, 5, 6)
    p = selection.three_planes(v, 1, 2, 3)
    assert p.count() == 5 * 6 + 4 * 6 + 4 * 5
    assert selection.slice_plane(v, "XZ", 2).count() == 4 * 6
    for mode in ("Nearest", "Linear"):
        assert sorted(r.v for r in selection.sampled(v, 2.0, "z", mode).collect()) == pytest.approx(sorted(r.v for r in v.where("z = 2").collect()))
    half = selection.sampled(v, 2.5, "z").where("x = 1 and y = 1").first().v
    assert half == pytest.approx(v.where("x = 1 and y = 1 and z in (2, 3)").agg({"v": "avg"}).first()[0])


def test_bricks_and_default_volume(spark):
    v = synthetic.sinusoid(spark, 4, 3, 2)
    assert synthetic.to_voxels(synthetic.to_bricks(v), 4).select(*v.columns).exceptAll(v).isEmpty()
    extent = "struct<x0:int,x1:int,y0:int,y1:int,z0:int,z1:int>"
    flat = spark.createDataFrame([(1, (0, 3, 0, 0, 0, 1))], f"image_id long, extent {extent}")
    assert synthetic.or_default(spark, flat, v).count() == 262144
    good = spark.createDataFrame([(1, (2, 3, 1, 2, 0, 1))], f"image_id long, extent {extent}")
    assert synthetic.or_default(spark, good, v).count() == v.count()


def test_composite(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 0.5, 1.0), (1, 0, 0, 1, 0.5, 2.0)], "image_id long, x int, y int, z int, o double, c double")
    assert tuple(transfer.composite(cells, "o", "c").first()) == (1, 0, 0, 1.0, 0.75)


def test_paths(spark):
    names = ["a.isq", "A.ISQ", "b.rsq", "c.aim", "d.dcm", "e.DICOM", "f.txt", "folder", "locked.dcm", None]
    df = spark.createDataFrame([(i, n, n == "folder", n != "locked.dcm") for i, n in enumerate(names)], "pos int, path string, is_dir boolean, permitted boolean")
    probe = paths.readable_probe(F.col("path"), F.lit(True), F.col("is_dir"), F.col("permitted"))
    assert [r[0] for r in df.orderBy("pos").select(probe).collect()] == [True] * 6 + [False, True, False, False]
    assert [r[0] for r in df.orderBy("pos").select(paths.format_dispatch(F.col("path"), F.col("is_dir"))).collect()] == ["ISQ"] * 4 + ["DICOM"] * 6
    assert paths.first_readable(df.where("pos > 5"), probe, "pos").first().path == "folder"


def test_texts(spark):
    items = lambda *x: F.array(*map(F.lit, x))
    got = one(spark, scalar.separator_collapse(items("--", "a", "--", "--", "b", "--")), scalar.separator_collapse(items("--")), scalar.parse_or_keep(F.lit(" 12 "), F.lit(3)), scalar.parse_or_keep(F.lit("x1"), F.lit(3)), scalar.parse_or_keep(F.lit("99999999999"), F.lit(3)), scalar.centre_index(F.lit(-3), F.lit(0)))
    assert got == (["a", "--", "b"], [], 12, 3, 3, -1)


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ms long, value double").select("event_id", F.lit(1).alias("k"), F.timestamp_millis("ms").alias("ts"), "value")


def test_debounce_at_exactly_the_gap(spark):
    e = events(spark, [(1, 0, 1.0), (2, 59, 2.0), (3, 119, 3.0), (4, 178, 4.0)])
    assert sorted(r.event_id for r in ev.debounce(e, ["k"], 0.06).collect()) == [2, 4]


def test_dedupe_is_consecutive_and_idempotent(spark):
    e = events(spark, [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 2.0), (4, 3, 1.0), (5, 4, None), (6, 5, None)])
    out = ev.dedupe_consecutive(e, ["k"], ["value"], ["ts", "event_id"])
    again = ev.dedupe_consecutive(out, ["k"], ["value"], ["ts", "event_id"])
    assert sorted(r.event_id for r in out.collect()) == sorted(r.event_id for r in again.collect()) == [1, 3, 4, 5]


def test_recent_list_survives_a_round_trip(spark, tmp_path):
    opened = spark.createDataFrame([(i, f"/d/f{i % 13}.isq") for i in range(40)], "n long, path string")
    out = ev.mru_topk(opened, [], "path", ["n"])
    ev.save_recent(spark, out, str(tmp_path / "recent"))
    got = [r.path for r in ev.restore_recent(spark, str(tmp_path / "recent")).orderBy("rank").collect()]
    assert got == [f"/d/f{i % 13}.isq" for i in range(39, 29, -1)]


def test_recent_list_is_cleared(spark, tmp_path):
    opened = spark.createDataFrame([(1, "a.isq")], "n long, path string")
    ev.save_recent(spark, ev.mru_topk(opened, [], "path", ["n"]), str(tmp_path / "recent"))
    ev.clear_recent(spark, str(tmp_path / "recent"))
    assert ev.restore_recent(spark, str(tmp_path / "recent")).isEmpty() and ev.restore_recent(spark, str(tmp_path / "recent")).columns == ["path", "rank"]


DRAGS = [  # lo, hi, of 0..20
    (lambda lo, hi, *b: selection.drag_both(lo, hi, F.lit(-5), *b), (2, 8), (0, 3)),
    (lambda lo, hi, *b: selection.drag_both(lo, hi, F.lit(0), *b), (2, 7), (2, 7)),
    (lambda lo, hi, *b: selection.drag_both(lo, hi, F.lit(15), *b), (2, 8), (17, 20)),
    (lambda lo, hi, *b: selection.drag_lower(lo, hi, F.lit(10), *b, symmetric=True), (2, 8), (2, 8)),
    (lambda lo, hi, *b: selection.drag_lower(lo, hi, F.lit(4), *b, symmetric=True), (2, 8), (4, 6)),
    (lambda lo, hi, *b: selection.drag_lower(lo, hi, F.lit(1), *b, symmetric=True), (2, 8), (1, 9)),
    (lambda lo, hi, *b: selection.drag_upper(lo, hi, F.lit(1), *b), (2, 8), (2, 2)),
    (lambda lo, hi, *b: selection.drag_upper(lo, hi, F.lit(12), *b, symmetric=True), (2, 8), (0, 12)),
    (lambda lo, hi, *b: selection.set_lower(lo, hi, F.lit(25), *b), (2, 8), (20, 20)),
    (lambda lo, hi, *b: selection.set_upper(lo, hi, F.lit(-3), *b), (2, 8), (0, 0)),
]


@pytest.mark.parametrize("move,before,after", DRAGS)
def test_drags(spark, move, before, after):
    assert one(spark, *move(*map(F.lit, before), F.lit(0), F.lit(20))) == after


def test_handles(spark):
    near = lambda at: selection.nearest_handle(F.lit(at), F.lit(2), F.lit(8))
    assert one(spark, near(4), near(5), near(6)) == ("lower", "upper", "upper")
    assert one(spark, selection.step(F.lit(5), F.lit(-9), F.lit(0), F.lit(20)), selection.rescale(D(3), D(0), D(6), D(10), D(20)), selection.rescale(D(3), D(2), D(2), D(7), D(9))) == (0, 15, 7)


def test_cubic_goes_through_the_samples_and_keeps_lines(spark):
    v = spark.createDataFrame([(1, 0, 0, z, 3.0 * z + 1) for z in range(9)], "image_id long, x int, y int, z int, v double")
    for at in (2.0, 2.5, 4.3, 6.9):
        assert selection.sampled(v, at, "z", "Cubic").first().v == pytest.approx(3 * at + 1)


def test_planes_outside_the_extent(spark):
    v = synthetic.sinusoid(spark, 3, 4, 5)
    extent = {"x": (0, 2), "y": (0, 3), "z": (0, 4)}
    shown = selection.three_planes(v, -7, 9, 2, extent)
    assert {(r.plane, r.at) for r in shown.select("plane", F.when(F.col("plane") == "YZ", F.col("x")).when(F.col("plane") == "XZ", F.col("y")).otherwise(F.col("z")).alias("at")).distinct().collect()} == {("YZ", 0), ("XZ", 3), ("XY", 2)}


def test_colours(spark):
    c = lambda v, nodes: one(spark, transfer.evaluate_colour(nodes, D(v)))[0]
    assert tuple(c(65535 / 4, transfer.default_colours())) == (0.25, 0.25, 0.25) and tuple(c(70000, transfer.default_colours())) == (1, 1, 1)
    nodes = one(spark, transfer.tf_remap(transfer.range_colours(D(0), D(100)), D(10), D(2)))[0]
    assert [n.x for n in nodes] == [22, 218] and [(n.red, n.green, n.blue, n.midpoint) for n in nodes] == [(0, 0, 0, 0.5), (1, 1, 1, 0.5)]
    flat = one(spark, transfer.range_colours(D(5), D(5)))[0]
    assert [n.x for n in flat] == [5, 5]
    assert one(spark, transfer.mapped_opacity(transfer.default_nodes(), D(-4)))[0] == 0


def test_positions_without_tracking_leave_the_values(spark):
    rows = [(1, 0, 2, 8, True), (2, 1, 8, 2, True), (3, 2, 5, 30, False), (4, 3, 5, 20, True), (5, 4, -1, 20, True)]
    e = spark.createDataFrame(rows, "event_id long, ts long, lo int, hi int, tracking boolean").withColumn("k", F.lit(1))
    out = ev.positions(e, ["k"], ["ts", "event_id"], "lo", "hi", (0, 20), F.col("tracking"), (0, 20)).orderBy("event_id")
    assert [(r.event_id, r.position_lo, r.position_hi, r.value_lo, r.value_hi) for r in out.collect()] == [(1, 2, 8, 2, 8), (3, 5, 20, 2, 8), (5, 0, 20, 0, 20)]


def test_linked_views(spark):
    rows = [(1, "edit", "YZ", 10.0), (2, "link", "XY", 0.0), (3, "edit", "XZ", 7.0), (4, "link", "XY", 0.0), (5, "edit", "VOLUME", 9.0), (6, "unlink", "XY", 0.0), (7, "edit", "XY", 3.0)]
    e = spark.createDataFrame(rows, "event_id long, kind string, view string, window double").select("*", (-F.col("window")).alias("level"), F.lit(1).alias("k"))
    got = {(r.event_id, r.target): (r.shown_window, r.shown_level) for r in ev.linked(e, ["k"], ["event_id"]).collect()}
    assert got[1, "YZ"] == (10, -10) and got[1, "XY"] == (None, None)
    assert all(got[2, t] == (1000, 500) and got[n, t] == (7, -7) for n in (3, 4, 5, 6) for t in ("YZ", "XZ", "XY"))
    assert got[7, "XY"] == (3, -3) and got[7, "YZ"] == (7, -7)


def test_written_voxels_are_pruned(spark, tmp_path):
    synthetic.write_voxels(synthetic.sinusoid(spark, 8, 8, 8), str(tmp_path / "v"), 4)
    back = spark.read.parquet(str(tmp_path / "v"))
    assert back.count() == 512 and selection.slice_plane(back, "XY", 3).count() == 64
    assert "EqualTo(z,3)" in selection.slice_plane(back, "XY", 3)._jdf.queryExecution().executedPlan().toString()


def test_shared_folder(spark):
    from voxlake.sources import shared

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster)
    assert shared.new_dir(spark, "x") != shared.new_dir(spark, "x")


def test_known_nodes_evaluate_like_columns_of_nodes(spark):
    nodes = [(0.0, 1.0, 0.0, 2.0), (5.0, 2.0, 1.0, 0.0), (5.0, 8.0, 4.0, 4.0), (9.0, 4.0, 0.0, 1.0)]
    rows = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 2.5, 5.0, 6.0, 9.0, 11.0, nan, None)], "x double")
    opacities = F.array(*(transfer.node(D(x), D(y)) for x, y, *_ in nodes))
    colours = F.array(*(transfer.colour_node(*map(D, n)) for n in nodes))
    v = F.col("x")
    got = rows.select(transfer.evaluate([n[:2] for n in nodes], v), transfer.evaluate(opacities, v), transfer.evaluate_colour(nodes, v), transfer.evaluate_colour(colours, v)).collect()
    for a, b, c, d in got:
        assert a == b and (tuple(c) == tuple(d) if d else set(c) == {None})
    assert [r[0] for r in got] == [1.0, 1.0, 1.5, 8.0, 7.0, 4.0, 4.0, 4.0, None]
    assert spark.range(1).select(transfer.evaluate([], D(1))).first()[0] is None
