import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import blocked
from voxlake.sources import blocks, synthetic

NX, NY, NZ = 23, 17, 13
EDGE = (8, 4, 5)


@pytest.fixture(scope="module")
def grid():
    g = np.random.default_rng(4).normal(size=(NZ, NY, NX)).round(3)
    g[3, 2, 1], g[0, 0, 0] = np.nan, np.inf
    return g


@pytest.fixture(scope="module")
def table(spark, grid, tmp_path_factory):
    planes = spark.createDataFrame([(7, z, grid[z].reshape(-1).tolist()) for z in range(NZ)] + [(8, z, [float(z)] * 6) for z in range(-2, 2)], "image_id long, z int, data array<double>")
    nx = F.when(F.col("image_id") == 7, NX).otherwise(3)
    path = str(tmp_path_factory.mktemp("blocks") / "t")
    blocks.write(blocks.from_planes(planes, nx, EDGE), path, 12)
    return blocks.read(spark, path)


def scanned(df):
    """Rows that the files' scans gave, and their plans."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(x.metrics().apply("numOutputRows").value() for x in scans), "\n".join(x.toString() for x in scans)


def test_blocks_cover_the_volume(table, grid):
    rows = table.where("image_id = 7").collect()
    assert len(rows) == 3 * 5 * 3
    for r in rows:
        part = grid[r.z0 : r.z1 + 1, r.y0 : r.y1 + 1, r.x0 : r.x1 + 1]
        assert np.array_equal(np.array(r.data), part.reshape(-1), equal_nan=True)
        assert (r.vmin, r.vmax) == (part[np.isfinite(part)].min(), part[np.isfinite(part)].max())
    assert len({r.key for r in rows}) == len(rows)


def test_key_interleaves_bits(spark):
    rows = spark.range(512).selectExpr("int(id % 8) AS x", "int(id / 8) % 8 AS y", "int(id / 64) AS z")
    for r in rows.withColumn("key", blocks.space_filling_key(F.col("x"), F.col("y"), F.col("z"))).collect():
        assert r.key == sum((r[a] >> b & 1) << (3 * b + i) for i, a in enumerate("xyz") for b in range(3))


@pytest.mark.parametrize("bounds", [{"x": (5, 9), "y": (3, 4), "z": (4, 11)}, {"y": (16, 40)}, {"z": (50, 60)}, {}, {"x": (0, 22), "y": (0, 16), "z": (0, 12)}])
def test_crop(table, grid, bounds):
    got = {(r.x, r.y, r.z): r.v for r in blocked.samples(blocked.crop(table.where("image_id = 7"), bounds)).collect()}
    inside = lambda a, i: a not in bounds or bounds[a][0] <= i <= bounds[a][1]
    want = {(x, y, z): grid[z, y, x] for z in range(NZ) for y in range(NY) for x in range(NX) if inside("x", x) and inside("y", y) and inside("z", z)}
    assert got.keys() == want.keys() and np.array_equal([got[k] for k in want], list(want.values()), equal_nan=True)


@pytest.mark.parametrize("orientation,index", [("XY", 6), ("XZ", 9), ("YZ", 20)])
def test_slice(table, grid, orientation, index):
    got = {(r.u, r.v): r.value for r in blocked.plane_samples(blocked.slice_plane(table.where("image_id = 7"), orientation, index)).collect()}
    plane = grid.take(index, axis=["XY", "XZ", "YZ"].index(orientation))
    assert np.array_equal(plane, [[got[u, v] for u in range(plane.shape[1])] for v in range(plane.shape[0])], equal_nan=True) and len(got) == plane.size


def test_scans_read_touched_blocks_only(table):
    everything, _ = scanned(table.select("data"))
    for df, filters in (
        (blocked.slice_plane(table, "YZ", 20), "x0,20"),
        (blocked.crop(table.where("image_id = 7"), {"x": (0, 3), "y": (0, 3), "z": (0, 3)}), "z1,0"),
        (blocked.valued_between(table, 3.2, 9.0), "vmax,3.2"),
    ):
        rows, plan = scanned(df)
        assert rows < everything and filters in plan and "PushedFilters" in plan
    assert "ReadSchema: struct<image_id:bigint,vmin:double,vmax:double>" in blocked.ranges(table, "image_id")._jdf.queryExecution().executedPlan().toString()


def test_values_and_ranges(table, grid):
    got = sorted(tuple(r) for r in blocked.valued_between(table.where("image_id = 7"), 1.0, 1.5).collect())
    assert got == sorted((7, x, y, z, grid[z, y, x]) for z in range(NZ) for y in range(NY) for x in range(NX) if 1.0 <= grid[z, y, x] <= 1.5)
    finite = grid[np.isfinite(grid)]
    assert {tuple(r) for r in blocked.ranges(table, "image_id").collect()} == {(7, finite.min(), finite.max()), (8, -2.0, 1.0)}


def test_planes_of_the_default_volume(spark):
    v = synthetic.sinusoid(spark, 20, 9, 6)
    table = blocks.from_planes(synthetic.to_bricks(v), 20, EDGE)
    got = {tuple(r) for r in blocked.samples(table).collect()}
    assert got == {tuple(r) for r in v.select("image_id", "x", "y", "z", "v").collect()}


def test_holes_and_repeats_are_errors(spark):
    for zs in ([0, 2], [0, 0], [0, 1, 1]):
        planes = spark.createDataFrame([(1, z, [1.0, 2.0]) for z in zs], "image_id long, z int, data array<double>")
        with pytest.raises(Exception, match="missing or repeated"):
            blocks.from_planes(planes, 2, EDGE).collect()
    assert blocks.from_planes(spark.createDataFrame([(1, 0, [])], "image_id long, z int, data array<double>"), 2).count() == 0


OPACITY, SHADES = [(-1.0, 0.0), (0.5, 0.3), (2.0, 0.9)], [(-2.0, 0.0, 1.0), (2.0, 1.0, 0.5)]


@pytest.mark.parametrize("axis", "xyz")
@pytest.mark.parametrize("step", [1.0, 0.4])
def test_composite(table, grid, axis, step):
    df = blocked.composite(table.where("image_id = 7"), OPACITY, SHADES, axis, ("red", "green"), step)
    others = [a for a in "xyz" if a != axis]
    got = {(r[others[0]], r[others[1]]): (r.red, r.green, r.opacity) for r in df.collect()}
    n, o = dict(zip("xyz", (NX, NY, NZ), strict=True)), np.array(OPACITY)
    assert len(got) == n[others[0]] * n[others[1]]
    for u, v in [(0, 0), (1, 2), (5, 7), (n[others[0]] - 1, n[others[1]] - 1)]:
        seen, clear = [0.0, 0.0], 1.0
        for w in range(n[axis]):
            at = {others[0]: u, others[1]: v, axis: w}
            value = grid[at["z"], at["y"], at["x"]]
            if not np.isfinite(value):
                continue
            alpha = 1 - (1 - np.interp(value, o[:, 0], o[:, 1])) ** step
            for k in range(2):
                seen[k] += clear * alpha * np.interp(value, [-2, 2], [(0, 1), (1, 0.5)][k])
            clear *= 1 - alpha
        assert got[u, v] == pytest.approx((*seen, 1 - clear), abs=1e-12)


def test_composite_shuffles_a_row_a_block(table):
    df = blocked.composite(table, OPACITY, SHADES, "z", ("red", "green"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan.split("Exchange")[1]


def test_mapped_ranges(table, grid):
    from math import floor

    mapped = lambda v: floor(min(max((v + 1) * 30_000, 0), 65535)) if v == v else 65535
    for lo, hi in ((20_000, 40_000), (0, 10_000), (60_000, 65535), (0, 65535)):
        got = {(r.x, r.y, r.z) for r in blocked.mapped_between(table.where("image_id = 7"), lo, hi, 1.0, 30_000.0).collect()}
        want = {(x, y, z) for z in range(NZ) for y in range(NY) for x in range(NX) if lo <= mapped(grid[z, y, x]) <= hi}
        # samples that aren't numbers are in no zone map
        odd = {(1, 2, 3), (0, 0, 0)}
        assert got - odd == want - odd
    assert "vmax,-0.33" in scanned(blocked.mapped_between(table, 20_000, 40_000, 1.0, 30_000.0))[1]


def test_files_become_blocks(spark, tmp_path):
    from tests.test_volume_files import isq
    from voxlake.sources import volume_files

    for k, n in enumerate(((11, 7, 6), (5, 9, 3))):
        isq(tmp_path / f"{k}.isq", n, np.arange(np.prod(n), dtype=np.int16))
    paths = [str(tmp_path / f"{k}.isq") for k in (0, 1)]
    got = {tuple(r) for r in blocked.samples(volume_files.blocks(spark, paths, edge=(4, 4, 4))).collect()}
    assert got == {(k, i % nx, i // nx % ny, i // nx // ny, float(i)) for k, (nx, ny, nz) in enumerate(((11, 7, 6), (5, 9, 3))) for i in range(nx * ny * nz)}
