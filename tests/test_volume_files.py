import struct
import time
import zlib

import numpy as np
import pytest

from voxlake.sources import dicom as dc
from voxlake.sources import volume_files as vf


def isq(path, n, data, offset=0):
    head = bytearray(512)
    head[:16] = vf.ISQ_MAGIC
    struct.pack_into("<6i", head, 44, *n, n[0] * 20, n[1] * 30, n[2] * 40)
    struct.pack_into("<i", head, 508, offset)
    path.write_bytes(bytes(head) + b"\0" * 512 * offset + data.astype("<i2").tobytes())


def element(tag, vr, value, explicit=True):
    value = value if len(value) % 2 == 0 else value + b" "
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF)
    if not explicit:
        return head + struct.pack("<I", len(value)) + value
    return head + vr + (b"\0\0" + struct.pack("<I", len(value)) if vr in dc.LONG_VR else struct.pack("<H", len(value))) + value


def sequence(tag, items, explicit=True, undefined=True):
    """A sequence of items (their elements' bytes); lengths undefined, or given."""
    mark = lambda t, n: struct.pack("<HHI", t >> 16, t & 0xFFFF, n)
    body = b"".join(mark(dc.ITEM, dc.UNDEFINED if undefined else len(x)) + x + (mark(dc.ITEM_END, 0) if undefined else b"") for x in items)
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF) + (b"SQ\0\0" if explicit else b"") + struct.pack("<I", dc.UNDEFINED if undefined else len(body))
    return head + body + (mark(dc.SEQUENCE_END, 0) if undefined else b"")


def packed(data):
    """PackBits, with runs where three bytes or more are the same."""
    out, at = b"", 0
    while at < len(data):
        n = 1
        while at + n < len(data) and n < 128 and data[at + n] == data[at]:
            n += 1
        if n >= 3:
            out += bytes([257 - n, data[at]])
            at += n
            continue
        start = at
        while at < len(data) and at - start < 128 and not (at + 2 < len(data) and data[at] == data[at + 1] == data[at + 2]):
            at += 1
        out += bytes([at - start - 1]) + data[start:at]
    return out + b"\0" * (len(out) % 2)


def rle(frame):
    width = frame.dtype.itemsize
    planes = [packed(frame.reshape(-1).view(np.uint8).reshape(-1, width)[:, k].tobytes()) for k in reversed(range(width))]
    starts = np.cumsum([64, *map(len, planes)])[:-1].tolist()
    return struct.pack("<16I", width, *starts, *[0] * (15 - width)) + b"".join(planes)


def encapsulated(frames, table=True, split=False):
    """Fragments of compressed frames; ``split`` cuts each in two."""
    item = lambda x: struct.pack("<HHI", 0xFFFE, 0xE000, len(x)) + x
    cut = lambda x: [x[:40], x[40:]] if split else [x]
    bodies = [b"".join(map(item, cut(x))) for x in frames]
    starts = np.cumsum([0, *map(len, bodies)])[:-1]
    return item(struct.pack(f"<{len(starts)}I", *starts) if table else b"") + b"".join(bodies) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)


def dicom(path, series, instance, data, pixels=True, syntax=dc.EXPLICIT, position=(1, 2, 3), orientation=None, stored=None, signed=False, thick=2.5, more=b"", cut=0, split=False, table=True):
    """A file of one frame, or of as many as ``data`` has along a third axis."""
    frames = data.reshape(-1, *data.shape[-2:])
    rows, columns = frames.shape[1:]
    bits = 8 * data.dtype.itemsize if data.dtype.kind in "iu" and data.dtype.itemsize < 8 else 16
    frames = frames.astype(f"<{'i' if signed else 'u'}{bits // 8}")
    explicit = syntax != dc.IMPLICIT
    us, e = lambda x: struct.pack("<H", x), lambda tag, vr, value: element(tag, vr, value, explicit)
    numbers = lambda x: "\\".join(f"{v:.10g}" for v in x).encode()
    body = [
        e(0x00180050, b"DS", f"{thick}".encode()),
        sequence(0x00081140, [e(0x00081150, b"UI", b"1.2"), sequence(0x00082112, [e(0x00081155, b"UI", b"9.9")], explicit)], explicit),
        e(0x0020000E, b"UI", series.encode()),
        e(0x00200013, b"IS", str(instance).encode()),
        e(0x00200032, b"DS", numbers(position)) if position else b"",
        e(0x00200037, b"DS", numbers(orientation)) if orientation else b"",
        e(0x00280008, b"IS", str(len(frames)).encode()) if data.ndim == 3 else b"",
        e(0x00280010, b"US", us(rows)),
        e(0x00280011, b"US", us(columns)),
        e(0x00280030, b"DS", b"0.5\\0.25"),
        e(0x00280100, b"US", us(bits)),
        *([e(0x00280101, b"US", us(stored[0])), e(0x00280102, b"US", us(stored[1]))] if stored else []),
        e(0x00280103, b"US", us(int(signed))),
        more,
    ]
    if pixels and syntax == dc.RLE:
        body.append(struct.pack("<HH", 0x7FE0, 0x0010) + b"OB\0\0" + struct.pack("<I", dc.UNDEFINED) + encapsulated([rle(f) for f in frames], table, split))
    elif pixels:
        body.append(e(0x7FE00010, b"OW", frames.tobytes()))
    body = b"".join(body)
    if syntax == dc.DEFLATED:
        z = zlib.compressobj(wbits=-zlib.MAX_WBITS)
        body = z.compress(body) + z.flush()
    whole = b"\0" * 128 + b"DICM" + element(0x00020010, b"UI", syntax.encode()) + body
    path.write_bytes(whole[: len(whole) - cut])


def test_isq(spark, tmp_path):
    data = np.arange(-12, 12, dtype=np.int16)
    isq(tmp_path / "a.ISQ", (4, 3, 2), data, 2)
    h = vf.headers(spark, [str(tmp_path / "a.ISQ")]).first()
    assert (h.format, h.scalar_type, h.extent.x1, h.extent.y1, h.extent.z1) == ("ISQ", "short", 3, 2, 1) and h.spacing.x == pytest.approx(0.02)
    b = vf.bricks(spark, [str(tmp_path / "a.ISQ")]).orderBy("z").collect()
    assert [v for r in b for v in r.data] == data.tolist()
    assert [r.z for r in vf.bricks(spark, [str(tmp_path / "a.ISQ")], planes=(1, 1)).collect()] == [1]


def test_dicom_series(spark, tmp_path):
    one = lambda k: np.full((2, 3), k)
    dicom(tmp_path / "z.dcm", "1.2", 1, one(1))
    dicom(tmp_path / "a.dcm", "1.2", 2, one(2))
    dicom(tmp_path / "b.dcm", "1.9", 1, one(9))
    dicom(tmp_path / "c.dcm", "1.1", 1, one(0), pixels=False)
    (tmp_path / "note.txt").write_text("no image, but long enough to look into" * 9)
    h = vf.headers(spark, [str(tmp_path)]).first()
    assert (h.format, h.scalar_type, h.extent.z1, h.spacing.x, h.spacing.z, h.origin.z) == ("DICOM", "ushort", 1, 0.25, 2.5, 3.0) and h.direction == vf.IDENTITY
    assert [r.data[0] for r in vf.bricks(spark, [str(tmp_path)]).orderBy("z").collect()] == [1, 2]
    assert [r.data[0] for r in vf.bricks(spark, [str(tmp_path / "b.dcm")]).collect()] == [9]  # a file stands for its own series


def test_probe_and_errors(spark, tmp_path):
    (tmp_path / "bad.isq").write_bytes(b"x" * 600)
    (tmp_path / "x.dcm").write_bytes(b"")
    assert [vf.can_read(str(tmp_path / n)) for n in ("bad.isq", "x.dcm", "none.dcm", ".")] == [False, True, False, True]
    with pytest.raises(Exception, match="not an ISQ file"):
        vf.headers(spark, [str(tmp_path / "bad.isq")]).collect()
    with pytest.raises(Exception, match="FileNotFoundError"):
        vf.bricks(spark, [str(tmp_path / "none.dcm")]).collect()


def test_explicit_format_and_one_table_of_planes(spark, tmp_path):
    isq(tmp_path / "scan.dat", (2, 2, 3), np.arange(12, dtype=np.int16))
    with pytest.raises(Exception, match="not a DICOM file"):
        vf.headers(spark, [str(tmp_path / "scan.dat")]).collect()
    planes = vf.planes(spark, [str(tmp_path / "scan.dat")], explicit="ISQ")
    assert vf.headers(spark, planes).first().extent.z1 == 2
    assert [r.data for r in vf.bricks(spark, planes).orderBy("z").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]


def test_files_are_opened_by_many_tasks(spark, tmp_path):
    """Listings and planes are few bytes, so their exchanges have numbers of their own."""
    dicom(tmp_path / "a.dcm", "1.2", 1, np.ones((2, 2)))
    df = vf.bricks(spark, [str(tmp_path)])
    assert df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 3 and df.rdd.getNumPartitions() == 4


def test_a_directory_without_series_is_an_error(spark, tmp_path):
    (tmp_path / "note.txt").write_text("no image, but long enough to look into" * 9)
    with pytest.raises(Exception, match="no series"):
        vf.headers(spark, [str(tmp_path)]).collect()


def test_outcomes(spark, tmp_path):
    isq(tmp_path / "good.isq", (1, 1, 1), np.zeros(1))
    (tmp_path / "bad.isq").write_bytes(b"x" * 600)
    (tmp_path / "bad.dcm").write_bytes(b"x" * 600)
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.txt").write_bytes(b"x" * 600)
    names = ["good.isq", "bad.isq", "bad.dcm", "empty", "none.dcm"]
    got = {r.path.rsplit("/", 1)[1]: (r.outcome, r.detail) for r in vf.outcomes(spark, [str(tmp_path / n) for n in names]).collect()}
    assert got == {"good.isq": ("loaded", None), "bad.isq": ("rejected", None), "bad.dcm": ("error", "not a DICOM file"), "empty": ("invalid", None), "none.dcm": ("rejected", None)}


def test_written_volumes_are_read_back(spark, tmp_path):
    sizes = spark.createDataFrame([(i, 3, 2, 4, 30, 20, 40) for i in range(5)], "image_id long, nx int, ny int, nz int, ux int, uy int, uz int")
    data = [(i, z, [float(i * 100 + z * 10 + k - 250) for k in range(6)]) for i in range(5) for z in range(4)]
    files = vf.write_isq(spark.createDataFrame(data, vf.BRICK).repartition(7), sizes, f"file://{tmp_path}")
    assert sorted(map(tuple, vf.bricks(spark, files).collect())) == data
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"{i}.isq" for i in range(5)]


def test_attempts_have_names_of_their_own(spark, tmp_path):
    """A file that another attempt left half written does no harm, and writing again gives the same."""
    sizes = spark.createDataFrame([(1, 3, 2, 2, 30, 20, 40)], "image_id long, nx int, ny int, nz int, ux int, uy int, uz int")
    rows = spark.createDataFrame([(1, z, [float(z)] * 6) for z in range(2)], vf.BRICK)
    (tmp_path / "1.part").write_bytes(b"half")
    (tmp_path / "1.0000.part").write_bytes(b"half")
    files = vf.write_isq(rows, sizes, f"file://{tmp_path}")
    first = files.collect() and (tmp_path / "1.isq").read_bytes()
    assert files.collect() and (tmp_path / "1.isq").read_bytes() == first and len(first) == 512 + 24
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1.0000.part", "1.isq", "1.part"]


RNG = np.random.default_rng(2)
DEEP = (RNG.integers(0, 9, (3, 4, 5)) * 300).astype(np.uint16)


@pytest.mark.parametrize("syntax", [dc.EXPLICIT, dc.IMPLICIT, dc.DEFLATED, dc.RLE])
@pytest.mark.parametrize("data", [DEEP, DEEP[0], (DEEP // 300).astype(np.uint8), DEEP.astype(np.uint32) * 70_000])
def test_syntaxes_and_frames(spark, tmp_path, syntax, data):
    dicom(tmp_path / "a.dcm", "1.2", 1, data, syntax=syntax)
    b = vf.bricks(spark, [str(tmp_path / "a.dcm")]).orderBy("z").collect()
    assert [r.data for r in b] == data.reshape(-1, 20).tolist()
    h = vf.headers(spark, [str(tmp_path)]).first()
    assert (h.extent.z1, h.scalar_type, h.spacing.z) == (len(b) - 1, {1: "uchar", 2: "ushort", 4: "uint"}[data.dtype.itemsize], 2.5)


@pytest.mark.parametrize("split,table", [(True, True), (False, False), (False, True)])
def test_fragments_and_offsets(spark, tmp_path, split, table):
    dicom(tmp_path / "a.dcm", "1.2", 1, DEEP, syntax=dc.RLE, split=split, table=table)
    assert [r.data for r in vf.bricks(spark, [str(tmp_path)]).orderBy("z").collect()] == DEEP.reshape(3, -1).tolist()


def test_fragments_that_nothing_tells_apart(spark, tmp_path):
    dicom(tmp_path / "a.dcm", "1.2", 1, DEEP, syntax=dc.RLE, split=True, table=False)
    with pytest.raises(Exception, match="a.dcm: 6 fragments for 3 frames"):
        vf.bricks(spark, [str(tmp_path)]).collect()


@pytest.mark.parametrize("signed", [False, True])
def test_stored_bits_alone_count(spark, tmp_path, signed):
    values = np.arange(-8, 12).reshape(4, 5) if signed else np.arange(20).reshape(4, 5) + 4000
    raw = ((values & 0xFFF) << 2 | 0x4001).astype(np.uint16)  # twelve bits from the third on; the others are of something else
    dicom(tmp_path / "a.dcm", "1.2", 1, raw, stored=(12, 13), signed=signed)
    assert vf.bricks(spark, [str(tmp_path)]).first().data == (values & 0xFFF if not signed else values).reshape(-1).tolist()


@pytest.mark.parametrize("syntax", [dc.EXPLICIT, dc.RLE, dc.DEFLATED])
def test_cut_files_are_errors(tmp_path, syntax):
    dicom(tmp_path / "whole.dcm", "1.2", 1, DEEP, syntax=syntax)
    dicom(tmp_path / "bare.dcm", "1.2", 1, DEEP, syntax=syntax, pixels=False)
    # a file that ends where an element does, before the samples, is whole: it has none
    size = (tmp_path / "whole.dcm").stat().st_size - (tmp_path / "bare.dcm").stat().st_size
    for cut in range(1, size):
        dicom(tmp_path / "a.dcm", "1.2", 1, DEEP, syntax=syntax, cut=cut)
        with pytest.raises(ValueError, match="a.dcm"):
            rows = vf._planes_of("DICOM", str(tmp_path / "a.dcm"), False)
            assert len(rows) == 3
            for z, p in enumerate(rows):
                vf._samples(dict(zip(vf._NAMES, p, strict=True)) | {"file": str(tmp_path / "a.dcm"), "z": z})


def test_unsupported_files_of_a_directory_are_errors(spark, tmp_path):
    dicom(tmp_path / "a.dcm", "1.2", 1, DEEP[0])
    dicom(tmp_path / "b.dcm", "1.2", 2, DEEP[0], syntax="1.2.840.10008.1.2.4.70")
    with pytest.raises(Exception, match="b.dcm: transfer syntax 1.2.840.10008.1.2.4.70"):
        vf.bricks(spark, [str(tmp_path)]).collect()
    assert vf.outcomes(spark, [str(tmp_path)]).first().outcome == "error"


def positions(tmp_path, at, normal=(0, 0, 1), orientation=None):
    for k, (i, x) in enumerate(at):
        dicom(tmp_path / f"{k}.dcm", "1.2", i, np.full((2, 2), int(100 + x)), position=[x * v for v in normal], orientation=orientation)


def test_planes_are_in_the_order_of_positions(spark, tmp_path):
    positions(tmp_path, [(1, 30), (2, 10), (3, 20), (4, 0)])
    assert [r.data[0] for r in vf.bricks(spark, [str(tmp_path)]).orderBy("z").collect()] == [100, 110, 120, 130]
    h = vf.headers(spark, [str(tmp_path)]).first()
    assert (h.spacing.z, h.origin.z) == (10, 0)
    assert tuple(vf.series_geometry(spark, [str(tmp_path)]).first())[2:] == (4, 10, 10, 10, 0, 0, True)


def test_missing_uneven_and_repeated_planes_are_told(spark, tmp_path):
    cases = {"missing": [0, 5, 10, 25, 30], "uneven": [0, 5, 10, 17, 22], "repeated": [0, 5, 5, 10]}
    for name, at in cases.items():
        (tmp_path / name).mkdir()
        positions(tmp_path / name, list(enumerate(at)))
    got = {r.path.rsplit("/", 1)[1]: (r.planes, r.spacing, r.missing, r.repeated, r.even) for r in vf.series_geometry(spark, [str(tmp_path / n) for n in cases]).collect()}
    assert got == {"missing": (5, 5, 2, 0, False), "uneven": (5, 5, 0, 0, False), "repeated": (4, 5, 0, 1, False)}


def test_an_oblique_series(spark, tmp_path):
    a, b = np.array([0.6, 0.8, 0.0]), np.array([0.0, 0.0, -1.0])
    positions(tmp_path, [(7, 4), (3, 2), (5, 0), (1, 6)], np.cross(a, b), [*a, *b])
    h = vf.headers(spark, [str(tmp_path)]).first()
    assert h.spacing.z == pytest.approx(2) and h.direction[2::3] == pytest.approx(list(np.cross(a, b)))
    assert [r.data[0] for r in vf.bricks(spark, [str(tmp_path)]).orderBy("z").collect()] == [100, 102, 104, 106]


def test_without_positions_the_instance_numbers_count(spark, tmp_path):
    for k, i in enumerate((3, 1, 2)):
        dicom(tmp_path / f"{k}.dcm", "1.2", i, np.full((2, 2), i), position=None)
    assert [r.data[0] for r in vf.bricks(spark, [str(tmp_path)]).orderBy("z").collect()] == [1, 2, 3]
    assert vf.headers(spark, [str(tmp_path)]).first().spacing.z == 2.5


@pytest.mark.parametrize("syntax,undefined", [(dc.EXPLICIT, True), (dc.EXPLICIT, False), (dc.IMPLICIT, True), (dc.IMPLICIT, False)])
def test_frames_with_positions_of_their_own(spark, tmp_path, syntax, undefined):
    x = syntax != dc.IMPLICIT
    ds = lambda tag, text: element(tag, b"DS", text, x)
    s = lambda tag, items: sequence(tag, items, x, undefined)
    shared = s(dc.SHARED_GROUPS, [s(dc.PIXEL_MEASURES, [ds(dc.PIXEL_SPACING, b"3\\4") + ds(dc.THICKNESS, b"9")]) + s(dc.VALUE_TRANSFORM, [ds(dc.INTERCEPT, b"-5") + ds(dc.SLOPE, b"2")])])
    own = s(dc.FRAME_GROUPS, [s(dc.PLANE_POSITION, [ds(dc.POSITION, b"0\\0\\%d" % z)]) for z in (8, 0, 4)])
    dicom(tmp_path / "a.dcm", "1.2", 1, DEEP, position=None, more=shared + own, syntax=syntax)
    assert [r.data for r in vf.bricks(spark, [str(tmp_path)]).orderBy("z").collect()] == (DEEP[[1, 2, 0]].reshape(3, -1) * 2.0 - 5).tolist()
    assert tuple(vf.headers(spark, [str(tmp_path)]).first().spacing) == (4, 3, 4)


@pytest.fixture
def source(spark):
    from voxlake.sources import volume_source

    volume_source.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda: spark.read.format("volume")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_data_source(spark, tmp_path, source):
    isq(tmp_path / "a,b.isq", (2, 2, 3), np.arange(12, dtype=np.int16))
    (tmp_path / "d").mkdir()
    for k, z in ((2, 0), (1, 7)):
        dicom(tmp_path / "d" / f"{k}.dcm", "1.2", k, np.full((2, 3), k), position=(0, 0, z), syntax=dc.RLE)
    paths = [f"{tmp_path}/a,b.isq", f"{tmp_path}/d"]
    assert sorted(map(tuple, source().load(paths).collect())) == sorted(map(tuple, vf.bricks(spark, paths).collect()))
    assert source().load(paths[0]).count() == 3
    some = source().option("partition_bytes", 200).load(paths).where("image_id = 0 and z > 0")
    assert [r.z for r in some.orderBy("z").collect()] == [1, 2] and some.rdd.getNumPartitions() == 3
    heads = source().option("content", "headers").load(paths)
    assert sorted(map(str, heads.collect())) == sorted(map(str, vf.headers(spark, paths).collect()))
    with pytest.raises(Exception, match="FileNotFoundError"):
        source().load(f"{tmp_path}/none.isq").collect()


def test_planning_opens_no_file(spark, tmp_path, source):
    """Ten thousand paths are planned in seconds, though not one is a volume; only what the filters leave is opened."""
    for k in range(100):
        (tmp_path / f"{k}.isq").write_bytes(b"x" * 600)
    isq(tmp_path / "7.isq", (2, 2, 3), np.arange(12, dtype=np.int16))
    paths = [f"{tmp_path}/{k % 100}.isq" for k in range(10_000)]
    began = time.perf_counter()
    df = source().load(paths)
    assert df.rdd.getNumPartitions() == 1 and time.perf_counter() - began < 20
    assert [r.data for r in df.where("image_id = 107 and z = 1").collect()] == [[4, 5, 6, 7]]
    with pytest.raises(Exception, match="not an ISQ file"):
        df.where("image_id = 108").collect()


@pytest.mark.parametrize("syntax", [dc.EXPLICIT, dc.DEFLATED, dc.RLE])
@pytest.mark.parametrize("frames", [np.zeros((1, 3, 500)), RNG.integers(-9, 9, (4, 40, 30)) * 100, np.repeat(RNG.integers(-9, 9, (2, 5, 1)), 131, axis=2)])
def test_written_series_are_read_back(tmp_path, syntax, frames):
    (tmp_path / "a.dcm").write_bytes(dc.written(frames, "1.2", 3, (0, 0, 4.5), 1.5, syntax))
    rows = vf._planes_of("DICOM", str(tmp_path / "a.dcm"), False)
    got = [dict(zip(vf._NAMES, p, strict=True)) | {"file": str(tmp_path / "a.dcm"), "z": z} for z, p in enumerate(rows)]
    assert [r["along"] for r in got] == [4.5 + 1.5 * k for k in range(len(frames))]
    assert [list(vf._samples(r)) for r in got] == frames.reshape(len(frames), -1).tolist()
