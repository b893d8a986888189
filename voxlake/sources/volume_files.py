"""Volume files: Scanco ISQ, and DICOM series (see ``dicom`` for the forms that are read).

Paths become files, files headers, headers planes (``planes``); each step is a table, so files of a directory are opened by many tasks and a series is a window.
Headers are read alone (``headers``), and samples plane by plane (``bricks``): a plane is a task's unit, and only its bytes are read. Both take the table of
planes in place of paths, so that it is made once. Files are opened on the executors through Arrow's file systems, so a path is any URI that Arrow knows, or a
local path on a shared disk.

Definitions: an ISQ file has a header of 512 bytes, the samples (16-bit, x fastest, then y, z) follow ``(data_offset + 1) * 512`` bytes from the start; spacing is the physical size over the number of samples. Rows
stay in the file's order; nothing is flipped. A directory is its first series by UID; a single DICOM file stands for its own series. The planes of a series are in the order of their
positions along the normal (of instance numbers where a plane has no position), and lie as far apart as most of them do (``series_geometry`` tells whether all do).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import BRICK, VOLUME
from . import dicom
from .blocks import EDGE, from_planes
from .paths import DICOM, SCANCO

ISQ_MAGIC = b"CTDATA-HEADER_V1"
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def _open(path: str):
    if "://" in path:
        where, name = pafs.FileSystem.from_uri(path)
    else:
        where, name = pafs.LocalFileSystem(), path
    return where, name


def isq_header(data: bytes) -> dict:
    """Size, spacing (in mm) and place of the samples from the first 512 bytes."""
    if len(data) < 512 or data[:16] != ISQ_MAGIC:
        raise ValueError("not an ISQ file")
    nx, ny, nz, ux, uy, uz = struct.unpack_from("<6i", data, 44)
    (offset,) = struct.unpack_from("<i", data, 508)
    return {"n": (nx, ny, nz), "spacing": tuple(u / 1000 / max(n, 1) for u, n in zip((ux, uy, uz), (nx, ny, nz), strict=True)), "at": (offset + 1) * 512}


def can_read(path: str) -> bool:
    """Whether the path is a directory, a Scanco file with a good header, or a file with a DICOM ending. Errors count as no."""
    try:
        where, name = _open(path)
        info = where.get_file_info(name)
        if info.type == pafs.FileType.Directory:
            return True
        if info.type != pafs.FileType.File:
            return False
        low = path.lower()
        if low.endswith(SCANCO):
            with where.open_input_file(name) as f:
                isq_header(f.read(512))
            return True
        return low.endswith(DICOM)
    except (OSError, ValueError):
        return False


def _listed(image_id: int | None, path: str, explicit: str | None) -> Iterator[tuple]:
    """(image_id, path, format, file, alone) of the files that a path may need: an ISQ file, or the files of a DICOM directory (``alone``: the file whose series is wanted)."""
    where, name = _open(path)
    info = where.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File and (explicit == "ISQ" or explicit is None and path.lower().endswith(SCANCO)):
        yield image_id, path, "ISQ", path, False
        return
    folder = info.type == pafs.FileType.Directory
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    found = False
    for x in where.get_file_info(pafs.FileSelector(name if folder else name.rsplit("/", 1)[0])):
        if x.type == pafs.FileType.File and (folder or x.path == name or x.path.lower().endswith(DICOM)):
            found = True
            yield image_id, path, "DICOM", prefix + x.path, not folder and x.path == name
    if not found:
        raise ValueError(f"{path}: no series")


def _planes_of(format: str, file: str, alone: bool) -> list[tuple]:
    """The planes of a file, without their samples, as rows of ``_FACTS``; none where a directory's file isn't DICOM, or has no samples. Any other fault is an error that names the file."""
    where, name = _open(file)
    try:
        with where.open_input_file(name) as f:
            if format == "ISQ":
                h = isq_header(f.read(512))
                nx, ny, nz = h["n"]
                same = ("", 0, nx, ny, list(h["spacing"]), [0.0, 0.0, 0.0], None, IDENTITY, "short", "raw", 16, 15, 1.0, 0.0)
                return [(z, *same, [(h["at"] + 2 * z * nx * ny, 2 * nx * ny)]) for z in range(nz)]
            return [tuple(x[k] for k in _NAMES) for x in dicom.frames(f)]
    except dicom.NotDicom:
        if alone:
            raise
        return []
    except ValueError as e:
        raise ValueError(f"{file}: {e}") from e


_FILE = "image_id long, path string, format string, file string, alone boolean"
_FACTS = (
    "frame int, series string, instance int, nx int, ny int, spacing array<double>, origin array<double>, along double, direction array<double>, scalar_type string, encoding string, "
    "stored int, high int, slope double, intercept double, parts array<struct<at:long,length:long>>"
)
_NAMES = [x.split()[0] for x in _FACTS.split(", ")]
_PART = pa.struct([("at", pa.int64()), ("length", pa.int64())])
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<struct<at:long,length:long>>": pa.list_(_PART)}
#: Of the least distance that most planes have: what a gap may differ from it, or a number of times it.
EVEN = 0.01


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _tasks(spark: SparkSession) -> int:
    """A number for exchanges of few bytes that stand for much work; without one of its own Spark merges such partitions into one."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def planes(spark: SparkSession, paths: list[str] | DataFrame, explicit: str | None = None) -> DataFrame:
    """One row for each plane of the volumes at ``paths`` (path, or a table of image_id and path): where its samples are, and the volume's header. No sample is read.

    An unreadable path is an error, as is a directory without a series.
    """
    if not isinstance(paths, DataFrame):
        paths = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "image_id long, path string")

    def listed(batches):
        for batch in batches:
            rows = [x for i, p in zip(batch.column("image_id").to_pylist(), batch.column("path").to_pylist(), strict=True) for x in _listed(i, p, explicit)]
            if rows:
                yield _batch(rows, _FILE)

    def opened(batches):
        for batch in batches:
            rows = [(*x, *p) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in _planes_of(*x[2:]) or [[None] * len(_NAMES)]]
            if rows:
                yield _batch(rows, f"{_FILE}, {_FACTS}")

    tasks = _tasks(spark)
    listing = paths.select(F.col("image_id").cast("long"), "path").repartition(tasks).mapInArrow(listed, _FILE).repartition(tasks)
    files = listing.mapInArrow(opened, f"{_FILE}, {_FACTS}")
    volume = Window.partitionBy("image_id", "path")
    there = F.col("parts").isNotNull()
    wanted = F.coalesce(F.max(F.when(F.col("alone") & there, F.col("series"))).over(volume), F.min(F.when(there, F.col("series"))).over(volume))
    files = files.withColumn("wanted", wanted)
    files = files.where(F.when(F.col("wanted").isNull(), F.raise_error(F.concat("path", F.lit(": no series"))).cast("boolean")).otherwise((F.col("series") == F.col("wanted")) & there))
    # by position, unless a plane has none
    files = files.withColumn("along", F.when(F.count("along").over(volume) == F.count("*").over(volume), F.col("along")))
    order = volume.orderBy("along", "instance", "file", "frame")
    shared = ["scalar_type", "spacing", "origin", "direction"]
    files = files.withColumns({"z": F.row_number().over(order) - 1, "nz": F.count("*").over(volume).cast("int"), "gap": F.col("along") - F.lag("along").over(order), **{c: F.first(c).over(order) for c in shared}})
    apart = F.median(F.when(F.col("gap") > 0, F.col("gap"))).over(volume)
    spacing = F.transform("spacing", lambda v, i: F.when(i == 2, F.coalesce(apart, v)).otherwise(v))
    return files.withColumn("spacing", spacing).select("image_id", "path", "format", "scalar_type", "z", "file", "frame", "nx", "ny", "nz", "spacing", "origin", "direction", "gap", "encoding", "stored", "high", "slope", "intercept", "parts")


def _made(spark: SparkSession, paths: list[str] | DataFrame, explicit: str | None) -> DataFrame:
    return paths if isinstance(paths, DataFrame) and "parts" in paths.columns else planes(spark, paths, explicit)


def headers(spark: SparkSession, paths: list[str] | DataFrame, explicit: str | None = None) -> DataFrame:
    """The volumes' headers, with no sample read. An unreadable path is an error. ``paths`` may be the table of ``planes``."""
    c = _made(spark, paths, explicit).where("z = 0")
    end = lambda n: (F.col(n) - 1).cast("int")
    extent = F.struct(F.lit(0).alias("x0"), end("nx").alias("x1"), F.lit(0).alias("y0"), end("ny").alias("y1"), F.lit(0).alias("z0"), end("nz").alias("z1"))
    point = lambda n: F.struct(*(F.col(n)[i].alias(a) for i, a in enumerate("xyz")))
    out = c.select("image_id", "path", "format", "scalar_type", extent.alias("extent"), point("spacing").alias("spacing"), point("origin").alias("origin"), "direction")
    return out.select(*(F.col(x.name).cast(x.dataType) for x in VOLUME))


def series_geometry(spark: SparkSession, paths: list[str] | DataFrame, explicit: str | None = None) -> DataFrame:
    """image_id, path, planes, spacing, least_gap, greatest_gap, missing, repeated, even: how the planes of each volume lie along its normal. No sample is read.

    ``spacing`` is the median of the gaps; ``missing`` the planes that would fill gaps of a whole number of spacings; ``repeated`` the planes at the position of the one before;
    ``even`` says that every gap is a spacing. Gaps are null where a plane has no position, as in an ISQ file, and such a volume counts as even.
    """
    p = _made(spark, paths, explicit).withColumn("apart", F.get("spacing", F.lit(2)))
    times = F.col("gap") / F.col("apart")
    gaps = F.round(times)
    hole = F.when((F.abs(times - gaps) <= EVEN * gaps) & (gaps > 1), gaps - 1).otherwise(0)
    return p.groupBy("image_id", "path").agg(
        F.count("*").alias("planes"),
        F.first("apart").alias("spacing"),
        F.min("gap").alias("least_gap"),
        F.max("gap").alias("greatest_gap"),
        F.coalesce(F.sum(hole.cast("long")), F.lit(0)).alias("missing"),
        F.sum(F.coalesce((times < EVEN).cast("long"), F.lit(0))).alias("repeated"),
        F.coalesce(F.bool_and(F.abs(times - 1) <= EVEN), F.lit(True)).alias("even"),
    )


def _samples(r: dict) -> list[float]:
    where, name = _open(r["file"])
    parts = [(p["at"], p["length"]) if isinstance(p, dict) else p for p in r["parts"]]
    try:
        with where.open_input_file(name) as f:
            return dicom.samples(f, r | {"parts": parts}) * r["slope"] + r["intercept"]
    except ValueError as e:
        raise ValueError(f"{r['file']}, plane {r['z']}: {e}") from e


def bricks(spark: SparkSession, paths: list[str] | DataFrame, explicit: str | None = None, planes: tuple[int, int] | None = None) -> DataFrame:
    """The volumes' planes as brick rows; ``planes`` limits them to an inclusive range before any sample is read. ``paths`` may be the table of ``planes``."""
    c = _made(spark, paths, explicit)
    if planes:
        c = c.where(F.col("z").between(*planes))

    def load(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]], pa.int64()), pa.array([r["z"]], pa.int32()), pa.array([_samples(r)], pa.list_(pa.float64()))], ["image_id", "z", "data"])

    return c.select("image_id", "z", "file", "parts", "encoding", "stored", "high", "nx", "ny", "scalar_type", "slope", "intercept").repartition(_tasks(spark)).mapInArrow(load, BRICK)


def blocks(spark: SparkSession, paths: list[str] | DataFrame, explicit: str | None = None, edge: tuple[int, int, int] = EDGE) -> DataFrame:
    """The volumes in the blocked layout (see ``blocks``). ``paths`` may be the table of ``planes``."""
    c = _made(spark, paths, explicit)
    width = c.where("z = 0").select("image_id", F.col("nx").alias("width"))
    return from_planes(bricks(spark, c).join(width, "image_id"), F.col("width"), edge)


OUTCOMES = ("loaded", "rejected", "invalid", "error", "unknown")


def outcomes(spark: SparkSession, paths: list[str] | DataFrame, explicit: str | None = None) -> DataFrame:
    """image_id, path, outcome, detail: what opening each path comes to, with no path failing the others.

    'rejected' where the probe says no (missing, unreadable, or of no known kind), 'invalid' where there is no volume in it, 'error' with the message of
    a failure that was foreseen, 'unknown' of any other, and 'loaded'. Headers are read, samples are not.
    """
    if not isinstance(paths, DataFrame):
        paths = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "image_id long, path string")

    def outcome(path):
        if not (explicit or can_read(path)):
            return "rejected", None
        try:
            found = [_planes_of(f, file, alone) for _, _, f, file, alone in _listed(None, path, explicit)]
            return ("loaded", None) if any(found) else ("invalid", None)
        except (OSError, ValueError) as e:
            return "error", str(e)
        except Exception as e:  # noqa: BLE001 - the class is the result
            return "unknown", repr(e)

    def tell(batches):
        for batch in batches:
            rows = [(i, p, *outcome(p)) for i, p in zip(batch.column("image_id").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            if rows:
                yield _batch(rows, "image_id long, path string, outcome string, detail string")

    return paths.select(F.col("image_id").cast("long"), "path").repartition(_tasks(spark)).mapInArrow(tell, "image_id long, path string, outcome string, detail string")


def write_isq(bricks: DataFrame, sizes: DataFrame, folder: str) -> DataFrame:
    """Write volumes (bricks: image_id, z, data of 16-bit samples; sizes: image_id, nx, ny, nz and ux, uy, uz in micrometres) as ISQ files below ``folder``, which all executors can write to; returns image_id, path.

    A volume is written by one task, plane after plane. An attempt of a task writes to a name of its own and gives the file its name when it is whole, so attempts that run again, or side by side, do no harm; each has the same bytes.
    Writing happens when the returned table is first read; to read it more than once, store it.
    """

    def save(batches):
        import numpy as np

        where, base = _open(folder)
        f, own, out, attempt = None, None, [], uuid.uuid4().hex

        def close():
            if f is not None:
                f.close()
                where.move(f"{base}/{own}.{attempt}.part", f"{base}/{own}.isq")
                out.append((own, f"{folder.rstrip('/')}/{own}.isq"))

        for batch in batches:
            for r in batch.to_pylist():
                if r["image_id"] != own:
                    close()
                    own = r["image_id"]
                    head = bytearray(512)
                    head[:16] = ISQ_MAGIC
                    struct.pack_into("<6i", head, 44, r["nx"], r["ny"], r["nz"], r["ux"], r["uy"], r["uz"])
                    f = where.open_output_stream(f"{base}/{own}.{attempt}.part")
                    f.write(bytes(head))
                f.write(np.array(r["data"]).astype("<i2").tobytes())
        close()
        if out:
            yield _batch(out, "image_id long, path string")

    rows = bricks.join(sizes, "image_id").repartition(_tasks(bricks.sparkSession), "image_id").sortWithinPartitions("image_id", "z")
    return rows.select("image_id", "z", "nx", "ny", "nz", "ux", "uy", "uz", "data").mapInArrow(save, "image_id long, path string")


def write_dicom(files: DataFrame, nx: int, ny: int, thickness: float, folder: str) -> DataFrame:
    """Write series of 16-bit samples as DICOM files below ``folder``, a directory for each; returns image_id, path.

    A row is a file: image_id, file (a number), instance, along (the position of its first frame), frames (arrays of nx * ny samples, a thickness apart), syntax. Attempts write to names
    of their own, as in ``write_isq``, which tells when writing happens.
    """

    def save(batches):
        import numpy as np

        where, base = _open(folder)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                where.create_dir(f"{base}/{r['image_id']}")
                name, part = f"{base}/{r['image_id']}/{r['file']}.dcm", f"{base}/{r['image_id']}-{r['file']}.{uuid.uuid4().hex}.part"
                with where.open_output_stream(part) as f:
                    f.write(dicom.written(np.array(r["frames"]).reshape(-1, ny, nx), f"1.2.{r['image_id']}", r["instance"], (0.0, 0.0, r["along"]), thickness, r["syntax"]))
                where.move(part, name)
                out.append((r["image_id"], f"{folder.rstrip('/')}/{r['image_id']}"))
            if out:
                yield _batch(out, "image_id long, path string")

    rows = files.select(F.col("image_id").cast("long"), F.col("file").cast("long"), "instance", F.col("along").cast("double"), "frames", "syntax")
    return rows.mapInArrow(save, "image_id long, path string").distinct()
