"""``spark.read.format("volume")``: volume files as a data source.

Options: a path, or several (``load([...])``, or ``paths`` as a JSON list; a comma is a part of a name), ``explicit`` ("ISQ" or "DICOM" for files of other names), ``content``
("bricks", or "headers"), ``partition_bytes``. Planning opens no file: it asks for sizes, and puts small volumes together and cuts large ones into shares of their
planes until a partition has about ``partition_bytes``. Executors open headers. Filters on image_id drop volumes in planning, those on z drop planes before their samples are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from statistics import median

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..model import BRICK, VOLUME
from .volume_files import _NAMES, _listed, _open, _planes_of, _samples

PARTITION_BYTES = 64 << 20
#: Paths whose sizes are asked for at once.
THREADS = 32
_TESTS = {
    EqualTo: lambda x, v: x == v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v,
}


class Share(InputPartition):
    """Volumes (image_id, path), and which share of their planes: ``share`` of ``shares``."""

    def __init__(self, volumes: list[tuple[int, str]], share: int = 0, shares: int = 1):
        self.volumes, self.share, self.shares = volumes, share, shares


def _bytes(path: str) -> int:
    """A file's size; a directory counts with the sizes of its files, a single DICOM file as itself."""
    where, name = _open(path)
    info = where.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.Directory:
        return sum(x.size or 0 for x in where.get_file_info(pafs.FileSelector(name)) if x.type == pafs.FileType.File)
    return info.size or 0


def volume(image_id: int, path: str, explicit: str | None) -> list[dict]:
    """The planes of the volume at a path, in order, with its header; the rules are those of ``volume_files.planes``."""
    found = [dict(zip(_NAMES, p, strict=True)) | {"image_id": image_id, "path": path, "format": kind, "file": file, "alone": alone} for _, _, kind, file, alone in _listed(image_id, path, explicit) for p in _planes_of(kind, file, alone)]
    if not found:
        raise ValueError(f"{path}: no series")
    series = next((x["series"] for x in found if x["alone"]), min(x["series"] for x in found))
    rows = [x for x in found if x["series"] == series]
    placed = all(x["along"] is not None for x in rows)
    rows.sort(key=lambda x: (x["along"] if placed else 0, x["instance"], x["file"], x["frame"]))
    shared = {c: rows[0][c] for c in ("scalar_type", "spacing", "origin", "direction")} | {"nz": len(rows)}
    gaps = [d for a, b in zip(rows, rows[1:], strict=False) if placed and (d := b["along"] - a["along"]) > 0]
    if gaps:
        shared["spacing"] = [*shared["spacing"][:2], median(gaps)]
    return [x | shared | {"z": z} for z, x in enumerate(rows)]


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.explicit, self.headers, self.size = options.get("explicit"), options.get("content", "bricks") == "headers", int(options.get("partition_bytes", PARTITION_BYTES))
        self.wanted: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("image_id",), ("z",)) and (f.attribute == ("image_id",) or not self.headers):
                self.wanted.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _kept(self, name: str, value: int) -> bool:
        return all(_TESTS[kind](value, v) for n, kind, v in self.wanted if n == name)

    def partitions(self) -> list[Share]:
        volumes = [(i, p) for i, p in enumerate(self.paths) if self._kept("image_id", i)]
        with ThreadPoolExecutor(THREADS) as pool:
            sizes = list(pool.map(lambda v: _bytes(v[1]), volumes))
        out, together, n = [], [], 0
        for v, size in zip(volumes, sizes, strict=True):
            if size > self.size and not self.headers:
                shares = -(-size // self.size)
                out += [Share([v], k, shares) for k in range(shares)]
                continue
            if together and n + size > self.size:
                out.append(Share(together))
                together, n = [], 0
            together.append(v)
            n += size
        return [*out, Share(together)] if together or not out else out

    def read(self, partition: Share | None) -> Iterator[tuple | pa.RecordBatch]:
        for image_id, path in partition.volumes if partition else []:
            rows = volume(image_id, path, self.explicit)
            if self.headers:
                p = rows[0]
                extent = (0, p["nx"] - 1, 0, p["ny"] - 1, 0, p["nz"] - 1)
                yield (image_id, path, p["format"], p["scalar_type"], extent, tuple(p["spacing"]), tuple(p["origin"]), p["direction"])
                continue
            for p in rows[len(rows) * partition.share // partition.shares : len(rows) * (partition.share + 1) // partition.shares]:
                if self._kept("z", p["z"]):
                    yield pa.RecordBatch.from_arrays([pa.array([image_id], pa.int64()), pa.array([p["z"]], pa.int32()), pa.array([_samples(p)], pa.list_(pa.float64()))], ["image_id", "z", "data"])


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> StructType:
        return VOLUME if self.options.get("content", "bricks") == "headers" else BRICK

    def reader(self, schema: StructType) -> VolumeReader:
        return VolumeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known. Filters reach it where the session has ``spark.sql.python.filterPushdown.enabled``; its settings are left as they are."""
    spark.dataSource.register(VolumeSource)
