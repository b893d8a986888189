"""Which reader a path needs, and which path or series is opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCANCO = (".isq", ".rsq", ".rad", ".aim")
DICOM = (".dcm", ".dicom")


def _ends(path: Column, endings: tuple[str, ...]) -> Column:
    low = F.lower(path)
    out = F.lit(False)
    for e in endings:
        out = out | low.endswith(e)
    return out


def format_dispatch(path: Column, is_dir: Column | None = None, explicit: Column | None = None) -> Column:
    """'ISQ' for Scanco files (any of their four endings), 'DICOM' for directories and all else; an explicit format wins."""
    found = F.when(_ends(path, SCANCO), "ISQ").otherwise("DICOM")
    if is_dir is not None:
        found = F.when(is_dir, "DICOM").otherwise(found)
    return F.coalesce(explicit, found) if explicit is not None else found


def readable_probe(path: Column, exists: Column, is_dir: Column, permitted: Column, header_ok: Column | None = None) -> Column:
    """Whether a path can be opened: it exists, may be read, and is a directory or a file of a known ending (Scanco files with a good header)."""
    scanco = _ends(path, SCANCO) & (header_ok if header_ok is not None else F.lit(True))
    return F.coalesce(exists & permitted & (is_dir | scanco | _ends(path, DICOM)), F.lit(False))


def first_readable(paths: DataFrame, readable: Column, *order: str) -> DataFrame:
    """The first readable path of a drop."""
    return paths.where(readable).orderBy(*order).limit(1)


def first_series(files: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first series of each directory. A rank filter of 1 is applied before the shuffle, too."""
    return files.withColumn("ordinal", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("ordinal = 1").drop("ordinal")


def with_pixels(files: DataFrame) -> DataFrame:
    return files.where("has_pixels")
