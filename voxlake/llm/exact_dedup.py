"""Exact deduplication: counting quotient filters find the texts that occur more than once, and their bytes are compared.

1. Every row gets a SHA-256 and a 64-bit fingerprint (its first bits); these narrow rows are written once.
2. Each task builds counting quotient filters of its fingerprints, one for each range of their leading bits. Filters of a range are merged
   into one. Rows in the shuffle are filters, so a text with a third of all rows is one remainder with a count.
3. Fingerprints with a count above one set bits in a map of at most ``MAP_BITS`` bits, which every task gets. It only spares texts that
   are surely single; a wrong bit sends a single text to the comparison, where it stays single.
4. Texts that may be repeated are grouped by their bytes. Copies meet within their task first, then in ``SALTS`` groups where a
   text is very frequent, then over all. The classes so verified are joined to the narrow rows by digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quotient_filter import U, CountingQuotientFilter, merged
from .scratch import small_batches, stored

#: Fingerprints of a range of merged filters, on average at most; ranges are a power of two, and at least so many.
RANGE_FINGERPRINTS, LEAST_RANGES = 1 << 20, 64
#: Fingerprints of a task that go into one set of filters.
TASK_FINGERPRINTS = 1 << 20
#: Bits of the map of repeated fingerprints: 16 a row, up to 64 MB in all. Beyond some 10^9 different repeated texts it spares little, and each task's different texts are all compared.
MAP_BITS = 1 << 29
#: A fingerprint with this share of all rows is very frequent (there are at most as many as its inverse); copies of it are first counted in so many groups.
FREQUENT, SALTS = 1 / 1024, 32


def _power(n: float) -> int:
    """The exponent of the least power of two from ``n`` on."""
    return max(0, int(np.ceil(np.log2(max(n, 1)))))


def _range_filters(rows: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """range, filter: the counting quotient filters of each task's fingerprints, by their leading ``range_bits`` bits."""
    rest = bits - range_bits

    def cut(parts: list[np.ndarray]):
        fingerprints, counts = np.unique(np.concatenate(parts), return_counts=True)
        section = (fingerprints >> U(rest)).astype(np.int64)
        at = np.flatnonzero(np.append(True, section[1:] != section[:-1]))
        ends = np.append(at[1:], len(section))
        filters = [CountingQuotientFilter.of(fingerprints[a:b] & U((1 << rest) - 1), counts[a:b], rest).to_bytes() for a, b in zip(at, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(section[at]), pa.array(filters, pa.binary())], ["range", "filter"])

    def build(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(U))
            n += len(batch)
            if n >= TASK_FINGERPRINTS:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    return rows.select("fingerprint").mapInArrow(build, "range long, filter binary")


def _merged_filters(filters: DataFrame, bits: int, range_bits: int, map_bits: int, frequent: float) -> DataFrame:
    """By range: the merged filter, its section of the map of repeated fingerprints, and its very frequent fingerprints."""
    rest, section_bits = bits - range_bits, map_bits - range_bits

    def merge(group: pa.Table) -> pa.Table:
        section = group.column("range")[0].as_py()
        one = merged((CountingQuotientFilter.from_bytes(x.as_py()) for x in group.column("filter")), rest)
        fingerprints, counts = one.items()
        seen = np.zeros(1 << section_bits, dtype=bool)
        seen[(fingerprints[counts > 1] >> U(rest - section_bits)).astype(np.int64)] = True
        often = ((fingerprints | U(section << rest))[counts > max(1, frequent)]).view(np.int64).tolist()
        return pa.table({"range": [section], "filter": pa.array([one.to_bytes()], pa.binary()), "seen": pa.array([np.packbits(seen).tobytes()], pa.binary()), "often": pa.array([often], pa.list_(pa.int64()))})

    return filters.groupBy("range").applyInArrow(merge, "range long, filter binary, seen binary, often array<long>")


def repeated_fingerprints(filters: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """fingerprint, copies: those of merged filters (range, filter) that occur more than once."""
    rest = bits - range_bits

    def read(batches):
        for batch in batches:
            for section, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                fingerprints, counts = CountingQuotientFilter.from_bytes(data.as_py()).items()
                found = counts > 1
                yield pa.RecordBatch.from_arrays([pa.array((fingerprints[found] | U(section << rest)).view(np.int64)), pa.array(counts[found])], ["fingerprint", "copies"])

    return filters.select("range", "filter").mapInArrow(read, "fingerprint long, copies long")


def classes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text).

    Texts are equal when their bytes are (null counts as empty). Of equal texts the row with the largest doc_id stays; rows without an id
    give way to those with one. Of repeated rows (equal text and id) one stays, and of rows without any id, too. An empty table gives no rows; other
    columns are ignored. ``bits`` (up to 64) are those of a fingerprint; fewer make more texts meet that are different, and change no result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    top = F.conv(F.substring(digest, 1, 16), 16, -10).cast("long")
    hashed = [F.unhex(digest).alias("digest"), (F.shiftrightunsigned(top, 64 - bits) if bits < 64 else top).alias("fingerprint")]
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *hashed), "digests")

    n = rows.count()
    range_bits = min(max(_power(LEAST_RANGES), _power(n / RANGE_FINGERPRINTS)), bits - 2)
    map_bits = min(max(_power(16 * n), range_bits), _power(MAP_BITS), bits)
    range_bits = min(range_bits, map_bits)
    filters = stored(_merged_filters(_range_filters(rows, bits, range_bits), bits, range_bits, map_bits, n * FREQUENT), "filters")
    # bounded: MAP_BITS bits and 1 / FREQUENT numbers, whatever the input
    seen = np.zeros(1 << max(map_bits - 3, 0), dtype=np.uint8)
    width, often = max((1 << (map_bits - range_bits)) >> 3, 1), []
    for r in filters.select("range", "seen", "often").toLocalIterator():
        if map_bits - range_bits >= 3:
            seen[r["range"] * width : (r["range"] + 1) * width] = np.frombuffer(r["seen"], np.uint8)
        else:
            at = (r["range"] << (map_bits - range_bits)) + np.flatnonzero(np.unpackbits(np.frombuffer(r["seen"], np.uint8)))
            np.bitwise_or.at(seen, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        often += r["often"]
    shared = spark.sparkContext.broadcast(seen)

    @F.pandas_udf("boolean")
    def repeated(fingerprint):
        import pandas as pd

        at = (fingerprint.to_numpy().astype(np.int64).view(U) >> U(bits - map_bits)).astype(np.int64)
        return pd.Series((shared.value[at >> 3] & (128 >> (at & 7))) > 0)

    salt = F.when(F.col("fingerprint").isin(often), F.spark_partition_id() % SALTS).otherwise(0) if often else F.lit(0)
    copies = docs.select(text.alias("text"), *hashed).where(repeated("fingerprint")).withColumn("salt", salt).groupBy("digest", "text", "salt").agg(F.count("*").alias("n"))
    same = copies.repartition("digest").groupBy("digest", "text").agg(F.sum("n").alias("n")).groupBy("digest").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    stays = (
        rows.where(repeated("fingerprint"))
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("keep_row"), F.count("*").alias("rows"))
        .where("rows > 1")
    )
    agree = F.when((F.col("texts") == 1) & (F.col("n") == F.col("rows")), F.col("n")).otherwise(F.raise_error(F.lit("two texts have one SHA-256, or the table changed while it was read")).cast("long"))
    # written, so that the join below has no aggregate on either side and Spark can split a text with very many copies
    groups = stored(stays.join(same, "digest", "left").select("digest", "keep_id", "keep_row", agree.alias("group_size")), "classes")
    return rows.join(groups, "digest", "left").select(
        "doc_id",
        _of("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("row") == _of("keep_row", "row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _of(of_class: str, own: str) -> Column:
    return F.when(F.col("group_size").isNull(), F.col(own)).otherwise(F.col(of_class))
