"""Exact substring deduplication: bytes covered by a string of ``LENGTH`` bytes that starts anywhere else as well.

Prefix doubling over the positions that can matter. All positions of all texts would be sorted pairs of twenty bytes each for every
byte of input; so positions are first ranked coarsely, and only classes with more than one member are ranked further:

1. A string's first rank is the least hash of the k-byte strings in it (k = LENGTH / 5). Equal strings have equal ranks, and neighbouring
   strings mostly share theirs, so runs of positions are what Spark counts, joins and shuffles. Ranks that occur once are dropped.
2. Runs with equal bytes are one segment, with the number of its occurrences. Segments are dealt by rank. A rank that too many different
   segments share is refined at growing lengths, with k halfway to LENGTH each time and k = LENGTH at last, until it is shared by few.
3. Where a rank's segments meet, positions are sorted by pairs of ranks at growing offsets (8, 16, 32, ... bytes) and
   reranked until they are unique or LENGTH is reached. These ranks are of the bytes themselves: no hash decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches, stored
from .textbatch import SLICE_BYTES, U, prefix_sums, range_hash, slices, utf8

LENGTH = 200
#: Positions of a segment at most; longer runs (of periodic text) are cut.
SEGMENT = 4096
#: Different segments of a rank that are ranked in one task; more are refined first.
SHARED = 1000
#: Compressed bytes of the texts that are handled at once.
SQUEEZED_BYTES = SLICE_BYTES // 3
#: Bytes that are ranked at once.
CHUNK = 1 << 22


def lengths(length: int) -> list[int]:
    """The growing k: a fifth of the length, then halfway to it, and at last all of it."""
    out = [max(1, length // 5)]
    while out[-1] < length - 4:
        out.append((out[-1] + length) // 2)
    return [*out, length] if out[-1] < length else out


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i : i + w] for every i where that is whole."""
    have = 1
    while have * 2 <= w:
        x = pick(x[:-have], x[have:]) if len(x) > have else x[:0]
        have *= 2
    rest = w - have
    return (pick(x[:-rest], x[rest:]) if len(x) > rest else x[:0]) if rest else x


def runs(buf: np.ndarray, offs: np.ndarray, k: int, length: int) -> tuple[np.ndarray, ...]:
    """(text, start in the text, positions, rank, tied) of maximal runs of positions whose strings have the same first rank.

    tied: that rank's k-byte string may come twice in one of the strings, so that strings of the run may equal each other.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, bool))
    if len(buf) < length or not (np.diff(offs) >= length).any():
        return none
    sums = prefix_sums(buf)
    at = np.arange(len(buf) - k + 1)
    x = range_hash(sums, at, at + k) | U(1)
    w = length - k + 1
    least = _slide(x, w, np.minimum)
    size = np.maximum(np.diff(offs) - length + 1, 0)
    doc = np.repeat(np.arange(len(size)), size)
    pos = np.repeat(offs[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(doc))
    rank = least[pos]
    new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(pos)]]))
    owner, start, rank = doc[first], pos[first], rank[first]
    # k-byte strings that are the least of some string, and those of them that come again within reach
    whole = np.zeros(len(x), dtype=U)
    whole[pos] = least[pos]
    most = _slide(np.concatenate([np.zeros(w - 1, U), whole]), w, np.maximum)
    chosen = np.flatnonzero(most == x)
    order = np.lexsort((chosen, x[chosen]))
    c = chosen[order]
    near = (x[c][1:] == x[c][:-1]) & (c[1:] - c[:-1] <= w)  # at a gap of w the two reaches still adjoin: one run
    tied = np.isin(rank, x[c][1:][near])
    if (n > SEGMENT).any():
        parts = -(-n // SEGMENT)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        owner, start, rank, tied, whole_n = (np.repeat(v, parts) for v in (owner, start, rank, tied, n))
        start = start + nth * SEGMENT
        n = np.minimum(whole_n - nth * SEGMENT, SEGMENT)
        tied = np.ones_like(tied) & (tied | (whole_n > SEGMENT))
    return owner, start - offs[owner], n, rank, tied


def repeated(buf: np.ndarray, offs: np.ndarray, length: int) -> np.ndarray:
    """For every position of the segments (at whose end no string of ``length`` bytes starts): whether its string starts at another position, too.

    Prefix doubling: ranks of strings of 1, 2, 4, ... bytes; positions whose rank is unique are out.
    """
    n = len(buf)
    end = np.repeat(offs[1:], np.diff(offs))
    room = end - np.arange(n)
    rank, have = buf.astype(np.int64), 1
    while have < length:
        step = min(have, length - have)
        live = np.flatnonzero(room >= have + step)
        live = live[(rank[live] >= 0) & (rank[live + step] >= 0)]
        if have < 4 and step == have:  # short strings fit a number: nothing to sort yet
            made = np.full(n, -1, dtype=np.int64)
            made[live] = rank[live] << (8 * have) | rank[live + step]
        else:
            # ranks of up to four bytes take 32 bits, later ones are places in the order
            bits = 32 if have <= 4 else int(n).bit_length()
            keys = rank[live].astype(U) << U(bits) | rank[live + step].astype(U)
            order = np.argsort(keys)
            keys = keys[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1 if len(keys) else np.zeros(0, bool)
            made = np.full(n, -1, dtype=np.int64)
            made[live[order[many]]] = group[many]
        rank, have = made, have + step
    if length == 1:
        return (np.bincount(rank, minlength=256)[rank] > 1) if n else np.zeros(0, bool)
    out = (rank >= 0) & (room >= length)
    if have <= 4 and n:  # not reranked yet
        _, inverse, count = np.unique(rank, return_inverse=True, return_counts=True)
        out &= count[inverse] > 1
    return out


def _covered(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte ranges covered by the strings at flagged positions."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) > length)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + length


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _lookup() -> Column:
    """A document's id and a hash of its text, as text, so that rows which share an id but not the text don't meet."""
    return F.concat_ws("~", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64(F.coalesce("text", F.lit("")))))


def _squeezed(texts: pa.Array) -> pa.Array:
    """Each text's bytes compressed: texts are shuffled twice and stored once, and Spark's own codec is made for speed."""
    buf, offs = utf8(texts)
    pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
    return pa.array([pack(buf[a:b].tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.binary())


def _texts(squeezed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets."""
    unpack = zstandard.ZstdDecompressor().decompress
    raw = [unpack(x) for x in squeezed.to_pylist()]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])


def _lists(owner: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _sketched(docs: DataFrame, length: int) -> DataFrame:
    small_batches(docs.sparkSession)
    k = lengths(length)[0]

    def sketch(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = utf8(part.column("text"))
                raw = [buf[a:b].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                owner, start, n, rank, tied = runs(buf, offs, k, length)
                own = [_lists(owner, len(part), v) for v in (start.astype(np.int32), n.astype(np.int32), rank.view(np.int64), tied)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lookup"), pa.array([_digest(x) for x in raw], pa.binary()), pa.array(np.diff(offs)), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), *own],
                    ["doc_id", "lookup", "digest", "n_bytes", "sha256", "start", "n", "rank", "tied"],
                )

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("lookup", _lookup())
    return plain.mapInArrow(sketch, "doc_id long, lookup string, digest binary, n_bytes long, sha256 string, start array<int>, n array<int>, rank array<long>, tied array<boolean>")


def _ranked(segments: DataFrame, length: int) -> DataFrame:
    """segment, starts, ends (covered byte ranges) of segments (segment, rank, bytes, times) that have repeated strings. Segments of a rank are ranked together."""

    def rank(batches):
        names = ["segment", "bytes", "times", "rank"]
        kept: list[tuple] = []
        size = 0

        def flush(rows):
            data = [r[1] for r in rows]
            buf = np.frombuffer(b"".join(data), dtype=np.uint8)
            offs = np.concatenate([[0], np.cumsum([len(x) for x in data])])
            again = repeated(buf, offs, length)
            out = []
            for i, r in enumerate(rows):
                own = again[offs[i] : offs[i + 1]]
                if r[2] > 1:
                    own = np.zeros(len(own), dtype=bool)
                    own[: len(own) - length + 1] = True
                a, b = _covered(own, length)
                if len(a):
                    out.append((r[0], a.tolist(), b.tolist()))
            if out:
                kinds = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["segment", "starts", "ends"])

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                if size > CHUNK and row[3] != kept[-1][3]:
                    yield from flush(kept)
                    kept, size = [], 0
                kept.append(row)
                size += len(row[1])
        if kept:
            yield from flush(kept)

    return segments.select("segment", "bytes", "times", "rank").repartition("rank").sortWithinPartitions("rank").mapInArrow(rank, "segment binary, starts array<long>, ends array<long>")


def _merged(segments: DataFrame, level: int, length: int, shared: int) -> DataFrame:
    """As ``_ranked``, with the ranks that more than ``shared`` segments have refined first."""
    busy = segments.groupBy("rank").agg(F.count("*").alias("m")).where(F.col("m") > shared).select("rank")
    ks = lengths(length)
    if level + 1 >= len(ks) or busy.isEmpty():
        return _ranked(segments, length)
    busy = stored(busy, "busy")
    few, many = segments.join(busy, "rank", "left_anti"), segments.join(busy, "rank", "left_semi")

    def split(batches):
        for batch in batches:
            for part in slices(batch, "bytes"):
                buf, offs = utf8(part.column("bytes"))
                owner, start, n, rank, tied = runs(buf, offs, ks[level + 1], length)
                at = (offs[owner] + start).tolist()
                data = [buf[a : a + c + length - 1].tobytes() for a, c in zip(at, n.tolist(), strict=True)]
                names = ["segment", "at", "rank", "tied", "child", "bytes", "times"]
                yield pa.RecordBatch.from_arrays(
                    [part.column("segment").take(pa.array(owner)), pa.array(start), pa.array(rank.view(np.int64)), pa.array(tied), pa.array(map(_digest, data), pa.binary()), pa.array(data, pa.binary()), part.column("times").take(pa.array(owner))], names
                )

    parts = stored(many.select("segment", "bytes", "times").mapInArrow(split, "segment binary, at long, rank long, tied boolean, child binary, bytes binary, times long"), "parts")
    children = parts.groupBy("child").agg(F.first("rank").alias("rank"), F.first("tied").alias("tied"), F.first("bytes").alias("bytes"), F.sum("times").alias("times"))
    counts = parts.groupBy("rank").agg(F.sum("times").alias("all")).where(F.col("all") > 1).select("rank")
    children = children.where("tied").unionByName(children.where("not tied").join(counts, "rank", "left_semi").select(*children.columns))
    children = stored(children.select(F.col("child").alias("segment"), "rank", "bytes", "times"), "children")
    found = _merged(children, level + 1, length, shared).withColumnRenamed("segment", "child")
    up = parts.select("segment", "child", "at").join(found, "child")
    shift = lambda c: F.transform(c, lambda x: x + F.col("at"))
    up = up.groupBy("segment").agg(F.flatten(F.collect_list(shift("starts"))).alias("starts"), F.flatten(F.collect_list(shift("ends"))).alias("ends"))
    return _ranked(few, length).unionAll(up)


def removed_ranges(docs: DataFrame, length: int = LENGTH, shared: int = SHARED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' sketches, the texts (digest, copies, row), and what remains of texts with removed bytes (digest, n_removed, n_spans, kept_sha256, kept)."""
    rows = stored(_sketched(docs, length).withColumn("row", F.monotonically_increasing_id()), "sketches")
    texts = rows.groupBy("digest").agg(F.min(F.struct("row", "lookup")).alias("first"), F.count("*").alias("copies"))
    texts = texts.select("digest", F.col("first.row").alias("row"), F.col("first.lookup").alias("lookup"), "copies")
    spans = rows.select("row", F.inline(F.arrays_zip("start", "n", "rank", "tied")))
    again = spans.groupBy("rank").agg(F.count("*").alias("m")).where("m > 1").select("rank")
    columns = ["row", "start", "n", "rank"]
    active = spans.where("not tied").join(again, "rank", "left_semi").select(*columns).unionAll(spans.where("tied").select(*columns))
    per_row = active.groupBy("row").agg(F.collect_list(F.struct("start", "n", "rank")).alias("spans"))
    wanted = per_row.join(texts, "row").select("row", "digest", "lookup", "spans")
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("lookup", _lookup()).select("lookup", "text")

    def squeeze(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("lookup"), _squeezed(batch.column("text"))], ["lookup", "text"])

    plain = plain.mapInArrow(squeeze, "lookup string, text binary")

    def same(batches):
        for batch in batches:
            for part in slices(batch, "text", SQUEEZED_BYTES):
                buf, offs = _texts(part.column("text"))
                good = [_digest(buf[a:b].tobytes()) == want for a, b, want in zip(offs[:-1].tolist(), offs[1:].tolist(), part.column("digest").to_pylist(), strict=True)]
                yield part.select(["row", "digest", "text", "spans"]).filter(pa.array(good, pa.bool_()))

    found = plain.join(wanted, "lookup").select("row", "digest", "text", "spans").mapInArrow(same, "row long, digest binary, text binary, spans array<struct<start: int, n: int, rank: long>>")
    if not rows.groupBy("digest", "lookup").count().where("count > 1").isEmpty():
        found = found.dropDuplicates(["row"])  # rows that repeat an id and a text
    found = stored(found, "active")

    def cut(wide: bool):
        def segments(batches):
            for batch in batches:
                for part in slices(batch, "text", SQUEEZED_BYTES):
                    buf, offs = _texts(part.column("text"))
                    spans = part.column("spans")
                    owner = np.repeat(np.arange(len(part)), np.diff(spans.offsets.to_numpy()))
                    flat = spans.flatten()
                    start, n = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
                    at = (offs[owner] + start).tolist()
                    data = [buf[a : a + c + length - 1].tobytes() for a, c in zip(at, n.tolist(), strict=True)]
                    name = pa.array(map(_digest, data), pa.binary())
                    if wide:
                        yield pa.RecordBatch.from_arrays([name, flat.field("rank"), pa.array(data, pa.binary())], ["segment", "rank", "bytes"])
                    else:
                        yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(owner)), pa.array(start), name], ["row", "at", "segment"])

        return segments

    texts_in = found.select("row", "text", "spans")
    segments = texts_in.mapInArrow(cut(True), "segment binary, rank long, bytes binary").groupBy("segment").agg(F.first("rank").alias("rank"), F.first("bytes").alias("bytes"), F.count("*").alias("times"))
    uses = texts_in.mapInArrow(cut(False), "row long, at long, segment binary")
    ranges = _merged(stored(segments, "segments"), 0, length, shared)
    shift = lambda c: F.transform(c, lambda x: x + F.col("at"))
    per_text = uses.join(ranges, "segment").groupBy("row").agg(F.flatten(F.collect_list(shift("starts"))).alias("starts"), F.flatten(F.collect_list(shift("ends"))).alias("ends"))

    def remove(batches):
        for batch in batches:
            for part in slices(batch, "text", SQUEEZED_BYTES):
                out = []
                buf, offs = _texts(part.column("text"))
                for i, (digest, starts, ends) in enumerate(zip(part.column("digest").to_pylist(), part.column("starts").to_pylist(), part.column("ends").to_pylist(), strict=True)):
                    own = buf[offs[i] : offs[i + 1]]
                    steps = np.zeros(len(own) + 1, dtype=np.int64)
                    np.add.at(steps, np.array(starts), 1)
                    np.add.at(steps, np.array(ends), -1)
                    gone = np.cumsum(steps[:-1]) > 0
                    rest = own[~gone].tobytes()
                    out.append((digest, int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(rest).hexdigest(), rest))
                if out:
                    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["digest", "n_removed", "n_spans", "kept_sha256", "kept"])

    left = found.select("row", "digest", "text").join(per_text, "row").mapInArrow(remove, "digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return rows, texts, left


def without_repeats(docs: DataFrame, length: int = LENGTH, shared: int = SHARED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text), texts taken as UTF-8 bytes.

    Removed is every byte covered by a string of ``length`` bytes that also starts anywhere else, in this document or another; matches stay within
    documents and are judged on the input. Null texts are empty; texts shorter than ``length`` stay whole. Repeated rows are copies of each other:
    from ``length`` bytes on all of them go. Rows without an id and repeated ids are rows like others; other columns are ignored.
    """
    rows, texts, left = removed_ranges(docs, length, shared)
    # written, so that it is dealt anew for the join, whose large keys Spark can then split
    facts = stored(texts.select("digest", "copies").join(left.drop("kept"), "digest", "left"), "facts")
    out = rows.select("doc_id", "digest", "n_bytes", "sha256").join(facts, "digest")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
