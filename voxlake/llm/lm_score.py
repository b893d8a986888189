"""Language-model scores by stupid backoff, computed as joins of n-gram count tables.

1. Texts are packed into chunks of bounded size, written to the shared folder as they are read: no shuffle, and every later step sees the same chunks.
2. Each chunk's n-grams of all orders are counted and become rows of the count tables, partitioned by ranges of their hash: a row holds a chunk's n-grams of
   one range, sorted and packed. That is the exploded form with map-side combining, at some five bytes an n-gram instead of a row each.
3. For each range the counts of all chunks are added up and joined back to the rows on the n-gram; both are grouped by the same key, so one pass does both.
4. Chunks meet their counts again, and scores are summed per document.

Rows of the count tables number no more than chunks times ranges, nor than the n-grams, whichever is less: ranges without n-grams have no row. So work and
rows grow with the text, and at the worst a row is an n-gram.

A document's own n-grams are taken off the counts when it is scored; otherwise each n-gram would have been seen, and nothing backed off.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches, stored
from .textbatch import SHINGLE_WORD, U, Words, mix, powers, slices, utf8
from .textbatch import _inverse as STEP

ORDER = 3
BACKOFF = 0.4
#: Bytes of text in a chunk and n-grams in a range, about: what a task holds. A longer text is a chunk of its own.
CHUNK_BYTES = 1 << 22
BUCKET_GRAMS = 2_000_000
#: Bytes of text for one word, about; it only sets the number of ranges.
WORD_BYTES = 6
#: Tasks of a step, at most.
MOST_TASKS = 20_000
#: Ranges at least, so that small inputs are shared among executors, too.
LEAST_BUCKETS = 24
#: The chance that an n-gram shares its hash with another is at most two to the minus this.
SURE_BITS = 24
TOTAL = -1  # the range that adds up the words


_squeeze, _expand = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def _planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, the lowest first, with no more planes than are needed. Each is compressed by itself, if that makes it shorter: the high ones have few values, the low ones any."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    out = []
    for plane in planes:
        raw = plane.tobytes()
        short = _squeeze(raw)
        out.append(struct.pack("<I", len(short)) + short if len(short) < len(raw) else struct.pack("<I", 0) + raw)
    return b"".join(out)


def _numbers(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    at = place = 0
    while at < len(data):
        (size,) = struct.unpack_from("<I", data, at)
        end = at + 4 + (size or n)
        out[:, place] = np.frombuffer(_expand(data[at + 4 : end], max_output_size=n) if size else data[at + 4 : end], dtype=np.uint8)
        at, place = end, place + 1
    return out.view("<u8").ravel()


def hash_bits(grams: int) -> int:
    """Bits of a hash under which ``grams`` different n-grams are told apart, by ``SURE_BITS``."""
    return min(64, max(grams, 1).bit_length() + SURE_BITS)


class Grams:
    """The n-grams of a chunk of texts. ``hash`` and ``count`` are those of its distinct n-grams, sorted; ``at[o]`` has the place of the n-gram of o + 1 words that ends at each word (-1 where the text has too few)."""

    def __init__(self, texts: pa.Array, order: int, bits: int = 64):
        parts = []
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            w = Words(*utf8(pc.utf8_lower(part.column(0))), SHINGLE_WORD)
            parts.append((w.hash, w.counts))
        word, self.n_words = np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts])
        del parts
        n = len(word)
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.nth = nth = np.arange(n) - np.repeat(np.cumsum(self.n_words) - self.n_words, self.n_words)
        factor = powers(STEP, order + 1)
        total = np.zeros(n, dtype=U)
        hashes, places = [], []
        for o in range(order):
            # the word o places back times its factor; positions without it aren't used
            total[o:] += word[: n - o] * factor[o] if o < n else U(0)
            ends = np.flatnonzero(nth >= o)
            hashes.append(mix(total[ends] + U(o)) >> U(64 - bits))
            places.append(ends)
        self.hash, inverse, self.count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        del hashes
        self.at, k = [], 0
        for ends in places:
            at = np.full(n, -1, dtype=np.int32)
            at[ends] = inverse[k : k + len(ends)]
            k += len(ends)
            self.at.append(at)

    def own(self, at: np.ndarray) -> np.ndarray:
        """How often each word's n-gram of one order is in its own text."""
        key = self.doc * (len(self.hash) + 1) + at
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        return np.where(at >= 0, count[inverse], 0)


def _edges(hashes: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that have hashes (sorted), and where each begins, with the end. A range is an equal part of all hashes."""
    width = U(-(-(1 << bits) // buckets))
    own = hashes // width
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return own[first].astype(np.int64), np.append(first, len(own))


def _texts(chunk: dict) -> pa.Array:
    """The texts of a chunk's row."""
    raw = zstandard.ZstdDecompressor().decompress(chunk["texts"]) if chunk["texts"] else b""
    ends = np.frombuffer(chunk["ends"], dtype="<i8")
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes()), pa.py_buffer(raw))


_CHUNK = "chunk long, size long, ids binary, known binary, ends binary, texts binary"


def _chunked(docs: DataFrame, most: int) -> DataFrame:
    """chunk, and its documents' ids, which of them are known, the ends of their texts, and the texts, compressed: one row a chunk."""

    def pack(batches):
        task, made, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            known = np.array([i is not None for i in ids], dtype=np.uint8)
            body = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(b"".join(texts)) if size else b""
            kept = [np.array([i or 0 for i in ids], dtype="<i8").tobytes(), known.tobytes(), np.cumsum([len(x) for x in texts]).astype("<i8").tobytes(), body]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | made]), pa.array([size]), *(pa.array([x], pa.binary()) for x in kept)], ["chunk", "size", "ids", "known", "ends", "texts"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if size and size + len(t) > most:
                    yield row()
                    made, ids, texts, size = made + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(pack, _CHUNK)


_TABLE = [("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())]


def _sums(group: pa.Table) -> pa.Table:
    """Each chunk's n-grams of one range with the counts of all chunks."""
    sizes, chunks, bucket = group["n"].to_pylist(), group["chunk"].to_pylist(), group["bucket"][0].as_py()
    counts = np.concatenate([_numbers(x, n) for x, n in zip(group["counts"].to_pylist(), sizes, strict=True)]).astype(np.int64)
    if bucket == TOTAL:
        inverse, total = np.zeros(len(counts), dtype=np.int64), np.array([counts.sum()])
    else:
        grams = np.concatenate([np.cumsum(_numbers(x, n), dtype=U) for x, n in zip(group["grams"].to_pylist(), sizes, strict=True)])
        _, inverse = np.unique(grams, return_inverse=True)
        total = np.bincount(inverse, weights=counts).astype(np.int64)
    ends = np.cumsum(sizes)
    back = [_planes(total[inverse[e - n : e]].astype(U)) for e, n in zip(ends.tolist(), sizes, strict=True)]
    return pa.table([pa.array(chunks, pa.int64()), pa.array([bucket] * len(chunks), pa.int64()), pa.array(sizes, pa.int64()), pa.array(back, pa.binary())], names=["chunk", "bucket", "n", "totals"])


def _scores(chunk: dict, counts: pa.Table, order: int, backoff: float, bits: int) -> pa.Table:
    """doc_id, n_words, log_score of the documents of one chunk."""
    g = Grams(_texts(chunk), order, bits)
    place = np.argsort(counts["bucket"].to_numpy())
    sizes, data = counts["n"].to_pylist(), counts["totals"]
    words_all = int(_numbers(data[int(place[0])].as_py(), 1)[0])
    total = np.concatenate([np.zeros(0, np.int64), *(_numbers(data[i].as_py(), sizes[i]).astype(np.int64) for i in place[1:].tolist())])
    rest = np.maximum(words_all - g.n_words[g.doc], 1)
    most = np.minimum(g.nth + 1, order)  # the order that each word could have
    score, used = np.zeros(len(g.doc)), np.zeros(len(g.doc), dtype=np.int8)
    below = rest
    for o in range(1, order + 1):  # a higher order's score takes the place of a lower one's
        at = g.at[o - 1]
        seen = np.where(at >= 0, total[at] - g.own(at), 0) if len(total) else np.zeros(0, np.int64)
        hit = np.flatnonzero(seen > 0)
        # the words before make an n-gram of one word less, which ends at the word before
        score[hit] = np.log(seen[hit] / (below[hit - 1] if o > 1 else below[hit]))
        used[hit] = o
        below = seen
    none = used == 0
    score[none] = -np.log(rest[none])
    score += (most - used) * np.log(backoff)
    sums = np.bincount(g.doc, weights=score, minlength=len(g.n_words))
    ids = pa.array(np.frombuffer(chunk["ids"], dtype="<i8"), mask=np.frombuffer(chunk["known"], dtype=np.uint8) == 0)
    return pa.table([ids, pa.array(g.n_words.astype(np.int64)), pa.array(sums)], names=["doc_id", "n_words", "log_score"])


def scored(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log_score for every row of ``docs`` (doc_id, text), against the n-gram counts of all other rows.

    A word's score is the ratio of its longest n-gram's count to the count of that n-gram without the word (or to the number of words), times
    ``backoff`` for each order that was passed over; a word seen nowhere else counts as one in all words with one more such factor. log_score is the sum of
    natural logarithms. Words are those of shingles: lower case, punctuation dropped. Null, empty and wordless texts have no words and score 0. Repeated rows count
    as other rows of each other. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    chunks = stored(_chunked(docs, CHUNK_BYTES), "chunks")
    size, n_chunks = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    grams = size * order // WORD_BYTES
    bits, buckets = hash_bits(grams), max(LEAST_BUCKETS, -(-grams // BUCKET_GRAMS))

    def tables(batches):
        for batch in batches:
            for chunk in (r for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
                g = Grams(_texts(chunk), order, bits)
                rows = [(TOTAL, chunk["chunk"], 1, b"", _planes(np.array([g.n_words.sum()], dtype=U)))]
                own, edges = _edges(g.hash, buckets, bits)
                for b, x, y in zip(own.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    rows.append((b, chunk["chunk"], y - x, _planes(np.diff(g.hash[x:y], prepend=U(0))), _planes(g.count[x:y])))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), _TABLE, strict=True)], [n for n, _ in _TABLE])

    counted = chunks.mapInArrow(tables, "bucket long, chunk long, n long, grams binary, counts binary")
    # as many tasks as ranges and as chunks: what a task reads doesn't grow with the text
    sums = counted.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(_sums, "chunk long, bucket long, n long, totals binary")
    tasks = max(1, min(n_chunks, MOST_TASKS))
    texts, counts = chunks.drop("size").repartition(tasks, "chunk"), sums.repartition(tasks, "chunk")
    return texts.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(lambda texts, counts: _scores(texts.to_pylist()[0], counts, order, backoff, bits), "doc_id long, n_words long, log_score double")
