"""Packing documents into fixed-length training sequences: shortest-pack-first over the length histogram.

1. Each document is tokenised once, ended with an id, and cut into whole sequences and a rest. Only the pieces'
   facts (where, how long, checksum) are kept, with each piece's number among those of its length in its task.
2. The histogram of piece lengths has at most ``most`` rows. On the driver, lengths are placed longest first,
   each into the packs with the most room left; equal packs are one pattern with a count, so the work depends
   on the number of lengths and not on the number of documents.
3. A piece's rank among all of its length is its number in its task plus the counts of earlier tasks. Every
   pattern's slot owns a range of ranks; the piece's rank gives its sequence and offset.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small_batches, stored
from .textbatch import slices

MOST = 2048
END_ID = 1


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary, as a tokenizers file and as the same merges in rank form, and its splitting pattern.

    The rank form is several times faster and gives the same ids. The tokenizers file decides wherever they could differ:
    in texts that hold one of its special tokens, or that the faster encoder can't take.
    """

    json_path: str
    ranks_path: str
    pattern: str

    @staticmethod
    def public() -> Vocabulary:
        import public_tokenizers as p

        return Vocabulary(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


_encoders: dict[Vocabulary, tuple] = {}


def encoder(vocabulary: Vocabulary):
    """text -> ids (uint32 array)"""
    if vocabulary not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(vocabulary.json_path)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        with open(vocabulary.ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
        _encoders[vocabulary] = (slow, special, fast)
    slow, special, fast = _encoders[vocabulary]

    def encode(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            except ValueError:  # its regular expressions have a limit of steps, which long runs of blanks reach
                pass
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def pieces(docs: DataFrame, vocabulary: Vocabulary, most: int = MOST, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece; task and nth, its number among those of its length there."""

    small_batches(docs.sparkSession)

    def cut(batches):
        encode = encoder(vocabulary)
        task, seen = TaskContext.get().partitionId(), np.zeros(most + 1, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.array([end_id], dtype="<u4")).astype("<u4", copy=False)
                    for start in range(0, len(ids), most):
                        piece = ids[start : start + most]
                        out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), task, int(seen[len(piece)])))
                        seen[len(piece)] += 1
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long")


def patterns(histogram: dict[int, int], most: int = MOST) -> list[tuple[int, list[int]]]:
    """Packs as (count, lengths): lengths longest first, each into the shortest packs that exist, in whole runs."""
    done: list[tuple[int, list[int]]] = []
    open_packs: list[tuple[int, int, int, list[int]]] = []  # minus the room left, a tie-breaker, count, lengths
    made = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, _, count, lengths = heapq.heappop(open_packs)
                used = taken = min(left, count)
                if used < count:
                    made += 1
                    heapq.heappush(open_packs, (room, made, count - used, lengths))
                fresh = (-room - length, used, [*lengths, length])
            else:  # none has room: the shortest pack is now each new one until it is full of this length
                each = min(left, most // length)
                used = left // each
                taken = used * each
                fresh = (most - each * length, used, [length] * each)
            left -= taken
            if fresh[0]:
                made += 1
                heapq.heappush(open_packs, (-fresh[0], made, fresh[1], fresh[2]))
            else:
                done.append((fresh[1], fresh[2]))
    return done + [(count, lengths) for _, _, count, lengths in sorted(open_packs, key=lambda x: x[1])]


def slots(packs: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, tokens of the sequence) sorted by length and rank."""
    out, rank, sequence = [], {}, 0
    for count, lengths in packs:
        offset, total = 0, sum(lengths)
        for length in lengths:
            first = rank.get(length, 0)
            out.append((length, first, sequence, offset, total))
            rank[length] = first + count
            offset += length
        sequence += count
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: Vocabulary, most: int = MOST, end_id: int = END_ID) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding.

    Null and empty texts have the end id alone. Repeated rows are packed each, rows without an id too. An empty table gives no
    rows. ``padding`` is what the sequence lacks to ``most``, or 0 where its tokens number a power of two.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary, most, end_id), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("task", "length", F.coalesce(earlier, F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``most`` rows at most
    places = spark.sparkContext.broadcast(slots(patterns(histogram, most)))

    def place(batches):
        slot = places.value
        keys = (slot[:, 0] << 48) | slot[:, 1] if len(slot) else slot[:, 0]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            length = batch.column("length").to_numpy()
            if not len(rank):
                continue
            own = slot[np.searchsorted(keys, (length << 48) | rank, "right") - 1]
            tokens = own[:, 4]
            padding = np.where(tokens & (tokens - 1) == 0, 0, most - tokens)
            more = {"sequence_id": own[:, 2] + rank - own[:, 1], "offset": own[:, 3], "padding": padding}
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *map(pa.array, more.values())], [*names, *more])

    ranked = cut.join(before, ["task", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long")
