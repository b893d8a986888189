"""Benchmark decontamination: find short test items inside long documents.

Size-partitioned MinHash containment search. Items are partitioned by their number of shingle positions, up to
each power of two. For the partition with upper bound u, documents are read in windows of two
consecutive blocks of u shingles, so that an item that lies in a document lies in one window of
comparable size, and its Jaccard similarity with that window is high however long the document is.
Each permutation's minimum is a key of its own: a window that agrees with an item in one of them
makes the document a candidate. Candidates are verified by exact containment of the item's shingle set
in the whole document.

That similarity is of distinct shingles. It is low for items with few of them, or with many repetitions, so items with no more than
half as many distinct shingles as their partition's bound are looked up exactly: of an item with d shingles of which c must be in the document,
any d - c + 1 include one that is, so the rarest so many are keys. An item of fewer than k words is one shingle of all its words, which is
looked up among the documents' runs of as many words.

Items are a stated query set. They are taken in blocks of a bounded number of shingles; each block is
broadcast and all documents pass it, with no shuffle. Executors make the items' shingles and signatures.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches, stored
from .textbatch import WORD_K, Shingles, U, seeds, slices, window_hash

#: Permutations. The least favourable item that is left to them (just over u / 2 distinct shingles) has similarity 0.19 with a window that holds 0.8 of them, and is missed with probability 0.81**64, about 1e-6. An item
#: whose shingles lie farther apart in a document than a window has no such bound.
PERMUTATIONS = 64
#: An item's containment at which it counts as found.
CONTAINMENT = 0.8
#: Shingles and items of a block: what is broadcast at once is under 16 MB of shingles and 32 MB of signatures.
BLOCK_SHINGLES = 2_000_000
BLOCK_ITEMS = 50_000

PAIRS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("item_shingles", T.LongType()),
        T.StructField("shared_shingles", T.LongType()),
        T.StructField("containment", T.DoubleType()),
    ]
)


@dataclass
class Block:
    """Items of one block; ``levels`` has for each size partition u its keys: per permutation the sorted minima and the items they belong to; ``exact`` the sorted shingles, and their items, of those looked up by shingles; ``short`` by number of words the same of items with fewer than k."""

    ids: np.ndarray
    sets: list[np.ndarray]
    levels: dict[int, list[tuple[np.ndarray, np.ndarray]]]
    exact: tuple[np.ndarray, np.ndarray]
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def _rarest(sets: list[np.ndarray], few: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, and items: enough of each item's that a document which contains the item has one of them. Rare is what few of the items have."""
    if not few:
        return np.zeros(0, U), np.zeros(0, np.int64)
    values, inverse, times = np.unique(np.concatenate([sets[i] for i in few]), return_inverse=True, return_counts=True)
    keys, owner, at = [], [], 0
    for i in few:
        d = len(sets[i])
        needed = next((c for c in range(max(1, int(threshold * d) - 1), d) if c >= threshold * d), d)
        order = np.argsort(times[inverse[at : at + d]], kind="stable")[: d - needed + 1]
        keys.append(sets[i][order])
        owner.append(np.full(len(order), i, dtype=np.int64))
        at += d
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(keys, kind="stable")
    return keys[order], owner[order]


def _make_block(rows: list[tuple[int, int, int, bytes, bytes]], threshold: float, k: int) -> Block:
    """From (item, words, shingle positions, distinct shingles, signature)."""
    sets = [np.frombuffer(raw, dtype=U) for *_, raw, _ in rows]
    words, n, distinct = (np.array(x, dtype=np.int64) for x in ([r[1] for r in rows], [r[2] for r in rows], [len(x) for x in sets]))
    signature = np.frombuffer(b"".join(r[4] for r in rows), dtype=U).reshape(len(rows), -1)
    u = np.array([1 << max(3, (x - 1).bit_length()) for x in n.tolist()], dtype=np.int64)
    few = distinct * 2 <= u
    levels = {}
    for bound in np.unique(u[~few & (words >= k)]).tolist():
        members = np.flatnonzero((u == bound) & ~few & (words >= k))
        order = np.argsort(signature[members], axis=0, kind="stable")
        levels[bound] = [(signature[members[order[:, h]], h], members[order[:, h]]) for h in range(signature.shape[1])]
    short = {}
    for size in np.unique(words[words < k]).tolist():
        members = np.flatnonzero(words == size)
        keys = np.array([sets[i][0] for i in members], dtype=U)
        order = np.argsort(keys, kind="stable")
        short[size] = (keys[order], members[order])
    return Block(np.array([r[0] for r in rows]), sets, levels, _rarest(sets, np.flatnonzero(few & (words >= k)).tolist(), threshold), short)


def _blocks(items: DataFrame, permutations: int, threshold: float, k: int) -> Iterator[Block]:
    """Blocks of items, one partition of items at a time on the driver. Items without words are in none."""
    small_batches(items.sparkSession)

    def shingled(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = Shingles(part.column("text"), k)
                sets = [np.unique(s.hash[a:b]) for a, b in zip(s.off[:-1].tolist(), s.off[1:].tolist(), strict=True)]
                # a short item's only shingle is that of its words; documents are asked for their runs of as many
                for size in range(1, k):
                    hashes, first = window_hash(s.words, size)
                    whole = s.words.counts[s.words.doc[first]] == size
                    for d, h in zip(s.words.doc[first[whole]].tolist(), hashes[whole], strict=True):
                        sets[d] = np.array([h], dtype=U)
                flat = np.concatenate([np.zeros(0, U), *sets])
                full = np.flatnonzero([len(x) > 0 for x in sets])
                least = np.zeros((len(sets), permutations), dtype=U)
                if len(full):
                    start = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]]).astype(np.int64)
                    for h, a in enumerate(seeds(permutations, 2)):
                        least[full, h] = np.minimum.reduceat(flat * a, start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id"), pa.array(s.words.counts), pa.array(np.diff(s.off)), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() for x in least], pa.binary())],
                    ["item_id", "words", "n", "shingles", "signature"],
                )

    rows, size = [], 0
    made = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(shingled, "item_id long, words long, n long, shingles binary, signature binary").where("n > 0 and item_id is not null")
    for r in made.toLocalIterator():
        if rows and (size + r.n > BLOCK_SHINGLES or len(rows) >= BLOCK_ITEMS):
            yield _make_block(rows, threshold, k)
            rows, size = [], 0
        rows.append((r.item_id, r.words, r.n, bytes(r.shingles), bytes(r.signature)))
        size += r.n
    if rows:
        yield _make_block(rows, threshold, k)


def _hits(keys: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, own: np.ndarray, n_items: int) -> list[np.ndarray]:
    """Distinct numbers of (text, item) where a wanted value, of text ``own``, is a key."""
    values, members = keys
    left = np.searchsorted(values, wanted)
    hit = np.flatnonzero(values[np.minimum(left, len(values) - 1)] == wanted)
    if not len(hit):
        return []
    n = np.searchsorted(values, wanted[hit], "right") - left[hit]
    at = np.repeat(left[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return [np.unique(np.repeat(own[hit], n) * n_items + members[at])]


def _candidates(s: Shingles, block: Block, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts and items that share a minimum in one of the windows, or a shingle that is a key."""
    none = np.zeros(0, np.int64)
    counts = np.diff(s.off)
    if not len(s.hash):
        return none, none
    found = []
    for size, keys in block.short.items():
        hashes, first = window_hash(s.words, size)
        if len(hashes):
            found += _hits(keys, hashes, s.words.doc[first], len(block.ids))
    if len(block.exact[0]):
        found += _hits(block.exact, s.hash, np.repeat(np.arange(len(counts)), counts), len(block.ids))
    if block.levels:
        found += _windowed(s, block, permutations, counts)
    if not found:
        return none, none
    pairs = np.unique(np.concatenate(found))
    return pairs // len(block.ids), pairs % len(block.ids)


def _windowed(s: Shingles, block: Block, permutations: int, counts: np.ndarray) -> list[np.ndarray]:
    """Numbers of (text, item) that share a minimum in one of the windows."""
    found = []
    least = min(block.levels)
    n_blocks = -(-counts // least)
    owner = np.repeat(np.arange(len(counts)), n_blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    start = s.off[:-1][owner] + nth * least
    plans = {}
    for u in block.levels:
        lead = np.flatnonzero(nth % (u // least) == 0)
        own = owner[lead]
        plans[u] = (lead, own, own[:-1] == own[1:])
    for h, a in enumerate(seeds(permutations, 2)):
        small = np.minimum.reduceat(s.hash * a, start)
        for u, keys in block.levels.items():
            lead, own, joined = plans[u]
            low = np.minimum.reduceat(small, lead) if u > least else small
            window = low.copy()
            np.minimum(low[:-1], low[1:], out=window[:-1], where=joined)
            found += _hits(keys[h], window, own, len(block.ids))
    return found


def _matches(texts: pa.Array, block: Block, permutations: int, threshold: float, k: int) -> list[tuple[int, int, int, int]]:
    """(text, item, item's shingles, shared shingles) for every item contained in a text of the batch."""
    s = Shingles(texts, k)
    short = {i for _, members in block.short.values() for i in members.tolist()}
    out, have, last = [], None, -1
    for d, i in zip(*(x.tolist() for x in _candidates(s, block, permutations)), strict=True):
        if d != last:
            have, last = np.unique(s.hash[s.off[d] : s.off[d + 1]]), d
        item = block.sets[i]
        if i in short:  # that its run of words is there is what made it a candidate
            out.append((d, i, 1, 1))
            continue
        at = np.minimum(np.searchsorted(have, item), len(have) - 1)
        shared = int((have[at] == item).sum())
        if shared >= threshold * len(item):
            out.append((d, i, len(item), shared))
    return out


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, permutations: int = PERMUTATIONS, k: int = WORD_K) -> DataFrame:
    """Pairs of documents (doc_id, text) and items (item_id, text) whose containment is at least ``threshold``.

    Containment is the share of an item's distinct k-word shingles (lower case, punctuation dropped) that
    are in the document. An item of fewer than k words has one shingle, of all its words, which is in a document that has these words in a row; a document
    of fewer than k words has no longer items. Null, empty and wordless texts match nothing, as do items without an id. Repeated rows are answered each. Other columns are ignored.
    An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out, waiting = None, None
    for block in _blocks(items, permutations, threshold, k):
        if waiting is not None:  # with several blocks, each result is written before the next block is made
            done = stored(waiting, "decontaminate")
            held.destroy()
            out = done if out is None else out.unionAll(done)
        held = spark.sparkContext.broadcast(block)

        def search(batches, held=held):
            block = held.value
            for batch in batches:
                for part in slices(batch, "text"):
                    ids, rows = part.column("doc_id").to_pylist(), _matches(part.column("text"), block, permutations, threshold, k)
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": ids[d], "item_id": int(block.ids[i]), "item_shingles": n, "shared_shingles": c, "containment": c / n} for d, i, n, c in rows],
                        schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int64()), ("shared_shingles", pa.int64()), ("containment", pa.float64())]),
                    )

        waiting = plain.mapInArrow(search, PAIRS)
    if waiting is None:
        return spark.createDataFrame([], PAIRS)
    return waiting if out is None else out.unionAll(waiting)


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, permutations: int = PERMUTATIONS, k: int = WORD_K) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item. Rows with null texts or ids stay. With several blocks of items, what one leaves is written before the next is made."""
    held = None
    for block in _blocks(items, permutations, threshold, k):
        if held is not None:
            docs = stored(docs, "decontaminate")
            held.destroy()
        held = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches, held=held):
            for batch in batches:
                for part in slices(batch, "text"):
                    good = np.ones(len(part), dtype=bool)
                    good[[d for d, *_ in _matches(part.column("text"), held.value, permutations, threshold, k)]] = False
                    yield part.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
