"""How filters of a corpus interact: what each removes in every order, what only it removes, and its Shapley share.

Each text is looked at once, for the set of filters that it fails. Counts by part and set (at most 2^5 cells a part) hold all that any
order can show. Orders are visited by swapping neighbours, so that from one to the next only two steps change; each is a sum of cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

LETTERS = "ABCDE"
#: Parts whose rows are made at once.
PARTS_AT_ONCE = 64


def failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides. Words are runs of anything but blanks."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def orders(n: int) -> Iterator[tuple[list[int], int]]:
    """All orders of n things, each by one swap of neighbours from the last (plain changes): the order, and the first place swapped (-1 at the start)."""
    order, way = list(range(n)), [-1] * n
    yield order, -1
    while True:
        movable = [x for x in range(n) if 0 <= order.index(x) + way[x] < n and order[order.index(x) + way[x]] < x]
        if not movable:
            return
        x = max(movable)
        at = order.index(x)
        to = at + way[x]
        order[at], order[to] = order[to], order[at]
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield order, min(at, to)


def walk(cells: np.ndarray, n: int = len(LETTERS)) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """For every order: it, the sums kept after each step, and removed at each step.

    ``cells`` (parts, 2^n, measures) are counts by the set of failed filters. Only the two steps of a swap are computed anew.
    """
    sets = np.arange(1 << n)
    removed, kept = np.zeros((len(cells), n, cells.shape[2]), np.int64), np.zeros((len(cells), n + 1, cells.shape[2]), np.int64)
    kept[:, 0] = cells.sum(axis=1)

    def step(order: list[int], at: int) -> None:
        before = sum(1 << f for f in order[:at])
        removed[:, at] = cells[:, (sets & before == 0) & (sets >> order[at] & 1 == 1)].sum(axis=1)
        kept[:, at + 1] = kept[:, at] - removed[:, at]

    for order, swapped in orders(n):
        for at in range(n) if swapped < 0 else (swapped, swapped + 1):
            step(order, at)
        yield order, kept[:, 1:], removed


def _report(parts: list[str], cells: np.ndarray) -> pa.RecordBatch:
    n, sets = len(LETTERS), np.arange(1 << len(LETTERS))
    fails = np.stack([cells[:, sets >> f & 1 == 1, 0].sum(axis=1) for f in range(n)], axis=1)
    only = cells[:, 1 << np.arange(n), 0]
    shapley = np.zeros((len(parts), n), np.int64)
    names, rows = [], []
    for order, kept, removed in walk(cells):
        shapley[:, order] += removed[:, :, 0]
        names.append(("".join(LETTERS[f] for f in order), list(order)))
        rows.append(np.stack([kept[:, :, 0], removed[:, :, 0], fails[:, order] - removed[:, :, 0], only[:, order], removed[:, :, 1], removed[:, :, 2]], axis=2))
    table = np.stack(rows, axis=1)  # part, order, step, figure
    share = np.stack([shapley[:, order] for _, order in names], axis=1)
    n_orders = len(names)
    columns = [
        pa.array(np.repeat(np.array(parts, dtype=object), n_orders * n), pa.string()),
        pa.array(np.tile(np.repeat(np.array([x for x, _ in names], dtype=object), n), len(parts)), pa.string()),
        pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(parts) * n_orders)),
        *(pa.array(np.ascontiguousarray(table[..., k]).reshape(-1)) for k in range(table.shape[3])),
        pa.array(share.reshape(-1)),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in REPORT.split(", ")])


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (a set of filters as bits, A the lowest), n, good, toxic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(text).values())), F.lit(0))
    facts = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), bits.alias("failed"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "facts"
    )
    # written, so that the join below has no aggregate on either side and Spark can split a text with very many copies
    first = stored(facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "first")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 OR toxic = 1")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    return (
        facts.join(first, "digest", "left")
        .select("doc_id", "part", (F.col("failed") + copy).alias("failed"))
        .join(known, "doc_id", "left")
        .groupBy("part", "failed")
        .agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source), order of the five filters and step, zeros included.

    Filters: A under 200 words; B under half of the words are distinct; C more than 2 % of the characters are A to Z; D any of ``#$%&*|``;
    E the text of a row with a smaller doc_id. ``docs`` has doc_id, text, source; ``labels`` doc_id, quality, toxic. A null text is empty
    (it fails A only, or E too), a null source the part ''. A row without an id is never a copy and has no label. Equal rows count
    each, and none is a copy of one with its own id. A document has a label if any of its label rows has. Texts are identical if their SHA-256 is. An empty
    table gives no rows; other columns are ignored.
    """
    by_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))  # at most 32 a part

    def tell(batches):
        for batch in batches:
            for at in range(0, len(batch), PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE).to_pylist()
                grid = np.zeros((len(some), 1 << len(LETTERS), 3), np.int64)
                for i, row in enumerate(some):
                    for c in row["cells"]:
                        grid[i, c["failed"]] = c["n"], c["good"], c["toxic"]
                yield _report([row["part"] for row in some], grid)

    return by_part.mapInArrow(tell, REPORT)
