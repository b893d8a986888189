"""How sources of a language differ in their terms: divergence between sources, and the terms that a source favours.

Sorted streams throughout. A task sorts its documents' terms by (lang, term, source, document) and reduces runs to document frequencies and
counts; Spark deals these partial runs by (lang, term) and sorts them by source, and one scan over the runs gives the terms to
keep. After each source's rates are known, a second scan over the same runs adds up partial sums for pairs of sources that have a term in
common, and terms go to the top of their source. A pair's other terms, which only one of the two has, or neither, need no run: they follow
from how many terms of a source have a rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small_batches, stored
from .textbatch import slices, utf8

#: Documents of a language that a term must be in.
LEAST_DOCS = 3
#: Ranks of a source's terms.
TOP_TERMS = 200
#: Rates are in parts of this.
UNIT = 1_000_000_000
#: Bytes of text and rows whose terms are sorted at once, and rows of partial runs that a task holds before they are merged or emitted.
SORT_BYTES, SORT_ROWS, HELD_ROWS, EMIT_ROWS = 1 << 22, 10_000, 1 << 19, 1 << 18

#: A term's bytes: ASCII letters, in lower case, and all bytes of other characters. Any other byte is a blank.
_TERM = np.full(256, 32, dtype=np.uint8)
_TERM[128:] = np.arange(128, 256)
for _a in range(26):
    _TERM[[65 + _a, 97 + _a]] = 97 + _a
_KEYS = ["lang", "term", "source"]
_RUN = pa.schema([(k, pa.string()) for k in _KEYS] + [("docs", pa.int64()), ("count", pa.int64())])


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)


def _document_runs(batch: pa.RecordBatch) -> pa.Table:
    """The terms of some documents (text, lang, source) as runs."""
    buf, offs = utf8(batch.column("text"))
    text = pa.LargeStringArray.from_buffers(len(batch), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(_TERM[buf]))
    parts = pc.ascii_split_whitespace(text)
    terms, doc = parts.flatten().cast(pa.string()), pc.list_parent_indices(parts).to_numpy()
    there = pc.greater(pc.binary_length(terms), 0)
    terms, doc = terms.filter(there), doc[there.to_numpy(zero_copy_only=False)]
    term, term_names = _codes(terms)
    (lang, lang_names), (source, source_names) = _codes(batch.column("lang")), _codes(batch.column("source"))
    n_docs, n_terms, n_sources = len(batch), max(len(term_names), 1), len(source_names)
    # at most SORT_ROWS rows and SORT_BYTES bytes (a longer text is alone), so this fits in 63 bits
    key = np.sort(((lang[doc] * n_terms + term) * n_sources + source[doc]) * n_docs + doc)
    of_doc = _starts(key)
    runs = key[of_doc] // n_docs
    first = _starts(runs)
    count = np.diff(np.append(of_doc[first], len(key)))
    runs = runs[first]
    return pa.table(
        [lang_names.take(pa.array(runs // n_sources // n_terms)), term_names.take(pa.array(runs // n_sources % n_terms)), source_names.take(pa.array(runs % n_sources)), pa.array(np.diff(np.append(first, len(of_doc)))), pa.array(count)],
        schema=_RUN,
    )


def _merged(tables: list[pa.Table]) -> pa.Table:
    """Runs of the same (lang, term, source) as one."""
    all_ = pa.concat_tables(tables)
    codes, names = zip(*(_codes(all_.column(k)) for k in _KEYS), strict=True)
    if np.prod([float(max(len(n), 1)) for n in names]) >= 2.0**63:
        raise ValueError("too many different keys in a task")
    key = codes[0]
    for c, n in zip(codes[1:], names[1:], strict=True):
        key = key * max(len(n), 1) + c
    order = np.argsort(key, kind="stable")
    first = _starts(key[order])
    at = order[first]
    sums = [np.add.reduceat(all_.column(k).to_numpy()[order], first) if len(first) else np.zeros(0, np.int64) for k in ("docs", "count")]
    return pa.table([*(n.take(pa.array(c[at])) for c, n in zip(codes, names, strict=True)), *(pa.array(s) for s in sums)], schema=_RUN)


def _partial_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for part in slices(batch, "text", SORT_BYTES):
            for at in range(0, len(part), SORT_ROWS):
                held.append(_document_runs(part.slice(at, SORT_ROWS)))
                rows += len(held[-1])
            if rows >= HELD_ROWS:
                held = [_merged(held)]
                rows = len(held[0])
                if rows >= EMIT_ROWS:
                    yield from held[0].to_batches(max_chunksize=1 << 16)
                    held, rows = [], 0
    if held:
        yield from _merged(held).to_batches(max_chunksize=1 << 16)


def _change(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return out


def _kept_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From partial runs in order: the runs of terms in enough documents. Only a term's own runs are held, one a source."""

    def emit(t: pa.Table) -> pa.RecordBatch:
        first = np.flatnonzero(_change(t.column("lang").combine_chunks(), t.column("term").combine_chunks()))
        docs, count = t.column("docs").to_numpy(), t.column("count").to_numpy()
        size = np.diff(np.append(first, len(t)))
        keep = np.repeat(np.add.reduceat(docs, first) >= LEAST_DOCS, size)
        starts = np.zeros(len(t), bool)
        starts[first] = True
        out = t.select([*_KEYS, "count"]).append_column("lang_count", pa.array(np.repeat(np.add.reduceat(count, first), size))).append_column("first", pa.array(starts))
        return out.filter(pa.array(keep)).combine_chunks()

    held = _RUN.empty_table()
    for batch in batches:
        t = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(_RUN)]).combine_chunks()
        if not len(t):
            continue
        first = np.flatnonzero(_change(*(t.column(k).combine_chunks() for k in _KEYS)))
        sums = [pa.array(np.add.reduceat(t.column(k).to_numpy(), first)) for k in ("docs", "count")]
        t = pa.table([*(t.column(k).take(pa.array(first)) for k in _KEYS), *sums], schema=_RUN)
        last = int(np.flatnonzero(_change(t.column("lang").combine_chunks(), t.column("term").combine_chunks()))[-1])
        if last:
            yield from emit(t.slice(0, last)).to_batches()
        held = t.slice(last)
    if len(held):
        yield from emit(held).to_batches()


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); rates are up to 10^9 + 1, so the square fits in 63 bits."""
    return (p - q) ** 2 // q


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, term, source, p, none) in order: lang, source, item, value.

    ``value`` is a partial sum over terms that both have: what the pair adds there to the sums made of each source's own rates. It is added up
    within a batch before a row is made, so rows are as many as pairs, not pairs of runs.
    """
    held = None
    columns = ["lang", "term", "source", "p", "none"]

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        run = np.cumsum(_change(t.column("lang").combine_chunks(), t.column("term").combine_chunks()))
        lang, langs = _codes(t.column("lang"))
        source, sources = _codes(t.column("source"))
        p, none = t.column("p").to_numpy(), t.column("none").to_numpy()
        keys, values = [], []
        for d in range(1, int(np.bincount(run).max())):
            a = np.flatnonzero(run[d:] == run[:-d])
            if not len(a):
                break
            b = a + d
            for x, y in ((a, b), (b, a)):
                value = _differ(p[x], p[y]) - _differ(p[x], none[y]) - _differ(none[x], p[y]) + _differ(none[x], none[y])
                key = (lang[x] * len(sources) + source[x]) * len(sources) + source[y]
                order = np.argsort(key, kind="stable")
                first = _starts(key[order])
                keys.append(key[order][first])
                values.append(np.add.reduceat(value[order], first))
        if keys:
            key, value = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(key, kind="stable")
            first = _starts(key[order])
            key, value = key[order][first], np.add.reduceat(value[order], first)
            n = len(sources)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(key // n // n)), sources.take(pa.array(key // n % n)), sources.take(pa.array(key % n)), pa.array(value)], ["lang", "source", "item", "value"])

    for batch in batches:
        new = pa.Table.from_batches([batch]).select(columns)
        t = (pa.concat_tables([held, new]) if held is not None else new).combine_chunks()
        if not len(t):
            continue
        last = int(np.flatnonzero(_change(t.column("lang").combine_chunks(), t.column("term").combine_chunks()))[-1])
        if last:
            yield from emit(t.slice(0, last).combine_chunks())
        held = t.slice(last)
    if held is not None and len(held):
        yield from emit(held.combine_chunks())


def _rate(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)); 0 where there are no terms."""
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + CAST({UNIT} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(19, 0)) div CAST({total} + {terms} AS DECIMAL(20, 0)) ELSE 0L END")


def _far(p: str, q: str) -> Column:
    return F.expr(f"CASE WHEN {q} > 0 THEN ({p} - {q}) * ({p} - {q}) div {q} ELSE 0L END")


def kept_terms(docs: DataFrame) -> DataFrame:
    """lang, term, source, count, lang_count, first: where and how often each term that enough documents of its language have occurs; ``first`` is on one row of a term."""
    small_batches(docs.sparkSession)
    runs = _named(docs).mapInArrow(_partial_runs, "lang string, term string, source string, docs long, count long")
    return runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_kept_runs, "lang string, term string, source string, count long, lang_count long, first boolean")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair`` has, for every source of a language, each other one, by divergence; part ``term`` the terms that the source uses more than its
    language does, the first ``TOP_TERMS``. Null text, lang and source count as empty. Every row is a document, repeated ones too; a
    language without kept terms has pairs of value 0. An empty table gives no rows; other columns are ignored.
    """
    kept = stored(kept_terms(docs), "terms")
    vocabulary = kept.where("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("terms"))
    groups = stored(
        _named(docs).select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "terms", "v", "lang_n")))
        .withColumn("none", _rate("0", "n", "v")),
        "groups",
    )
    rates = stored(
        kept.join(groups, ["lang", "source"]).select("lang", "term", "source", "none", _rate("count", "n", "v").alias("p"), _rate("lang_count", "lang_n", "v").alias("q")), "rates"
    )
    terms = rates.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far("p", "q").alias("value"))
    return _ranked(terms).where(f"rank <= {TOP_TERMS}").unionByName(_ranked(_pairs(rates, groups)))


def _pairs(rates: DataFrame, groups: DataFrame) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"), F.col("terms").alias("item_terms"))
    number = lambda c: F.col(c).cast("decimal(38,0)")
    neither = groups.join(other, "lang").where("source != item").select("lang", "source", "item", ((F.col("v") - F.col("terms") - F.col("item_terms")).cast("decimal(19,0)") * _far("none", "item_none").cast("decimal(19,0)")).alias("value"))
    alike = rates.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("n"))
    own = alike.join(other, "lang").where("source != item")
    each = own.select(
        "lang",
        F.explode(
            F.array(
                F.struct("source", "item", (F.col("n").cast("decimal(19,0)") * _far("p", "item_none").cast("decimal(19,0)")).alias("value")),
                F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("n").cast("decimal(19,0)") * _far("item_none", "p").cast("decimal(19,0)")).alias("value")),
            )
        ).alias("x"),
    ).select("lang", "x.source", "x.item", "x.value")
    both = rates.select("lang", "term", "source", "p", "none").repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_pair_sums, "lang string, source string, item string, value long")
    every = neither.unionByName(each).unionByName(both.withColumn("value", number("value")))
    return every.groupBy("lang", "source", "item").agg(F.sum(number("value")).cast("long").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
