"""The registered queries, as the driver calls them, on a small folder against brute force."""

import zlib

import pytest
from pyspark.sql import functions as F
from tests.llm import test_pii, test_suffix_dedup, test_text_models
from tests.llm.helpers import prose, rng
from voxlake.llm import decontaminate, packing, queries, scratch


@pytest.fixture(scope="module")
def rows():
    r = rng(12)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(300)]
    passage = " ".join(r.choices(vocabulary, k=60))
    texts = [*test_pii.random_texts()[:150], *(prose(r, r.randint(0, 120), vocabulary) for _ in range(60)), None, "", "x"]
    texts += [prose(r, 30, vocabulary) + " " + passage + " " + prose(r, 10, vocabulary) for _ in range(6)] + ["a" * 700, "# " * 300, passage]
    return [(i, t, ["en", "de", "fr", None][i % 4]) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame([(*r, f"s{r[0] % 3}", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def run(spark, name, folder):
    return queries.QUERIES[name](spark, folder).collect()


def test_op1(spark, rows, folder):
    got = {r.doc_id: r.text for r in run(spark, "op1_pii", folder)}
    want = test_pii.Plain(queries.PII_KEY).replace([t for _, t, _ in rows])
    assert got == {i: w for (i, *_), w in zip(rows, want, strict=True)}


def test_op3(spark, rows, folder):
    got = run(spark, "op3_quality_rules", folder)
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: test_text_models.stats(t) for i, t, _ in rows}
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (not r.base_failed or r.kept is False)
    votes = {i: tuple(test_text_models.rule_votes(t)) for i, t, _ in rows}
    counts = {v: list(votes.values()).count(v) for v in votes.values()}
    p = test_text_models.plain_em(counts)
    assert {r.doc_id: r.kept for r in got if not r.base_failed and abs(p[votes[r.doc_id]] - 0.5) > 1e-6} == {r.doc_id: p[votes[r.doc_id]] >= 0.5 for r in got if not r.base_failed and abs(p[votes[r.doc_id]] - 0.5) > 1e-6}


def test_op5(spark, rows, folder):
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op5_suffix_array_dedup", folder))
    assert got == test_suffix_dedup.gone([t for _, t, _ in rows], 200)


def test_op7(spark, rows, folder):
    encode = packing.encoder(packing.Vocabulary.public())
    ids = {i: [*encode(t or ""), 1] for i, t, _ in rows}
    pieces, places = {}, {}
    for r in run(spark, "op7_packing", folder):
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in own))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in ids.items():
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(own)
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_op10_looks_at_no_held_out_label(spark, rows, folder, tmp_path):
    """Other labels of held-out documents, of sources and ids in order, change no prediction; other labels of the others do."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other")).write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.withColumn("lang", F.when(~held & F.col("lang").isNotNull(), F.lit("zz")).otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b, c = ({r.doc_id: (r.held_out, r.lang_pred, r.score) for r in run(spark, "op10_language_id", f)} for f in (folder, f"{tmp_path}/a", f"{tmp_path}/b"))
    assert a == b and {i for i, r in a.items() if r[0]} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {r[1] for r in c.values()} == {"zz", "und"} and {r[1] for r in a.values()} <= {"en", "de", "fr", "und"}


def test_op10_rows_without_an_id(spark, folder, tmp_path):
    """They get a prediction, teach nothing (their label is never predicted), and are neither held out nor not."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    nameless = docs.where("doc_id < 20").withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit("zz"))
    docs.unionByName(nameless).write.parquet(f"{tmp_path}/documents.parquet")
    got, known = run(spark, "op10_language_id", str(tmp_path)), {r.doc_id: r for r in run(spark, "op10_language_id", folder)}
    without = [r for r in got if r.doc_id is None]
    assert {r.doc_id: r for r in got if r.doc_id is not None} == known
    assert all(r.held_out is None for r in without)
    assert sorted((r.lang_pred, r.score) for r in without) == sorted((known[i].lang_pred, known[i].score) for i in range(20))


def test_scattered_items_are_found(spark):
    """Items in pieces of 5 to 9 words, 150 words apart: a permutation may hit any window, so what the README's bound doesn't cover is found as well."""
    r = rng(40)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    items, docs = [], []
    for i in range(60):
        w = r.choices(vocabulary, k=100)
        items.append((i, " ".join(w)))
        text, at = [], 0
        while at < len(w):
            n = r.randint(9, 14)
            text += w[max(0, at - 4) : at + n] + r.choices(vocabulary, k=150)
            at += n
        docs.append((i, " ".join(text)))
    got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(x.doc_id, x.item_id) for x in got.collect()}
    assert len(found) >= 0.98 * 60 and all(a == b for a, b in found)


def test_blocks_of_items_leave_the_same(spark, monkeypatch):
    r = rng(41)
    items = [(i, prose(r, 30)) for i in range(40)]
    docs = spark.createDataFrame([(i, prose(r, 80) + " " + (items[i % 40][1] if i % 3 == 0 else "")) for i in range(90)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = {x.doc_id for x in decontaminate.without_contaminated(docs, table).collect()}
    for name in [n for n in dir(decontaminate) if n.startswith("BLOCK_")]:
        monkeypatch.setattr(decontaminate, name, 100)
    assert {x.doc_id for x in decontaminate.without_contaminated(docs, table).collect()} == whole == {i for i in range(90) if i % 3}


def test_runs_side_by_side_clear_their_own(spark):
    import threading

    order, seen = [threading.Event(), threading.Event()], {}

    def first():
        with scratch.run():
            seen["a"] = scratch.stored(spark.range(3), "a")
            order[0].set()
            order[1].wait(60)
            seen["n"] = seen["a"].count()

    def second():
        order[0].wait(60)
        with scratch.run():
            scratch.stored(spark.range(5), "b")
            assert scratch.mark() == 1
            scratch.clear(spark)
            assert scratch.mark() == 0
        order[1].set()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen["n"] == 3
