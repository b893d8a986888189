import pytest
from tests.conftest import rows
from tests.llm.helpers import empty, odd_rows, prose, rng, shingles, table, words
from voxlake.llm import decontaminate as d


@pytest.fixture(scope="module")
def cases(spark):
    r = rng(1)
    items = [(i, prose(r, n)) for i, n in enumerate([5, 8, 9, 17, 30, 33, 60, 64, 65, 200] * 3)] + [(90, None), (91, ""), (92, "one two"), (None, "an item that has no id"), (93, "a b c d e a b c d e a b c d e")]
    docs = odd_rows(r)
    for i, (_, text) in enumerate(items[:30]):
        before, after = prose(r, r.choice([0, 3, 400, 5000])), prose(r, r.choice([0, 3, 700]))
        w = text.split()
        changed = w[: len(w) // 2] + ["zzz"] + w[len(w) // 2 + 1 :]
        docs += [(100 + i, f"{before} {text.upper()}. {after}"), (200 + i, f"{before} {' '.join(changed)} {after}"), (300 + i, " ".join(w[: len(w) // 2]))]
    docs += [(400, "x a b c d e a b c d e"), (400, "x a b c d e a b c d e")]
    return docs, items


def brute(docs, items, t=0.8):
    out = []
    for i, text in items:
        s = shingles(text)
        if i is None or not s:
            continue
        size = len(words(text))
        for doc, body in docs:
            n = len(s & shingles(body, min(5, size)))
            if n >= t * len(s):
                out.append((doc, i, len(s), n))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted(((r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in df.collect()), key=repr)


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark, cases):
    docs, items = cases
    assert as_rows(d.contained_items(table(spark, docs), items_table(spark, items))) == brute(docs, items)


def test_blocks_of_items(spark, cases, monkeypatch):
    docs, items = cases
    monkeypatch.setattr(d, "BLOCK_SHINGLES", 150)
    assert as_rows(d.contained_items(table(spark, docs), items_table(spark, items))) == brute(docs, items)
    kept = d.without_contaminated(table(spark, docs), items_table(spark, items))
    bad = {doc for doc, *_ in brute(docs, items)}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in docs if i not in bad)
    assert kept.columns == table(spark, docs).columns


def test_empty_tables(spark, cases):
    docs, items = cases
    assert d.contained_items(empty(spark), items_table(spark, items)).isEmpty()
    assert d.contained_items(table(spark, docs), items_table(spark, [])).isEmpty()
    assert d.without_contaminated(table(spark, docs), items_table(spark, [])).count() == len(docs)


def test_short_and_repetitive_items(spark):
    """Items with few distinct shingles for their length, whose similarity with a window of their size is low."""
    r = rng(4)
    item = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(n))
    items = [item(5) for _ in range(250)] + [item(6) for _ in range(50)] + [" ".join([item(8)] * 25) for _ in range(15)] + [" ".join([item(1)] * 200) for _ in range(15)]
    items = list(enumerate(items))
    docs = [(1000 + i, f"{prose(r, 40)} {text} {prose(r, 600 if len(text) > 99 else 40)}") for i, text in items]
    assert as_rows(d.contained_items(table(spark, docs), items_table(spark, items))) == brute(docs, items)


def test_thousands_of_short_items_inside_long_documents(spark):
    """Items of one to eight words, each verbatim in a document of some hundred words: all are found, and nothing else."""
    r = rng(14)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrst", k=9))
    items = [(i, " ".join(word() for _ in range(1 + i % 8))) for i in range(4000)]
    docs = [(10_000 + i, f"{prose(r, r.randint(0, 200))} {text.title()}, {prose(r, r.randint(0, 200))}") for i, text in items]
    size = lambda text: max(1, len(text.split()) - 4)
    assert as_rows(d.contained_items(table(spark, docs), items_table(spark, items))) == sorted(((10_000 + i, i, size(t), size(t)) for i, t in items), key=repr)
    kept = d.without_contaminated(table(spark, [*docs, (1, prose(r, 500)), (2, "x")]), items_table(spark, items))
    assert sorted(x.doc_id for x in kept.collect()) == [1, 2]


def test_items_of_few_words_equal_brute_force(spark):
    r = rng(15)
    vocabulary = ["ab", "cd", "ef", "gh", "é1"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 7)))) for i in range(60)]
    docs = [(100 + i, r.choice([" ", "; "]).join(r.choices(vocabulary, k=r.randint(0, 12)))) for i in range(120)]
    assert as_rows(d.contained_items(table(spark, docs), items_table(spark, items))) == brute(docs, items)


def test_query_sql_on_short_items(spark, duck, tmp_path):
    from voxlake.llm import queries

    r = rng(16)
    vocabulary = ["ab", "cd", "ef", "gh", "é1"]
    spark.createDataFrame([(i, " ".join(r.choices(vocabulary, k=r.randint(0, 7)))) for i in range(40)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table(spark, [(100 + i, "-".join(r.choices(vocabulary, k=r.randint(0, 12)))) for i in range(60)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op2_decontamination"](spark, str(tmp_path)).toPandas()
    con = duck.cursor()
    con.execute("CREATE SCHEMA short_items; USE short_items")
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert rows(got) == rows(con.execute(queries.ORACLE_SQL["op2_decontamination"]).df()) and len(got) > 100
    con.execute("USE main; DROP SCHEMA short_items CASCADE")
