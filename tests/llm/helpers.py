"""Small tables with every awkward row: nulls in each column, empty and long texts, ties, repeated rows and ids, columns whose names operators use inside."""

import random
import re

EXTRA = ["row", "digest", "lookup", "found", "known", "chunk", "rank", "task", "segment", "key", "n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def table(spark, rows, partitions=3):
    """rows of (doc_id, text) or (doc_id, text, lang)"""
    data = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1]) if r[1] is not None else None, *("x" for _ in EXTRA)) for r in rows]
    df = spark.createDataFrame(data, SCHEMA)
    return df.repartition(partitions) if rows else df


def empty(spark):
    return table(spark, [])


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def prose(rng, n, vocabulary=None):
    vocabulary = vocabulary or ["".join(rng.choices("abcdefghijklmnopé", k=rng.randint(2, 8))) for _ in range(300)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def odd_rows(rng):
    long = prose(rng, 30_000)
    return [(1, None), (None, "no id at all in this row here"), (2, ""), (3, " \n\t "), (4, "one two"), (5, long), (6, long), (6, long), (7, "#" * 5000), (None, None), (8, "Ünïcode ẞtraße 漢字 😀 " * 30), (9, "a" * 3000)]


def rng(seed=0):
    return random.Random(seed)
