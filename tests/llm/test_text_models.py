import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA
from tests.llm.helpers import empty, odd_rows, prose, rng, table, words
from voxlake.llm import language_id as li
from voxlake.llm import lm_score, quality


def stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_statistics_equal_brute_force(spark):
    r = rng(4)
    rows = odd_rows(r) + [(i, prose(r, r.randint(0, 60), ["a", "b", "c#", "é\u00a0|", "d\n", "\n\n"])) for i in range(100, 160)]
    out = quality.scored(table(spark, rows)).collect()
    key = lambda t: sorted(t, key=repr)
    assert key((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in out) == key((i, *stats(t)) for i, t in rows)
    for x in out:
        assert x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words) and (not x.kept or not x.base_failed)
    assert quality.scored(empty(spark)).isEmpty()


def test_fit_finds_the_rules_accuracies():
    r = np.random.default_rng(1)
    good = r.random(20000) < 0.7
    v = np.zeros((20000, 8), dtype=int)
    for j in range(8):
        drop, keep = (0.4 + 0.05 * j, 0.1) if j % 2 else (0.3, 0.2)
        u = r.random(20000)
        v[:, j] = np.where(good, np.where(u < 0.005, -1, np.where(u < 0.8, 1, 0)), np.where(u < drop, -1, np.where(u < drop + keep, 1, 0)))
    codes, weight = np.unique(quality.pattern_code(v), return_counts=True)
    m = quality.fit(quality.pattern_votes(codes), weight.astype(float))
    p = m.posterior(v)
    assert abs(m.prior - 0.7) < 0.03 and ((p >= 0.5) == good).mean() > 0.97
    assert (m.accuracy() > 0.75).all()


def plain_em(patterns, rounds=1000):
    """The same model, one pattern and one rule at a time: patterns are {votes: documents}."""
    rules = range(len(next(iter(patterns))))
    p = {v: 0.1 if -1 in v else 0.9 if 1 in v else 0.5 for v in patterns}
    for _ in range(rounds):
        chance = {}
        for c in (0, 1):
            for j in rules:
                counts = {o: 1 + sum(n * (p[v] if c else 1 - p[v]) for v, n in patterns.items() if v[j] == o) for o in (-1, 0, 1)}
                chance[c, j] = {o: x / sum(counts.values()) for o, x in counts.items()}
        prior = (sum(n * p[v] for v, n in patterns.items()) + 1) / (sum(patterns.values()) + 2)
        before = p
        p = {}
        for v in patterns:
            bad, good = 1 - prior, prior
            for j in rules:
                bad, good = bad * chance[0, j][v[j]], good * chance[1, j][v[j]]
            p[v] = good / (good + bad)
        if max(abs(p[v] - before[v]) for v in p) < 1e-9:
            break
    if sum(chance[1, j][-1] for j in rules) > sum(chance[0, j][-1] for j in rules):
        p = {v: 1 - x for v, x in p.items()}
    return p


def rule_votes(text):
    """The rules' votes, from the text."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = lambda x: [c for c in x if re.match(r"[A-Za-z\x80-\U0010ffff]", c)]
    share = lambda a, b: None if not b else a / b
    chars = sum(map(len, w))
    values = [
        (share(len(re.findall(r"[#*$%&|<>]", text or "")), len(w)), 0.02, 0.1),
        (share(sum(not re.search(r"[0-9A-Za-z\x80-\U0010ffff]", x) for x in w), len(w)), 0.05, 0.2),
        (share(sum(a == b for a, b in zip(w, w[1:], strict=False)), len(w)), 0.02, 0.1),
        (share(len(lines) - len(set(lines)), len(lines)), 0.1, 0.4),
        (share(len(re.findall("[A-Z]", text or "")), len(letters(text or ""))), 0.1, 0.4),
        (share(sum(len(letters(x)) for x in w), chars), 0.8, 0.65),
        (share(sum(1 <= len(letters(x)) <= 3 for x in w), len(w)), 0.15, 0.05),
        (share(sum(x[-1] in ".,;:!?" for x in w), len(w)), 0.04, 0.01),
    ]
    out = []
    for x, keep, drop in values:
        x = float("nan") if x is None else x
        out.append((x <= keep) - (x >= drop) if keep < drop else (x >= keep) - (x <= drop))
    return tuple(int(x) for x in out)


def test_posterior_and_verdict_equal_plain_em(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**9 + i, t) for i, t in enumerate(["Aa bb# cc.\n" * 30, "| " * 50, "NO NO NO", None, "x, " * 9])]
    votes = {i: rule_votes(t) for i, t in rows}
    p = plain_em(Counter(votes.values()))
    out = quality.scored(table(spark, rows)).collect()
    assert len(out) == len(rows)
    for x in out:
        assert x.quality == pytest.approx(p[votes[x.doc_id]], abs=1e-5), (x.doc_id, votes[x.doc_id])
        assert x.kept == (not x.base_failed and x.quality >= 0.5)


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.scored(docs).where("not base_failed").select("doc_id", "kept").join(labels, "doc_id").toPandas()
    assert out["kept"][out["quality"] == 1].mean() > 0.99
    assert out["kept"][out["quality"] == 0].mean() < 0.1


def grams(text):
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    out = Counter()
    for w in low.split():
        p = f" {w} "
        out.update(g for n in (1, 2, 3) for i in range(len(p) - n + 1) if (g := p[i : i + n]).strip())
    return out


def test_ngrams_equal_brute_force():
    texts = ["", None, " ", "9 9", "a", "b a", "ÀÉ x漢字", "İstanbul ẞ", "don't stop"] + [prose(rng(i), 40) for i in range(10)]
    doc, gram, count, letters = li.ngram_counts(pa.array(texts))

    def text(g):
        parts = [(int(g) >> (21 * k)) & (2**21 - 1) for k in (2, 1, 0)]
        return "".join(" " if p == 1 else chr(p - 1) for p in parts if p)

    for i, t in enumerate(texts):
        assert {text(g): int(c) for g, c in zip(gram[doc == i], count[doc == i], strict=True)} == grams(t)
        assert letters[i] == sum(c.isalpha() for c in t or "")


def number(gram):
    """An n-gram as it is ordered: nothing, then a word's edge, then letters."""
    return [0 if ch == "\0" else 1 if ch == " " else ord(ch) + 1 for ch in gram.rjust(3, "\0")]


def out_of_place(text, profiles):
    rank = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], number(x[0])))]
    own = rank(grams(text))[:300]
    return own, {lang: sum(abs(i - p.index(g)) if g in p else 300 for i, g in enumerate(own)) for lang, p in profiles.items()}


def as_text(g):
    parts = [(int(g) >> (21 * k)) & (2**21 - 1) for k in (2, 1, 0)]
    return "".join(" " if p == 1 else chr(p - 1) for p in parts if p)


@pytest.mark.parametrize("block", [10_000, 1, 2])
def test_predictions_equal_brute_force(spark, monkeypatch, block):
    """Profiles are the ranked n-grams of the training texts; a prediction is the least out-of-place distance, of equals the first by name."""
    monkeypatch.setattr(li, "BLOCK_LANGUAGES", block)
    r = rng(12)
    sets = {lang: ["".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(80)] for lang, letters in {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop", "dd": "abcdefgh"}.items()}
    train = [(i, prose(r, 30, sets[lang]), lang) for i, lang in enumerate([*sets] * 6)]
    train += [(100, train[0][1], "ee"), (101, train[0][1], "ff")]  # two languages with one profile
    model = li.learn(table(spark, train))
    assert [len(p.languages) for p in model] == ([6] if block == 10_000 else [block] * (6 // block))
    profiles = {}
    for lang in sorted({x[2] for x in train}):
        total = sum((grams(t) for _, t, own in train if own == lang), Counter())
        profiles[lang] = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], number(x[0])))][:300]
    learned = {}
    for p in model:
        for g, a, b in zip(p.grams, p.off[:-1], p.off[1:], strict=True):
            for k in range(a, b):
                learned.setdefault(p.languages[p.lang[k]], {})[p.rank[k]] = as_text(g)
    assert learned == {lang: dict(enumerate(own)) for lang, own in profiles.items()}
    rows = [(i, prose(r, r.randint(1, 40), sets[r.choice([*sets])] + sets["bb"][:20])) for i in range(60)] + [(90, train[0][1]), (91, "漢字 ß"), (92, "")]
    got = {x.doc_id: (x.lang_pred, round(x.score, 9)) for x in li.identified(table(spark, rows), model).collect()}
    for i, t in rows:
        own, apart = out_of_place(t, profiles)
        best = min(sorted(apart), key=apart.get)
        assert got[i] == ((best, round(1 - apart[best] / (300 * len(own)), 9)) if own else ("und", 0.0)), (i, t)
    assert got[90][0] == "ee" and got[92] == ("und", 0.0)


def test_every_label_is_learned(spark, monkeypatch):
    monkeypatch.setattr(li, "BLOCK_LANGUAGES", 100)
    rows = [(i, f"{chr(0x4E00 + i) * 3} {chr(0x4E00 + i)}", f"l{i:03}") for i in range(450)]
    model = li.learn(table(spark, rows))
    assert [len(p.languages) for p in model] == [100, 100, 100, 100, 50]
    assert all(r.lang_pred == f"l{r.doc_id:03}" and r.score == 1.0 for r in li.identified(table(spark, rows), model).collect())


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    train, held = docs.where("doc_id % 3 <> 1"), docs.where("doc_id % 3 = 1")
    profiles = li.learn(train)
    got = li.identified(held, profiles).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_rows(spark):
    de, en = "der Hund und die Katze schlafen im Haus " * 5, "the dog and the cat sleep in that house " * 5
    model = li.learn(table(spark, [(1, de, "de"), (2, en, "en"), (3, None, "fr"), (4, "il", None), (None, en, "en")]))
    assert [p.languages for p in model] == [["de", "en"]]
    rows = [(i, t, "xx") for i, t in odd_rows(rng(1))] + [(70, de, None), (71, en, "de"), (72, "12345 %%", "de")]
    out = li.identified(table(spark, rows), model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert by[70][0] == "de" and by[71][0] == "en" and by[72] == by[1] == by[2] == by[3] == ("und", 0.0) and by[70][1] > 0.9
    kept = li.with_language(table(spark, rows), model)
    assert kept.columns == table(spark, rows).columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.lang_pred != "und"}
    nothing = li.learn(empty(spark))
    assert {r.lang_pred for r in li.identified(table(spark, rows), nothing).collect()} == {"und"}
    assert li.identified(empty(spark), model).isEmpty()


def backoff(rows, order, a=0.4):
    tokens = [words(t) for _, t in rows]
    count = lambda ws: Counter(tuple(w[i : i + n]) for w in ws for n in range(1, order + 1) for i in range(len(w) - n + 1))
    everything, total = count(tokens), sum(map(len, tokens))
    out = []
    for (doc, _), w in zip(rows, tokens, strict=True):
        own, rest, s = count([w]), max(total - len(w), 1), 0.0
        left = lambda g, own=own: everything[g] - own[g]
        for i in range(len(w)):
            most = min(i + 1, order)
            for n in range(most, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if left(g):
                    s += math.log(left(g) / (left(g[:-1]) if n > 1 else rest)) + (most - n) * math.log(a)
                    break
            else:
                s += most * math.log(a) - math.log(rest)
        out.append((doc, len(w), round(s, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order,chunk,bucket", [(2, 1 << 23, 2_000_000), (3, 4000, 500), (1, 3000, 50)])
def test_scores_equal_brute_force(spark, monkeypatch, order, chunk, bucket):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm_score, "BUCKET_GRAMS", bucket)
    r = rng(6)
    vocabulary = [prose(r, 1) for _ in range(40)]
    rows = [(1, None), (2, ""), (None, "one two"), (3, "!!"), (4, "one two one two"), (4, "one two one two")] + [(i, prose(r, r.randint(1, 60), vocabulary)) for i in range(10, 60)]
    got = sorted(((x.doc_id, x.n_words, round(x.log_score, 6) + 0.0) for x in lm_score.scored(table(spark, rows), order).collect()), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in backoff(rows, order)]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in backoff(rows, order)], abs=1e-5)
    assert lm_score.scored(empty(spark)).isEmpty()


def test_scores_of_a_shuffled_input(spark, monkeypatch):
    """Rows that come out of a shuffle may come in another order when they are made again: chunks are written once, so every step sees the same ones."""
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 2000)
    r = rng(8)
    vocabulary = [prose(r, 1) for _ in range(40)]
    rows = [(i, prose(r, r.randint(1, 60), vocabulary)) for i in range(80)]
    df = table(spark, rows, 7).withColumn("u", F.rand()).repartition(5, "u").drop("u")  # another order at each evaluation
    out = lm_score.scored(df)
    assert "Scan parquet" in out._jdf.queryExecution().executedPlan().toString() and "rand" not in out._jdf.queryExecution().toString()
    want = backoff(rows, lm_score.ORDER)
    for _ in range(2):
        got = sorted(((x.doc_id, x.n_words, round(x.log_score, 6) + 0.0) for x in out.collect()), key=repr)
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-5)


def test_numbers_are_packed_and_unpacked():
    r = np.random.default_rng(2)
    for values in (np.zeros(0), np.zeros(5000), np.ones(3), r.integers(0, 2**63, 4000), r.geometric(1e-9, 4000), r.integers(1, 3, 9000), np.array([2**64 - 1], dtype=np.uint64)):
        values = values.astype(np.uint64)
        assert (lm_score._numbers(lm_score._planes(values), len(values)) == values).all()
    assert len(lm_score._planes(np.ones(9000, dtype=np.uint64))) < 100


def test_rows_of_the_count_tables_are_bounded():
    """By the n-grams, however many ranges there are; ranges are equal parts and hold all hashes."""
    hashes = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 3000).astype(np.uint64))
    for buckets in (1, 24, 1000, 10**9):
        own, edges = lm_score._edges(hashes, buckets, 40)
        assert len(own) <= min(buckets, len(hashes)) and edges[0] == 0 and edges[-1] == len(hashes) and (np.diff(own) > 0).all()
        assert all(0 <= o < buckets for o in own) and (np.diff(edges) > 0).all()
    assert lm_score.hash_bits(10**9) == 54 and lm_score.hash_bits(10**14) == 64
