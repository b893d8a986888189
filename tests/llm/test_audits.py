import itertools
import re
from collections import Counter, defaultdict

import numpy as np
from voxlake.llm import divergence, filter_audit

from . import helpers


def test_plain_changes_visit_every_order_once_by_one_swap():
    for n in range(1, 6):
        seen, before = [], None
        for order, at in filter_audit.orders(n):
            if before is not None:
                swapped = before[:]
                swapped[at], swapped[at + 1] = swapped[at + 1], swapped[at]
                assert swapped == order
            before = order[:]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def table(spark, rows):
    extra = ["failed", "digest", "part", "first", "n", "good", "rank", "value", "item", "p", "term", "count"]
    df = spark.createDataFrame([(*r, *("x" for _ in extra)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in extra))
    return df.repartition(5) if rows else df


def audit_rows(rng):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        n = rng.choice([5, 150, 199, 200, 201, 450])
        pool = rng.choice([words, words[:60], words[:101]])
        text = " ".join(rng.choice(pool) for _ in range(n)) + rng.choice(["", "", " #", " ÄB CDE" * 30])
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "", None])))
    rows += [(200 + i, rows[rng.randrange(150)][1], "en", rng.choice("abc")) for i in range(60)]
    rows += [(None, rows[0][1], "en", "a"), (0, rows[0][1], "en", "a"), (0, rows[0][1], None, "z"), (300, None, "en", None), (301, "", "en", "a"), (302, "\n\t ", None, None), (303, "X" * 70_000, "en", "long")]
    return rows


def plain_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    ids = defaultdict(list)
    for d, text, *_ in rows:
        if d is not None:
            ids[text or ""].append(d)
    parts = defaultdict(list)
    for d, text, _, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and any(x < d for x in ids[text]),
        }
        parts[source or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part, docs in parts.items():
        steps, share = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = docs, []
            for k, f in enumerate(order, 1):
                hit = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                share[f] += len(hit)
                steps.append((part, order, k, len(left), len(hit), sum(f in x[0] for x in gone), sum(x[0] == {f} for x in docs), sum(x[1] for x in hit), sum(x[2] for x in hit)))
                gone = gone + hit
        out += [(*s, share[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_filter_audit_equals_brute_force(spark):
    rows = audit_rows(helpers.rng(5))
    labels = [(i, i % 3 % 2, int(i % 7 == 0)) for i in range(0, 250, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    df = filter_audit.report(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, df.collect())) == plain_audit(rows, labels)


def test_filter_audit_of_many_parts(spark):
    rows = [(i, "A$" if i % 2 else "b", "en", f"s{i:03}") for i in range(150)]
    df = filter_audit.report(table(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, df.collect())) == plain_audit(rows, [])


def test_the_walk_equals_a_sum_over_cells():
    cells = np.random.default_rng(2).integers(0, 50, (3, 32, 2))
    for order, kept, removed in filter_audit.walk(cells):
        for k in range(5):
            seen = [m for m in range(32) if not any(m >> f & 1 for f in order[: k + 1])]
            assert (kept[:, k] == cells[:, seen].sum(axis=1)).all()
        assert (removed.sum(axis=1) + kept[:, -1] == cells.sum(axis=1)).all()


def plain_divergence(rows, top=200):
    unit = 10**9
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        terms = [t for t in df if df[t] >= 3]
        counts = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                counts[d[1]].update(t for t in d[2] if df[t] >= 3)
        whole, v = sum(counts.values(), Counter()), len(terms)
        rate = lambda c: {t: 1 + unit * (c[t] + 1) // (sum(c.values()) + v) for t in terms}
        p, q = {s: rate(c) for s, c in counts.items()}, rate(whole)
        far = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in terms), o) for o in counts if o != s]
            favoured = [(far(p[s][t], q[t]), t) for t in terms if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", favoured, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def divergence_rows(rng):
    words = ["".join(rng.choices("abcdéñ漢ABC", k=rng.randint(1, 4))) for _ in range(120)]
    rows = [(i, rng.choice([" ", "\n", "9", "-"]).join(rng.choice(words[: rng.choice([20, 120])]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]), rng.choice("abcdef")) for i in range(200)]
    return rows + [(None, None, None, None), (1, "", "en", "empty"), (2, "123 __", "en", None), (3, "only here", "fr", "a"), (4, None, "fr", "b"), (5, "x " * 60_000, "en", "long"), (6, "x " * 9, "en", "a"), (6, "x " * 9, "en", "a"), (7, "ẞ ß\u0085x", "de", "a")]


def test_divergence_equals_brute_force(spark, monkeypatch):
    rows = divergence_rows(helpers.rng(8))
    assert sorted(map(tuple, divergence.audit(table(spark, rows)).collect())) == plain_divergence(rows)


def test_divergence_keeps_the_first_terms_only(spark):
    rows = [(i, " ".join(chr(97 + a) + chr(97 + b) + chr(97 + i % 4) for a in range(20) for b in range(20)), "en", "abcd"[i % 4]) for i in range(24)]
    got = sorted(map(tuple, divergence.audit(table(spark, rows)).collect()))
    assert got == plain_divergence(rows) and sum(r[2] == "term" and r[1] == "a" for r in got) == 200


def test_divergence_in_small_runs(monkeypatch):
    """What a task emits in many small parts adds up to the same, and a scan over one row a batch sees the same runs."""
    import pyarrow as pa

    rng = helpers.rng(9)
    rows = [(r[1] or "", r[2] or "", r[3] or "") for r in divergence_rows(rng)]
    batches = lambda n: (pa.RecordBatch.from_pylist([dict(zip(("text", "lang", "source"), r, strict=True)) for r in rows[i : i + n]]) for i in range(0, len(rows), n))
    whole = pa.Table.from_batches(divergence._partial_runs(batches(1000)))
    monkeypatch.setattr(divergence, "HELD_ROWS", 50)
    monkeypatch.setattr(divergence, "EMIT_ROWS", 40)
    monkeypatch.setattr(divergence, "SORT_ROWS", 2)
    parts = pa.Table.from_batches(divergence._partial_runs(batches(3)))
    assert len(parts) > len(whole)
    keys = [(k, "ascending") for k in ("lang", "term", "source")]
    a = pa.Table.from_batches(divergence._kept_runs(iter(whole.sort_by(keys).to_batches())))
    b = pa.Table.from_batches(divergence._kept_runs(iter(parts.sort_by(keys).to_batches(max_chunksize=1))))
    assert a.to_pylist() == b.to_pylist() and len(a)


def test_no_rows(spark):
    assert divergence.audit(table(spark, [])).collect() == []
    assert filter_audit.report(table(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
