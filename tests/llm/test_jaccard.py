from collections import defaultdict

import pytest
from tests.llm.helpers import empty, odd_rows, prose, rng, shingles, table
from voxlake.llm import jaccard as j


@pytest.fixture(scope="module")
def docs():
    r = rng(3)
    out = odd_rows(r)
    for g in range(12):
        base = prose(r, r.choice([30, 80, 300])).split()
        for k in range(r.choice([2, 5, 30])):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 5)}"
            out.append((1000 + 50 * g + k, " ".join(w) + r.choice(["", "!", " "])))
    out += [(9000, out[20][1]), (9000, out[20][1]), (None, out[21][1]), (9001, "one two."), (9002, "One, two")]
    return out


def brute(docs, t=0.8):
    sets = [shingles(x) for _, x in docs]
    near = defaultdict(set)
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t:
                near[a].add(b)
                near[b].add(a)
    group = {}
    for a in range(len(docs)):
        if a not in group:
            stack = [a]
            while stack:
                x = stack.pop()
                if x not in group:
                    group[x] = a
                    stack += near[x]
    least = defaultdict(list)
    for a, g in group.items():
        if docs[a][0] is not None:
            least[g].append(docs[a][0])
    return sorted([(docs[a][0], min(least[g], default=None), len(near[a])) for a, g in group.items()], key=repr), group


@pytest.mark.parametrize("texts,size", [(1024, 2_000_000), (7, 3000)])
def test_equals_brute_force(spark, docs, monkeypatch, texts, size):
    monkeypatch.setattr(j, "BLOCK_TEXTS", texts)
    monkeypatch.setattr(j, "BLOCK_SHINGLES", size)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in j.near_duplicates(table(spark, docs)).collect()), key=repr)
    assert got == brute(docs)[0]


def test_one_row_of_each_class_stays(spark, docs):
    kept = j.one_of_each(table(spark, docs))
    assert kept.columns == table(spark, docs).columns
    _, group = brute(docs)
    assert kept.count() == len(set(group.values()))
    wordless = [d for d in docs if not shingles(d[1])]
    ids = [r.doc_id for r in kept.collect()]
    assert all(i in ids for i, _ in wordless)
    least = {min((docs[a][0] for a in group if group[a] == g and docs[a][0] is not None), default=None) for g in set(group.values())}
    assert set(ids) == least


def test_empty(spark):
    assert j.near_duplicates(empty(spark)).isEmpty() and j.one_of_each(empty(spark)).isEmpty()


def test_prefix_length():
    assert [j.depth_for(0.8, r) for r in (0.5, 0.99, 0.99999)] == [8, 8, 5]


def test_components_of_a_long_chain(spark):
    from voxlake.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(500, 501), (501, 500), (7, 7), (900, 900)], "src long, dst long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {500: 500, 501: 500}


def test_measured_recall_at_the_threshold(spark):
    """Pairs of a similarity just over the threshold, one change in the middle of each: all are found."""
    r = rng(21)
    rows, pairs = [], 0
    for i in range(1500):
        w = prose(r, 49 + r.randint(0, 3)).split()
        changed = [*w[: len(w) // 2], f"x{i}", *w[len(w) // 2 + 1 :]]
        a, b = shingles(" ".join(w)), shingles(" ".join(changed))
        assert 0.8 <= len(a & b) / len(a | b) < 0.85
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(changed))]
        pairs += 1
    got = {x.doc_id: (x.class_id, x.n_links) for x in j.near_duplicates(table(spark, rows)).collect()}
    found = sum(got[2 * i] == got[2 * i + 1] == (2 * i, 1) for i in range(pairs))
    assert found >= 0.999 * pairs


@pytest.mark.parametrize("rounds", [60, 0])
def test_chance_neighbours_form_no_groups(spark, docs, monkeypatch, rounds):
    """With prefixes of a single byte nearly all texts share one with some other; candidate groups stay what they are, and so does the result."""
    monkeypatch.setattr(j, "LAST_ROUNDS", rounds)
    monkeypatch.setattr(j, "depth_for", lambda *_: 1)
    assert sorted(((x.doc_id, x.class_id, x.n_links) for x in j.near_duplicates(table(spark, docs)).collect()), key=repr) == brute(docs)[0]
    texts = [(i, t) for i, (_, t) in enumerate(docs) if len(shingles(t)) > 1]
    s = j.sketched(table(spark, texts)).where("digest is not null").selectExpr("doc_id as node", "labels")
    links = j.candidates(s, 0.8, 0.9).collect()
    alike = lambda a, b: len(a & b) / len(a | b)
    sets = {i: shingles(t) for i, t in texts}
    if rounds:
        assert links and all(alike(sets[x.src], sets[x.dst]) > 0.25 for x in links)
    else:
        assert any(alike(sets[x.src], sets[x.dst]) < 0.1 for x in links)


def test_prefixes_are_shortened_for_some_only(spark, docs, monkeypatch):
    """Texts that are represented early aren't looked up at shorter prefixes."""
    seen = []
    kept = j.stored
    monkeypatch.setattr(j, "stored", lambda df, name: (lambda out: (seen.append((name, out.count())), out)[1])(kept(df, name)))
    assert sorted(((x.doc_id, x.class_id, x.n_links) for x in j.near_duplicates(table(spark, docs)).collect()), key=repr) == brute(docs)[0]
    leaves = [n for name, n in seen if name == "leaves"]
    assert leaves[0] > leaves[1] > leaves[-1] and leaves[-1] < 10 and len(leaves) >= 4
