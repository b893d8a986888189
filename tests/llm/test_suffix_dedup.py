import hashlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.helpers import empty, rng, table
from voxlake.llm import suffix_dedup as s


def gone(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        off = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                off[i : i + n] = True
        spans = sum(off[i] and not (i and off[i - 1]) for i in range(len(b)))
        out.append((len(b), int(off.sum()), int(spans), hashlib.sha256(bytes(c for c, o in zip(b, off, strict=True) if not o)).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = rng(seed)
    vocabulary = ["".join(r.choices("abcdeé漢", k=r.randint(1, 6))) for _ in range(60)]
    passage = " ".join(r.choices(vocabulary, k=15))
    out = []
    for i in range(90):
        t = " ".join(r.choices(vocabulary, k=r.randint(0, 40)))
        if i % 5 == 0:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        if i % 17 == 1:
            t = out[r.randrange(len(out))] or ""
        t += "a" * r.randint(0, 90) * (i % 13 == 0) + "ab" * r.randint(0, 60) * (i % 19 == 0)
        out.append(None if i % 23 == 0 else t)
    return [*out, "a" * 9000, "", "x", out[10], out[10]]


@pytest.mark.parametrize("length,shared,seed", [(20, 1000, 0), (20, 3, 1), (13, 2, 2)])
def test_equals_brute_force(spark, length, shared, seed):
    texts = corpus(seed)
    ids = [None if i % 11 == 0 else 7 if i % 29 == 0 else i for i in range(len(texts))]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.without_repeats(table(spark, list(zip(ids, texts, strict=True))), length, shared).collect())
    assert got == gone(texts, length)


def test_production_length(spark):
    r = rng(5)
    passage = "".join(r.choices("abcdefgh ", k=260))
    cases = [("".join(r.choices("abcdefgh ", k=300)) + passage[:k]) + "".join(r.choices("xyz", k=50)) for k in (199, 200, 201, 230, 260)] + [passage * 3]
    got = {x.doc_id: x for x in s.without_repeats(table(spark, list(enumerate(cases)))).collect()}
    assert sorted((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.values()) == gone(cases, 200)


def periodic(seed, length):
    """A text for each level whose block is exactly as long as that level's reach, and one of two blocks."""
    r = rng(seed)
    blocks = ["".join(r.choices("abcdefgh", k=length - k + 1)) for k in s.lengths(length)]
    return [b * (3 + 2 * length // len(b)) for b in blocks] + [b * 2 for b in blocks]


@pytest.mark.parametrize("length,shared", [(20, 1000), (20, 0), (200, 1000), (200, 0)])
def test_period_of_the_reach(spark, length, shared):
    texts = [t for seed in range(4) for t in periodic(seed, length)]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.without_repeats(table(spark, list(enumerate(texts))), length, shared).collect())
    assert got == gone(texts, length)


@pytest.mark.parametrize("length", [20, 200])
def test_runs_of_a_period_of_the_reach_are_tied(length):
    for seed in range(10):
        for k, text in zip(s.lengths(length), periodic(seed, length), strict=False):
            buf = np.frombuffer(text.encode(), dtype=np.uint8)
            rank, tied = s.runs(buf, np.array([0, len(buf)]), k, length)[3:]
            values, count = np.unique(rank, return_counts=True)
            assert all(t or count[values == x] > 1 for x, t in zip(rank, tied, strict=True))


def test_repeated_in_segments():
    r = rng(7)
    for _ in range(150):
        n, alphabet = r.choice([1, 2, 3, 5, 8, 13, 20]), r.choice([b"a", b"ab", b"abc"])
        parts = [bytes(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(r.randint(1, 5))]
        seen = Counter(p[i : i + n] for p in parts for i in range(len(p) - n + 1))
        want = [i <= len(p) - n and seen[p[i : i + n]] > 1 for p in parts for i in range(len(p))]
        offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        assert s.repeated(np.frombuffer(b"".join(parts), dtype=np.uint8), offs, n).tolist() == want


def test_empty(spark):
    assert s.without_repeats(empty(spark)).isEmpty()
