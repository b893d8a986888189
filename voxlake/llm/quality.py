"""Quality rules by weak supervision.

Rules look at statistics of a text and vote keep, vote drop, or abstain. Expectation-maximisation over the
counts of vote patterns estimates how accurate each rule is and how common good documents are; each pattern then
has a posterior probability of quality. Documents are kept by that probability instead of by passing every rule.

The fit sees only the pattern counts, of which there are at most 3 ** (number of rules): it doesn't grow with the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches, stored
from .textbatch import BLANK_WORD, U, Words, mix, range_hash, slices, table, utf8, window_hash

SYMBOL = table(b"#*$%&|<>", False)
UPPER = table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", False)
LETTER = table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", True)
WINDOW = 8
ALNUM = table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", True)
STOP = table(b".,;:!?", False)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bare", "n_short", "n_echoes", "n_ends"]


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of ``STATS`` for each text; words are runs of anything but ASCII white space. A null text counts as empty.

    n_repeat_words counts the words in 8-word windows that occur at least twice in the text. n_dup_lines counts lines
    with a word that equal an earlier line; n_lines counts lines with a word. Of words, n_bare have no letter or digit, n_short have one to
    three letters, n_echoes equal the word before, and n_ends end in a punctuation mark. Letters are ASCII letters and all that isn't ASCII.
    """
    buf, offs = utf8(texts)
    n = len(offs) - 1
    words = Words(buf, offs, BLANK_WORD)
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
    lead = (buf & 0xC0) != 0x80
    out = {"n_words": words.counts, "word_chars": per(lead & BLANK_WORD[buf]), "n_symbols": per(SYMBOL[buf]), "n_upper": per(UPPER[buf]), "n_letters": per(LETTER[buf] & lead)}
    # words
    within = lambda flags: (lambda c: c[words.end] - c[words.start])(np.concatenate([[0], np.cumsum(flags)]))
    count = lambda flags: np.bincount(words.doc[flags], minlength=n)[:n]
    letters = within(LETTER[buf] & lead)
    echo = np.zeros(len(words.hash), dtype=bool)
    echo[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    out |= {"n_bare": count(within(ALNUM[buf]) == 0), "n_short": count((letters > 0) & (letters <= 3)), "n_echoes": count(echo), "n_ends": count(STOP[buf[words.end - 1]])}
    # lines
    breaks = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    owner = np.searchsorted(offs, start, "right") - 1
    # a line break at a text's very end opens an empty last line, whose start is the next text's offset: it has no word
    end = np.sort(np.concatenate([breaks, offs[1:]]))
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, owner = start[has], end[has], np.minimum(owner[has], n - 1)
    key = mix(range_hash(words.sums, start, end) ^ mix(owner.astype(U)))
    _, first = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(owner, minlength=n)[:n]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[first], minlength=n)[:n]
    # windows
    hashes, at = window_hash(words, WINDOW)
    repeated = np.zeros(len(words.hash) + 1, dtype=np.int64)
    if len(hashes):
        key = mix(hashes ^ mix(words.doc[at].astype(U)))
        order = np.argsort(key)
        same = np.zeros(len(key), dtype=bool)
        equal = key[order][1:] == key[order][:-1]
        same[order[1:][equal]] = True
        same[order[:-1][equal]] = True
        np.add.at(repeated, at[same], 1)
        np.add.at(repeated, at[same] + WINDOW, -1)
    covered = np.cumsum(repeated[:-1]) > 0
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(covered)])[words.off])
    return {k: out[k].astype(np.int64) for k in STATS}


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


#: A rule: its name, the statistic as a share of another, the value up to which (or from which) it votes keep, and that from which (or up to which) it votes drop.
RULES: list[tuple[str, str, str, float, float]] = [
    ("symbols", "n_symbols", "n_words", 0.02, 0.1),
    ("bare", "n_bare", "n_words", 0.05, 0.2),
    ("echoes", "n_echoes", "n_words", 0.02, 0.1),
    ("lines", "n_dup_lines", "n_lines", 0.1, 0.4),
    ("capitals", "n_upper", "n_letters", 0.1, 0.4),
    ("letters", "n_letters", "word_chars", 0.8, 0.65),
    ("short", "n_short", "n_words", 0.15, 0.05),
    ("ends", "n_ends", "n_words", 0.04, 0.01),
]


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """Texts by rules: 1 keep, -1 drop, 0 abstain. A share of nothing abstains."""
    out = np.zeros((len(s["n_words"]), len(RULES)), dtype=np.int8)
    for j, (_, top, bottom, keep, drop) in enumerate(RULES):
        below = s[bottom].astype(float)
        x = np.divide(s[top], below, out=np.full(len(out), np.nan), where=below > 0)
        with np.errstate(invalid="ignore"):
            good, bad = (x <= keep, x >= drop) if keep < drop else (x >= keep, x <= drop)
        out[:, j] = good.astype(np.int8) - bad.astype(np.int8)
    return out


def pattern_code(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def pattern_votes(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(RULES))) % 3 - 1


@dataclass
class Model:
    """``chance[c, j, o]``: how often rule j drops (o = 0), abstains (1) or keeps (2) a document of class c (0 bad, 1 good); ``prior`` of good."""

    chance: np.ndarray
    prior: float

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """The probability of quality by vote pattern."""
        rules = np.arange(v.shape[1])
        log = np.log([1 - self.prior, self.prior]) + np.stack([np.log(self.chance[c])[rules, v + 1].sum(axis=1) for c in (0, 1)], axis=1)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p[:, 1] / p.sum(axis=1)

    def accuracy(self) -> np.ndarray:
        """The share of each rule's votes (not its abstentions) that are right."""
        share = np.array([1 - self.prior, self.prior])
        right = share[0] * self.chance[0, :, 0] + share[1] * self.chance[1, :, 2]
        wrong = share[0] * self.chance[0, :, 2] + share[1] * self.chance[1, :, 0]
        return right / (right + wrong)


def fit(v: np.ndarray, weight: np.ndarray, rounds: int = 1000) -> Model:
    """Expectation-maximisation over patterns ``v`` that occur ``weight`` times.

    It starts from the votes: a pattern with any drop vote is good with probability 0.1, one with keep votes alone with 0.9, any
    other is either. (A start from the majority ends where one kind of fault is the bad class and all others are good.) Nothing is held to a bound; an imagined vote of each kind keeps rare votes from counting as certain. The class
    whose rules drop less is the good one.
    """
    p = np.where((v < 0).any(axis=1), 0.1, np.where((v > 0).any(axis=1), 0.9, 0.5))
    model = None
    for _ in range(rounds):
        chance = np.empty((2, v.shape[1], 3))
        for c, share in ((0, (1 - p) * weight), (1, p * weight)):
            counts = np.stack([share @ (v == o) for o in (-1, 0, 1)], axis=1) + 1
            chance[c] = counts / counts.sum(axis=1, keepdims=True)
        prior = (p @ weight + 1) / (weight.sum() + 2)
        done = model is not None and np.abs(chance - model.chance).max() < 1e-7 and abs(prior - model.prior) < 1e-7
        model = Model(chance, float(prior))
        if done:
            break
        p = model.posterior(v)
    if model.chance[1, :, 0].sum() > model.chance[0, :, 0].sum():
        model = Model(model.chance[::-1].copy(), 1 - model.prior)
    return model


def scored(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Statistics, ``base_failed``, ``quality`` (posterior probability) and ``kept`` for every row of ``docs`` (doc_id, text).

    Kept are rows that pass the base rule and whose posterior is at least ``least``. Null, empty and wordless texts have
    zero statistics and fail the base rule. Repeated rows count each, an empty table gives no rows, and other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def look(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = text_stats(part.column("text"))
                failed = base_failed(s)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(s[k]) for k in STATS), pa.array(failed), pa.array(pattern_code(votes(s)))], ["doc_id", *STATS, "base_failed", "pattern"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in STATS) + ", base_failed boolean, pattern long"
    seen = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(look, schema), "quality")
    counts = seen.groupBy("pattern").count().collect()  # 3 ** len(RULES) rows at most
    if not counts:
        return seen.select("doc_id", *STATS, "base_failed", F.lit(0.0).alias("quality"), F.lit(False).alias("kept"))
    code, weight = np.array([r["pattern"] for r in counts]), np.array([r["count"] for r in counts], dtype=float)
    v = pattern_votes(code)
    posterior = fit(v, weight).posterior(v)
    known = spark.createDataFrame([(int(c), float(p)) for c, p in zip(code, posterior, strict=True)], "pattern long, quality double")
    return seen.join(F.broadcast(known), "pattern").select("doc_id", *STATS, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"))
