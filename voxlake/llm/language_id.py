"""Language identification by rank-order profiles.

A profile is a list of the most frequent character n-grams (1 to 3 letters, words padded with a blank on both
sides), by falling frequency. A document's profile is compared to each language's by the out-of-place
distance: the sum, over the document's n-grams, of how far each is from its rank in the language's profile, with
the profile's length for n-grams that it lacks. The nearest language wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches, stored
from .textbatch import slices, utf8

#: n-grams of a profile.
PROFILE = 300
#: Labelled documents that are read for each language, about: each is by the hash of its id and text, with the same chance. All are read where there are fewer.
TRAIN_DOCS = 2_000
#: Languages of a block: profiles are broadcast block by block, each of at most so many times ``PROFILE`` n-grams (under 60 MB). All languages are learned, however many.
BLOCK_LANGUAGES = 10_000
#: Bytes of text whose n-grams are counted at once: each takes some hundred bytes for a moment.
SLICE = 1 << 18
UNKNOWN = "und"
BITS = 21  # of a code point

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Every code point's lower-case form if it is a letter, else 0."""
    global _letters
    if _letters is None:
        out = np.zeros(0x110000, dtype=np.int64)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters = out
    return _letters


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts and their offsets (null: empty)."""
    buf, offs = utf8(texts)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    lead = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    return points, lead[offs]


def ngram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) sorted by text, then falling count, then n-gram; and the number of letters of each text.

    An n-gram of letters a, b, c is the number (a << 42) | (b << 21) | c, 0 standing for a word's edge.
    """
    points, offs = code_points(texts)
    n_docs = len(offs) - 1
    letters = _letter_table()[points]
    n_letters = np.diff(np.concatenate([[0], np.cumsum(letters > 0)])[offs])
    # one blank after every text, and one blank for each run of other characters
    doc = np.repeat(np.arange(n_docs), np.diff(offs))
    ends = offs[1:]
    seq = np.insert(letters, ends, 0)
    own = np.insert(doc, ends, np.arange(n_docs))
    keep = np.ones(len(seq), dtype=bool)
    keep[1:] = (seq[1:] != 0) | (seq[:-1] != 0)
    seq, own = seq[keep], own[keep]
    if not len(seq):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), n_letters
    seq, own = np.concatenate([[0], seq]), np.concatenate([own[:1], own])  # the first word's left edge
    uses, where = np.unique(seq, return_inverse=True)
    width = max(1, int(len(uses) - 1).bit_length())
    docs_bits = max(1, int(n_docs).bit_length())
    if 3 * width + docs_bits + 2 > 63:  # an alphabet as large as that has to be split
        half = n_docs // 2
        if half:
            a, b = ngram_counts(texts[:half]), ngram_counts(texts[half:])
            return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]]), n_letters
    # keys: text, n, letters; a gram belongs to the text of its last character
    x = where.astype(np.int64)
    one = seq != 0
    two = np.zeros(len(x), dtype=bool)
    two[1:] = (seq[1:] != 0) | (seq[:-1] != 0)
    two[1:] &= own[1:] == own[:-1]
    if len(x) > 1:
        two[1:] |= (seq[:-1] == 0) & (seq[1:] != 0)
    three = np.zeros(len(x), dtype=bool)
    three[2:] = (seq[1:-1] != 0) & (own[1:-1] == own[2:])
    three[2:] &= (own[:-2] == own[2:]) | (seq[:-2] == 0)
    top = own.astype(np.int64) << (3 * width + 2)
    grams = [(top | (1 << (3 * width)) | x)[one]]
    b = np.zeros_like(x)
    b[1:] = (x[:-1] << width) | x[1:]
    grams.append((top | (2 << (3 * width)) | b)[two])
    t = np.zeros_like(x)
    t[2:] = (x[:-2] << (2 * width)) | b[2:]
    grams.append((top | (3 << (3 * width)) | t)[three])
    keys = np.sort(np.concatenate(grams))
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), n_letters
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    size = (keys >> (3 * width)) & 3
    mask = (1 << width) - 1
    gram = np.zeros(len(keys), dtype=np.int64)
    for place in range(3):
        part = uses[(keys >> (place * width)) & mask]
        gram |= np.where(size > place, (part + 1) << (BITS * place), 0)
    doc = keys >> (3 * width + 2)
    order = np.lexsort((gram, -count, doc))
    return doc[order], gram[order], count[order], n_letters


@dataclass
class Profiles:
    """Languages in order of their names. ``grams`` is sorted; gram g is in the profiles of ``lang[off[g] : off[g + 1]]``, with the ranks ``rank[off[g] : off[g + 1]]``."""

    languages: list[str]
    grams: np.ndarray
    off: np.ndarray
    lang: np.ndarray
    rank: np.ndarray
    size: int

    @staticmethod
    def of(rows: list[tuple[str, int, int]], size: int) -> Profiles:
        """From (language, n-gram, rank from 0)."""
        languages = sorted({x[0] for x in rows})
        number = {x: i for i, x in enumerate(languages)}
        lang, gram, rank = (np.array(x, dtype=np.int64) for x in zip(*((number[a], g, r) for a, g, r in rows), strict=True)) if rows else [np.zeros(0, np.int64)] * 3
        order = np.lexsort((lang, gram))
        grams, first = np.unique(gram[order], return_index=True)
        return Profiles(languages, grams, np.append(first, len(rows)), lang[order].astype(np.int32), rank[order].astype(np.int32), size)


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, size: int = PROFILE) -> list[Profiles]:
    """Profiles from the text and lang of ``docs`` (doc_id, text, lang), in blocks of ``BLOCK_LANGUAGES``; rows with a null text or lang teach nothing.

    Every label is learned. About ``train_docs`` documents a language are read; equal rows are read together or not at all. What comes to the driver
    are ``size`` n-grams a language.
    """
    small_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    # a document is read if its hash is among the first of so many equal parts; no rows meet to be ranked
    parts = 1 << 40
    bounds = stored(known.groupBy("lang").agg(F.least(F.lit(parts), F.floor(F.lit(parts * train_docs) / F.count("*")).cast("long")).alias("bound")), "languages")
    texts = known.join(bounds, "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) < F.col("bound"))

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                doc, gram, n, _ = ngram_counts(part.column("text"))
                langs = pc.dictionary_encode(part.column("lang"))
                code = np.asarray(langs.indices)[doc].astype(np.int64)
                order = np.lexsort((gram, code))
                gram, code, n = gram[order], code[order], n[order]
                if len(gram):
                    first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (code[1:] != code[:-1])]))
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(code[first])), pa.array(gram[first]), pa.array(np.add.reduceat(n, first))], ["lang", "gram", "n"])

    totals = texts.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out, rows, last, languages = [], [], None, 0
    for r in stored(ranked.select("lang", "gram", "rank"), "profiles").orderBy("lang").toLocalIterator():
        if r.lang != last:
            if languages == BLOCK_LANGUAGES:
                out.append(Profiles.of(rows, size))
                rows, languages = [], 0
            last, languages = r.lang, languages + 1
        rows.append((r.lang, r.gram, r.rank - 1))
    return [*out, Profiles.of(rows, size)] if rows else out


def distances(texts: pa.Array, profiles: Profiles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest language's number and its distance for each text, and the greatest distance that the text could have (0 without a letter)."""
    doc, gram, _, n_letters = ngram_counts(texts)
    n = len(texts)
    best, least, most = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not len(doc) or not profiles.languages:
        return best, least, most
    rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(n))[doc]
    top = rank < profiles.size
    doc, gram, rank = doc[top], gram[top], rank[top]
    most = np.bincount(doc, minlength=n) * profiles.size * (n_letters > 0)
    at = np.minimum(np.searchsorted(profiles.grams, gram), len(profiles.grams) - 1)
    hit = np.flatnonzero(profiles.grams[at] == gram)
    begin, held = profiles.off[at[hit]], np.diff(profiles.off)[at[hit]]
    entry = np.repeat(begin - np.cumsum(held) + held, held) + np.arange(held.sum())
    # an n-gram that a profile has is nearer than one that it lacks by so much
    nearer = profiles.size - np.abs(profiles.rank[entry] - np.repeat(rank[hit], held))
    owner, languages = np.repeat(doc[hit], held), len(profiles.languages)
    wide = max(1, (1 << 22) // languages)  # texts whose distances are summed at once
    for a in range(0, n, wide):
        b = min(n, a + wide)
        x, y = np.searchsorted(owner, [a, b])
        total = np.bincount((owner[x:y] - a) * languages + profiles.lang[entry[x:y]], weights=nearer[x:y], minlength=(b - a) * languages).reshape(b - a, languages)
        best[a:b] = total.argmax(axis=1)
        least[a:b] = most[a:b] - total.max(axis=1).astype(np.int64)
    return best, least, most


def _told(docs: DataFrame, blocks: list[Profiles]) -> DataFrame:
    """``docs`` (with a column text) with lang_pred and score. Each block of languages is a map over the texts that keeps the nearer language; nothing is shuffled."""
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [*docs.columns, "lang_pred", "score"]
    out = docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    for block in blocks:
        held = docs.sparkSession.sparkContext.broadcast(block)

        def tell(batches, held=held):
            languages = held.value.languages
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    best, least, most = distances(part.column("text"), held.value)
                    pred, score = part.column("lang_pred").to_pylist(), part.column("score").to_numpy().copy()
                    for d in np.flatnonzero(most).tolist():
                        now = 1 - least[d] / most[d]
                        if pred[d] == UNKNOWN or now > score[d]:  # of equals the first by name, which is in an earlier block
                            pred[d], score[d] = languages[best[d]], now
                    yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(pred, pa.string()), pa.array(score)], names)

        out = out.mapInArrow(tell, schema)
    return out


def identified(docs: DataFrame, profiles: list[Profiles]) -> DataFrame:
    """doc_id, text's language ``lang_pred`` and ``score`` in 0..1 for every row of ``docs`` (doc_id, text).

    The score is 1 less the distance as a share of the greatest possible. A null text, or one without a letter, gets ``und`` and score 0. So does every text if no language was
    learned. Ties go to the language that comes first in alphabetic order. Repeated rows get a row each.
    """
    return _told(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), profiles).select("doc_id", "lang_pred", "score")


def with_language(docs: DataFrame, profiles: list[Profiles], least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with a score of at least ``least_score``."""
    told = _told(docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")), profiles)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
