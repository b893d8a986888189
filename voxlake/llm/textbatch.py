"""Vectorised text primitives: whole Arrow batches of texts as one byte buffer, words and shingles as numpy arrays.

A text batch is a UTF-8 buffer and the offsets of its texts. Words are addressed by their byte ranges
and hashed with a polynomial rolling hash (prefix sums in wrapping 64-bit arithmetic), so no Python
object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_inverse = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Texts are handled in groups of about so many bytes; one longer text is a group of its own.
SLICE_BYTES = 1 << 19
WORD_K = 5


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES * 2)
        have = np.full(size, base, dtype=U)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift-multiply finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(BASE) + U(seed)) | U(1)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes of text each."""
    if not len(batch):
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


class Words:
    """The words of a text batch: ``start``, ``end`` (bytes), ``hash``; ``off`` are the texts' offsets into them."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray):
        n = len(buf)
        flag = is_word[buf]
        before = np.empty(n, dtype=bool)
        before[1:] = flag[:-1]
        inner = offs[:-1][offs[:-1] < n]
        before[inner] = False
        self.start = np.flatnonzero(flag & ~before)
        after = np.empty(n, dtype=bool)
        after[:-1] = flag[1:]
        if n:
            after[-1] = False
        last = offs[1:] - 1
        after[last[last >= 0]] = False
        self.end = np.flatnonzero(flag & ~after) + 1
        self.off = np.searchsorted(self.start, offs)
        self.sums = prefix_sums(buf)
        self.hash = range_hash(self.sums, self.start, self.end)
        self.counts = np.diff(self.off)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.counts)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum((buf.astype(U) + U(1)) * powers(BASE, len(buf)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end)."""
    return mix((sums[end] - sums[start]) * powers(_inverse, len(sums))[start] + (end - start).astype(U))


def table(chars: bytes, rest: bool) -> np.ndarray:
    """A look-up table by byte: true for ``chars`` and, if ``rest``, for every byte of 128 and above."""
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    out[128:] = rest
    return out


#: Words of shingles: runs of lower-case ASCII letters, digits and non-ASCII characters of the lower-cased text.
SHINGLE_WORD = table(b"abcdefghijklmnopqrstuvwxyz0123456789", True)
#: Words between blanks: anything but space, tab, line feed, vertical tab, form feed and carriage return.
BLANK_WORD = ~table(b" \t\n\x0b\x0c\r", False)


def window_hash(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that lie in one text, and the index of their first word."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    factor = powers(_inverse, k + 1)
    out = np.zeros(n, dtype=U)
    for j in range(k):
        out += words.hash[j : j + n] * factor[j]
    first = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    return mix(out[first]), first


class Shingles:
    """k-word shingles of a batch of texts, in order: ``hash``; ``off`` are the texts' offsets into them.

    A text of 1 to k-1 words has one shingle, made of all its words. A null or wordless text has none.
    """

    def __init__(self, texts: pa.Array, k: int = WORD_K):
        buf, offs = utf8(pc.utf8_lower(texts))
        self.words = words = Words(buf, offs, SHINGLE_WORD)
        hashes, first = window_hash(words, k)
        doc = words.doc[first] if len(first) else np.zeros(0, np.int64)
        short = np.flatnonzero((words.counts > 0) & (words.counts < k))
        if len(short):
            extra = np.array([_short(words.hash[words.off[d] : words.off[d + 1]]) for d in short.tolist()], dtype=U)
            doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, extra])
            order = np.argsort(doc, kind="stable")
            doc, hashes = doc[order], hashes[order]
        self.hash, self.doc = hashes, doc
        self.off = np.searchsorted(doc, np.arange(len(offs)))


def _short(words: np.ndarray) -> int:
    total = (words * powers(_inverse, len(words) + 1)[: len(words)]).sum(dtype=U)
    return int(mix(np.array([total + U(len(words))], dtype=U))[0])


def ragged(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """Rows of binary: the little-endian bytes of each slice of ``values``."""
    width = values.dtype.itemsize
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off.astype(np.int64) * width).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())
