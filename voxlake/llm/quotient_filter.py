"""A counting quotient filter: fingerprints with counts in sorted runs of remainders, packed into bytes.

A fingerprint of ``bits`` bits is a quotient and a remainder. Remainders of one quotient form a run, sorted, in the first free slots
from the quotient's own slot on. Three bit vectors say which quotients have a run, which slots end one, and which slots hold digits of
the count of the remainder before them (a remainder that occurs once has none). Nothing is lost: the fingerprints and their counts can
be read back in order, so filters merge by merging sorted remainders, and the merged filter is that of all fingerprints together.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

U = np.uint64
#: Slots in use of all slots, at most, but for digits of counts.
LOAD = 0.8
_HEAD = struct.Struct("<BBQ")


@dataclass
class CountingQuotientFilter:
    """``has_run`` is by quotient; ``ends_run``, ``is_digit`` and ``content`` are by slot."""

    quotient_bits: int
    remainder_bits: int
    has_run: np.ndarray
    ends_run: np.ndarray
    is_digit: np.ndarray
    content: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints of ``bits`` bits (2 to 64), and how often each occurs."""
        q = min(max(1, int(np.ceil(np.log2(max(len(fingerprints), 1) / LOAD)))), bits - 1)
        r = bits - q
        has_run = np.zeros(1 << q, dtype=bool)
        if not len(fingerprints):
            return cls(q, r, has_run, np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, U))
        quotient, mask = (fingerprints >> U(r)).astype(np.int64), U((1 << r) - 1)
        more = counts.astype(U) - U(1)
        digits = np.zeros(len(more), dtype=np.int64)
        left = more.copy()
        while left.any():
            digits += left > 0
            left = left >> U(r)
        width = digits + 1
        of = np.repeat(np.arange(len(width)), width)
        place = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
        content = np.where(place == 0, fingerprints[of] & mask, (more[of] >> (U(r) * np.maximum(place - 1, 0).astype(U))) & mask)
        home, i = quotient[of], np.arange(len(of))
        slot = np.maximum.accumulate(home - i) + i
        size = max(1 << q, int(slot[-1]) + 1)
        out = cls(q, r, has_run, np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, U))
        has_run[quotient] = True
        out.ends_run[slot[np.append(home[1:] != home[:-1], True)]] = True
        out.is_digit[slot] = place > 0
        out.content[slot] = content
        return out

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in order, and their counts."""
        quotient, end = np.flatnonzero(self.has_run), np.flatnonzero(self.ends_run)
        if not len(quotient):
            return np.zeros(0, U), np.zeros(0, np.int64)
        start = np.maximum(quotient, np.append(-1, end[:-1]) + 1)
        length = end - start + 1
        slot = np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)
        digit, content = self.is_digit[slot], self.content[slot]
        head = np.flatnonzero(~digit)
        of = np.cumsum(~digit) - 1
        place = np.arange(len(slot)) - head[of]
        counts = np.ones(len(head), dtype=U)
        np.add.at(counts, of[digit], content[digit] << (U(self.remainder_bits) * (place[digit] - 1).astype(U)))
        return (np.repeat(quotient, length)[head].astype(U) << U(self.remainder_bits)) | content[head], counts.astype(np.int64)

    def to_bytes(self) -> bytes:
        width = -(-self.remainder_bits // 8)
        content = self.content.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return _HEAD.pack(self.quotient_bits, self.remainder_bits, len(self.content)) + b"".join(np.packbits(x).tobytes() for x in (self.has_run, self.ends_run, self.is_digit)) + content.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, r, size = _HEAD.unpack_from(data)
        at, vectors = _HEAD.size, []
        for n in (1 << q, size, size):
            vectors.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool))
            at += -(-n // 8)
        content = np.zeros((size, 8), np.uint8)
        content[:, : -(-r // 8)] = np.frombuffer(data, np.uint8, offset=at).reshape(size, -1) if size else 0
        return cls(q, r, *vectors, content.reshape(-1).view("<u8").astype(U))


def merged(filters: Iterable[CountingQuotientFilter], bits: int) -> CountingQuotientFilter:
    """The filter of the fingerprints of all: sorted remainders are merged, and counts of equal ones added."""
    parts = [f.items() for f in filters]
    fingerprints = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U)
    counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(fingerprints, kind="stable")  # a merge of sorted runs
    fingerprints, counts = fingerprints[order], counts[order]
    first = np.flatnonzero(np.append(True, fingerprints[1:] != fingerprints[:-1])) if len(fingerprints) else np.zeros(0, np.int64)
    return CountingQuotientFilter.of(fingerprints[first], np.add.reduceat(counts, first) if len(first) else counts, bits)
