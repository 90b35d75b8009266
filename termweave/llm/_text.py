"""Vectorised text helpers for Arrow batches: every function works on whole chunks of documents with numpy.

A chunk is a run of documents of at most ``CHUNK`` bytes (one longer document is a chunk of its own), so the
memory that a task needs is bounded by the chunk and by its longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20
U = np.uint64
MODULI = [((1 << 31) - 1, 0x2545F491), ((1 << 31) - 19, 0x1B56C4E9)]  # primes and bases
_held: dict[tuple[int, int], np.ndarray] = {}


def powers_of(prime: int, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo the prime, each half from the one before; kept by the worker."""
    out = _held.get((prime, base))
    if out is None or len(out) < n:
        out, k = np.ones(max(n, CHUNK + 4096), U), 1
        while k < len(out):
            step = min(k, len(out) - k)
            out[k : k + step] = out[:step] * U(pow(base, k, prime)) % U(prime)
            k += step
        _held[prime, base] = out
    return out[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


#: A random 64-bit value for each byte, and the same with A-Z read as a-z.
BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
#: The white space of the word rule [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts (null: empty) and the n + 1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n, at = len(texts), texts.offset
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of column ``text``, with its bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = utf8(batch.column(text))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk, and for each document the index of its first word (n + 1 values)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True  # a document's first byte starts a word even after a word byte
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


class Sums:
    """Prefix sums modulo two primes over one 64-bit mark for each unit, for hashes of any span of them. A polynomial modulo
    2**64 will not do: for every odd base it gives a word of 1,024 letters in the Thue-Morse order, and its complement,
    one hash. Modulo a prime two different spans are equal for few of the bases only."""

    def __init__(self, marks: np.ndarray):
        self.parts = []
        for (prime, base), mark in zip(MODULI, (marks & U(0x3FFFFFFF), marks >> U(34)), strict=True):
            sums = np.zeros(len(marks) + 1, U)
            np.cumsum(mark * powers_of(prime, base, len(marks)) % U(prime), out=sums[1:])  # below 2**31 each: no overflow in a text
            self.parts.append((U(prime), sums, powers_of(prime, pow(base, -1, prime), len(marks) + 1)))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans, of both residues and the length, equal for equal spans wherever they stand."""
        one, two = ((sums[ends] - sums[starts]) % prime * back[starts] % prime for prime, sums, back in self.parts)
        return mix((one << U(32) | two) + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and each document's first word (n + 1 values)."""
    starts, ends, first = words(data, off)
    return Sums(LOWER[data]).spans(starts, ends), first


def owners(first: np.ndarray) -> np.ndarray:
    """For each item the index of its document, given each document's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a plain sort: several times faster than np.unique on 64-bit integers)."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[at], np.diff(np.append(at, len(values)))
