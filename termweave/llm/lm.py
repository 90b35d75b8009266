"""Operator 6, language-model scoring: an interpolated modified Kneser-Ney trigram model, counted in Spark, stored as
sorted hash arrays in the shared folder and memory-mapped by the workers that score.

Counting: each task sums the trigrams u v w of its training texts and sends one block of them to each shard; a shard
holds all trigrams with its middle words v, so it knows the followers of each context (u, v), the words before each
pair (v, w), and the followers of v. A middle word so frequent that it would fill more than a shard is dealt over all
shards by u; its pairs are then summed by a second shuffle, by (v, w). Counts and continuation counts of words are
summed by a last shuffle. What meets in a shard is summed before it is sent, and only sums reach the driver, with the
words that are most common in the tasks' first chunks: blocks name these by rank and all others by hash.

Scoring: tasks look up the distinct trigrams, pairs and words of some thousand texts in the mapped arrays, in order.

    p(w | u v) = (max(c(uvw) - D(c), 0) + g(u v) p(w | v)) / c(uv)       p(w | v) for a context that was never seen
    p(w | v)   = (max(k(vw) - D'(k), 0) + g'(v) p(w)) / k(v)             k(vw): after how many u the pair has stood
    p(w)       = (max(k(w) - D''(k), 0) + G / (V + 1)) / K               k(w): in how many pairs w has come second

The discounts for counts 1, 2 and 3 or more come from the numbers of counts 1 to 4 of each order; g and G give what they
take to the lower order, whose last is uniform over the V training tokens and one unknown. Where these numbers are too
small for discounts between 0 and the count, 0.5, 1 and 1.5 are used. Two begin tokens stand before each text.

Words are told apart by hashes of 56 bits; a stored key is its place in a bucket of the array and 32 further bits.

Defined results: a null or empty text is one end token; every row of the input gives a row; a null id counts as ''
(held out); without training text every token is unknown and p is 1; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm._spark import shared_dir, table, written
from termweave.llm._text import U, chunks, counted, distinct, mix, word_hashes
from termweave.llm.quality import held_out

FOLDS = 10
SHARD = 32 << 20  # bytes of text for each shard, about
TOKENS = 6_000_000  # tokens that a task sums before it sends them on
SCORED = 1_000_000  # tokens whose scores a task looks up at once
COMMON = 1 << 18  # words that are sent by their rank, at most
NARROW = 1 << 21  # words whose numbers, three at a time, are one number of 63 bits
END, BEGIN = U(0x5BD1E995AABBCCDD) >> U(8), U(0x1B873593CC9E2D51) >> U(8)
_A, _B = U(0x9FB21C651E98DF25), U(0xC2B2AE3D27D4EB4F)
BUCKET = 8  # keys in a bucket, about


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a chunk, the end behind each document's words, and each document's first token (n + 1 values)."""
    h, first = word_hashes(data, off)
    h = h >> U(8)
    at = first + np.arange(len(first))
    out = np.empty(at[-1], U)
    out[at[1:] - 1] = END
    inner = np.ones(len(out), bool)
    inner[at[1:] - 1] = False
    out[inner] = h
    return out, at


def before(tok: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each token."""
    v, u = np.empty(len(tok), U), np.empty(len(tok), U)
    v[1:] = tok[:-1]
    v[at[:-1]] = BEGIN
    u[1:] = v[:-1]
    u[at[:-1]] = BEGIN
    return u, v


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a * _A) + b * _B)


def triple_key(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(pair_key(u, v) * _A + w * _B)


def shard_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (mix(key) >> U(64 - bits)).astype(np.int64)


def shards(u: np.ndarray, v: np.ndarray, frequent: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each trigram with these first two words."""
    out = shard_of(v, bits)
    if len(frequent):
        often = np.isin(v, frequent)
        out[often] = shard_of(pair_key(u[often], v[often]), bits)
    return out


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of integers as compressed planes of their bytes."""
    planes = [c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns]
    return pa.Codec("zstd", compression_level=1).compress(b"".join(planes), asbytes=True)


def unsqueezed(raw: bytes, n: list[int], kinds: list[str]) -> list[np.ndarray]:
    sizes = [k * np.dtype(t).itemsize for k, t in zip(n, kinds, strict=True)]
    data, out, a = pa.Codec("zstd").decompress(raw, decompressed_size=sum(sizes), asbytes=True), [], 0
    for k, t, size in zip(n, kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, a).reshape(-1, k).T).view(t).ravel() if k else np.zeros(0, t))
        a += size
    return out


def deltas(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=ordered[:1] * 0)


def small(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte each, those of 255 and more as a 255 and, behind all, in eight bytes each."""
    large = counts[counts >= 255].astype(np.uint64)
    return np.concatenate([np.minimum(counts, 255).astype(np.uint8), np.frombuffer(large.tobytes(), np.uint8)])


def unsmall(raw: np.ndarray, n: int) -> np.ndarray:
    out = raw[:n].astype(np.int64)
    large = out == 255
    if large.any():
        out[large] = np.frombuffer(raw[n:].tobytes(), np.uint64).astype(np.int64)
    return out


def saved(folder: str, name: str, values: np.ndarray) -> None:
    """Under its name at once and whole, so that a task that is repeated does no harm."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    values.tofile(part)
    os.replace(part, f"{folder}/{name}")


BLOCK = "shard long, n array<long>, words binary, entries binary"
NONE = np.zeros(0, U)


def since(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences of integers that ascend from each start on, which keeps its own."""
    out = deltas(values)
    out[starts] = values[starts]
    return out


def summed(differences: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What ``since`` was given."""
    out = np.cumsum(differences, dtype=np.int64)
    return out - np.repeat(out[starts] - differences[starts], np.diff(np.append(starts, len(out))))


class Words:
    """The words of a task by numbers: first those that are common, in their order, then the others by their hashes."""

    def __init__(self, known: np.ndarray, common: np.ndarray):
        order = np.argsort(common)
        at = np.searchsorted(common[order], known)
        rank = np.append(order, 0)[at]
        there = (at < len(common)) & (np.append(common, U(0))[rank] == known)
        new = np.argsort(np.where(there, rank, len(common)), kind="stable")
        self.n, self.ranks, self.hashes = int(there.sum()), rank[new].astype(np.uint32), known[new]
        self.number = np.empty(len(known), np.int64)  # by the place in known
        self.number[new] = np.arange(len(known))
        self._mark, self._own = np.zeros(len(known), bool), np.empty(len(known), np.uint32)

    def block(self, shard: int, v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray) -> list:
        """A shard's trigrams in the order of v, u, w: the words of the block once, the common ones by their ranks, then
        each trigram by the words' numbers in the block."""
        for x in (v, u, w):
            self._mark[x] = True
        own = np.flatnonzero(self._mark)
        self._mark[own] = False
        self._own[own] = np.arange(len(own), dtype=np.uint32)
        v, u, w = self._own[v], self._own[u], self._own[w]
        of_v = np.flatnonzero(np.diff(v, prepend=v[0] + 1))
        counts = small(count)
        common, other = own[: (k := np.searchsorted(own, self.n))], own[k:]
        return [shard, [len(common), len(other), len(v), len(counts)], squeezed(deltas(self.ranks[common]), deltas(self.hashes[other])), squeezed(deltas(v), since(u, of_v), w, counts)]


def opened(n: list[int], words: bytes, entries: bytes, common: np.ndarray = NONE) -> list[np.ndarray]:
    ranks, other = unsqueezed(words, n[:2], ["<u4", "<u8"])
    own = np.concatenate([common[np.cumsum(ranks, dtype=np.int64)], np.cumsum(other, dtype=U)])
    v, u, w, counts = unsqueezed(entries, [n[2]] * 3 + n[3:], ["<u4", "<u4", "<u4", "u1"])
    of_v = np.flatnonzero(np.append(True, v[1:] != 0))
    return [own[summed(u, of_v)], own[np.cumsum(v, dtype=np.uint32)], own[w], unsmall(counts, n[2])]


def summed_trigrams(frequent: np.ndarray, bits: int, common: np.ndarray = NONE):
    def flush(tok: list[np.ndarray], starts: list[np.ndarray]) -> pa.RecordBatch:
        w, at = np.concatenate(tok), np.concatenate(starts)
        tok.clear()  # what is not needed any more goes at once: a task holds some ten numbers for each token
        known = distinct(np.append(w, BEGIN))
        k, words = len(known), Words(known, common)
        begin = words.number[np.searchsorted(known, BEGIN)]
        numbers = words.number[np.searchsorted(known, w)]
        del w, known
        # the numbers of the words before are those of the tokens before, but at the start of a text
        first, second = np.empty_like(numbers), np.empty_like(numbers)
        second[1:] = numbers[:-1]
        second[at] = begin
        first[1:] = second[:-1]
        first[at] = begin
        if k <= NARROW:
            second *= k
            second += first
            second *= k
            second += numbers
            del first, numbers
            keys, count = counted(second)
            del second
            w = keys % k
            keys //= k
            u, v = keys % k, keys // k
            del keys
        else:
            order = np.lexsort((numbers, first, second))
            rows = np.stack([first, second, numbers])[:, order]
            at = np.flatnonzero(np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(0))))
            u, v, w = rows[:, at]
            count = np.diff(np.append(at, len(order)))
        shard = shards(words.hashes[u], words.hashes[v], frequent, bits)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        rows = [words.block(int(shard[order[a]]), v[i], u[i], w[i], count[i]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) for i in [order[a:b]]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], ["shard", "n", "words", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, starts, held = [], [], 0
        for _, data, off in chunks(batches, text=0):
            t, at = tokens(data, off)
            tok.append(t)
            starts.append(at[:-1] + held)
            held += len(t)
            if held >= TOKENS:
                yield flush(tok, starts)
                tok, starts, held = [], [], 0
        if held:
            yield flush(tok, starts)

    return run


def bucket_bits(n: int) -> int:
    return max(0, (n // BUCKET).bit_length())


def even(n: int, bits: int, bucket: np.ndarray) -> np.ndarray:
    """Where buckets would begin were the n keys dealt evenly."""
    return (bucket * n) >> bits


def saved_keys(folder: str, name: str, keys: np.ndarray) -> None:
    """Sorted keys as buckets by their leading bits, and 32 bits that follow these. Where a bucket begins is kept as the
    difference from an even deal: half of the bytes of a number, as keys are hashes."""
    bits = bucket_bits(len(keys))
    cut = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U)) if bits else np.array([0, len(keys)])
    off = cut - even(len(keys), bits, np.arange((1 << bits) + 1))
    saved(folder, f"{name}.at", off.astype(np.int16 if np.abs(off).max() < 1 << 15 else np.int32))
    saved(folder, f"{name}.keys", ((keys << U(bits)) >> U(32)).astype(np.uint32))


def numbers_of(values: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each value, equal ones alike, and how many there are."""
    made = pa.array(values).dictionary_encode()
    return made.indices.to_numpy().astype(np.int64), len(made.dictionary)


def saved_rows(folder: str, name: str, *columns: np.ndarray) -> None:
    """Rows of numbers, each distinct row once, the most frequent first, and its number for each row: in one byte, those
    of 255 and more, where there are any, as a 255, with the places of such rows and their numbers beside it."""
    code, k = numbers_of(columns[0])
    for column in columns[1:]:
        of, k = numbers_of(column)
        code, k = numbers_of(code * k + of)
    first, order = np.empty(k, np.int64), np.argsort(-np.bincount(code, minlength=k), kind="stable")
    first[code[::-1]] = np.arange(len(code))[::-1]
    rank = np.empty(k, np.int64)
    rank[order] = np.arange(k)
    code = rank[code]
    saved(folder, f"{name}.kinds", np.stack([c[first[order]] for c in columns], 1).astype(np.int64))
    saved(folder, f"{name}.rows", np.minimum(code, 255).astype(np.uint8))
    if k > 255:
        rare = np.flatnonzero(code >= 255)
        saved(folder, f"{name}.rare", rare.astype(np.uint32))
        saved(folder, f"{name}.codes", code[rare].astype(np.uint32))


def row_codes(folder: str, name: str, at: np.ndarray) -> np.ndarray:
    """The numbers of these rows."""
    out = mapped(f"{folder}/{name}.rows", "u1")[at].astype(np.int64)
    rare = mapped(f"{folder}/{name}.rare", "<u4")
    if len(rare):
        i = np.flatnonzero(out == 255)
        out[i] = mapped(f"{folder}/{name}.codes", "<u4")[np.searchsorted(rare, at[i].astype(np.uint32))]
    return out


def sums(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, where each first stands, and the sums of the columns."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    cut = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.zeros(0, int)
    return ordered[cut], order[cut], *(np.add.reduceat(c[order], cut) if len(cut) else c[:0] for c in columns)


def kinds_of(count: np.ndarray) -> list[np.ndarray]:
    return [(count == 1).astype(np.int64), (count == 2).astype(np.int64), (count >= 3).astype(np.int64)]


def count_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


SENT = "kind string, shard long, n long, a binary, b binary, c binary, stats array<long>"
_SENT = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
NO_STATS = [0] * 10


def sent(rows: list[list]) -> pa.Table:
    return pa.table({name.split()[0]: pa.array(c, t) for name, c, t in zip(SENT.split(", "), zip(*rows, strict=True), _SENT, strict=True)})


def word_rows(words: np.ndarray, kinds: np.ndarray, counts: np.ndarray, bits: int) -> list[list]:
    """Words with how many pairs and tokens of this shard end with them, for the shards of words."""
    word, _, kinds, counts = sums(words, kinds, counts)
    shard = shard_of(word, bits)
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    return [["word", int(shard[i[0]]), len(i), squeezed(deltas(word[i])), small(kinds[i]).tobytes(), small(counts[i]).tobytes(), NO_STATS] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) for i in [order[a:b]]]


def pair_results(folder: str, name: str, v: np.ndarray, w: np.ndarray, kinds: np.ndarray) -> list[int]:
    """Saves the continuation counts of pairs; the numbers of counts 1 to 4, and how many there are."""
    keys = pair_key(v, w)
    order = np.argsort(keys)
    saved_keys(folder, name, keys[order])
    saved_rows(folder, name, kinds[order])
    return [*count_of_counts(kinds), len(keys)]


def trigram_shard(folder: str, frequent: np.ndarray, bits: int, common: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        """All blocks of a shard: saves its arrays and sends on what others need."""
        shard = group.column("shard")[0].as_py()
        parts = [opened(*row, common) for row in zip(*(group.column(c).to_pylist() for c in ("n", "words", "entries")), strict=True)]
        u, v, w, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        keys, at, count = sums(triple_key(u, v, w), count)
        u, v, w = u[at], v[at], w[at]
        saved_keys(folder, f"three-{shard}", keys)
        saved_rows(folder, f"three-{shard}", count)
        stats = [*count_of_counts(count), len(keys)]
        seen, _, *of = sums(pair_key(u, v), count, *kinds_of(count))
        saved_keys(folder, f"before-{shard}", seen)
        saved_rows(folder, f"before-{shard}", *of)
        # pairs of v and w: after how many u they have stood
        _, at, kinds, tokens_of = sums(pair_key(v, w), np.ones(len(v), np.int64), count)
        v, w = v[at], w[at]
        often = np.isin(v, frequent)
        own = ~often
        stats += pair_results(folder, f"two-{shard}", v[own], w[own], kinds[own])
        middle, _, *of = sums(v[own], kinds[own], *kinds_of(kinds[own]))
        saved_keys(folder, f"middle-{shard}", distinct(mix(middle)))
        order = np.argsort(mix(middle))
        saved_rows(folder, f"middle-{shard}", *(c[order] for c in of))
        rows = word_rows(w, own.astype(np.int64), tokens_of, bits) or [["word", shard, 0, squeezed(np.zeros(0, U)), b"", b"", NO_STATS]]
        rows[0][-1] = stats
        if often.any():
            to = shard_of(pair_key(v[often], w[often]), bits)
            for s in np.unique(to).tolist():
                i = np.flatnonzero(often)[to == s]
                rows.append(["pair", s, len(i), v[i].tobytes(), w[i].tobytes(), small(kinds[i]).tobytes(), NO_STATS])
        return sent(rows)

    return run


def _wide(group: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([unsmall(np.frombuffer(c, np.uint8), n) for n, c in zip(group.column("n").to_pylist(), group.column(column).to_pylist(), strict=True)])


def pair_shard(folder: str, bits: int):
    def run(group: pa.Table) -> pa.Table:
        """The pairs of frequent middle words in a shard: saves their counts; sends their words and middle words on."""
        shard = group.column("shard")[0].as_py()
        v, w = (np.frombuffer(b"".join(group.column(c).to_pylist()), U) for c in "ab")
        _, at, kinds = sums(pair_key(v, w), _wide(group, "c"))
        v, w = v[at], w[at]
        stats = [0] * 5 + pair_results(folder, f"often-{shard}", v, w, kinds)
        rows = word_rows(w, np.ones(len(w), np.int64), np.zeros(len(w), np.int64), bits)
        rows[0][-1] = stats
        middle, _, *of = sums(v, kinds, *kinds_of(kinds))
        rows += [["middle", 0, 1, m.tobytes(), None, None, [int(x) for x in of_m] + [0] * 6] for m, *of_m in zip(middle, *of, strict=True)]
        return sent(rows)

    return run


def word_shard(folder: str):
    def run(group: pa.Table) -> pa.Table:
        """All that shards say of the words of a shard: saves their counts; sums of these."""
        shard = group.column("shard")[0].as_py()
        words = np.concatenate([np.cumsum(unsqueezed(a, [n], ["<u8"])[0], dtype=U) for n, a in zip(group.column("n").to_pylist(), group.column("a").to_pylist(), strict=True)])
        words, _, kinds, counts = sums(words, _wide(group, "b"), _wide(group, "c"))
        order = np.argsort(mix(words))
        saved_keys(folder, f"words-{shard}", mix(words)[order])
        saved_rows(folder, f"words-{shard}", kinds[order], counts[order])
        return pa.table({"stats": pa.array([[*count_of_counts(kinds), int(kinds.sum()), int(counts.sum()), len(words)]], pa.list_(pa.int64()))})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """By count 0, 1, 2, 3 and more."""
    plain = np.array([0, 0.5, 1.0, 1.5])
    if min(n1, n2, n3) == 0:
        return plain
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return d if (d[1:] > 0).all() and (d <= [0, 1, 2, 3]).all() else plain


class Model:
    """What all workers need to know of a model; its arrays stay in the folder."""

    def __init__(self, folder: str, bits: int, frequent: dict[int, list[int]], pairs: list[int], words: list[int]):
        self.folder, self.bits, self.frequent = folder, bits, frequent
        self.often = np.array(sorted(frequent), U)
        self.of_often = np.array([frequent[k] for k in sorted(frequent)], np.int64).reshape(-1, 4)
        self.three, self.two, self.one = discounts(*pairs[:4]), discounts(*pairs[5:9]), discounts(*words[:4])
        self.k, self.n, self.v = words[4:7]
        kinds = np.array([0, words[0], words[1], max(0, self.v - words[0] - words[1])])
        self.floor = float(self.one @ kinds) / (self.v + 1) / self.k if self.k else 1.0


@cache
def mapped(path: str, kind: str) -> np.ndarray:
    """A stored array, mapped and not read."""
    if not os.path.exists(path) or os.path.getsize(path) == 0:
        return np.zeros(0, kind)
    return np.memmap(path, kind, "r")


def looked_up(folder: str, name: str, keys: np.ndarray, columns: int) -> np.ndarray:
    """The rows (columns x keys) of keys in one stored array, 0 where there is none."""
    out = np.zeros((columns, len(keys)), np.int64)
    stored = mapped(f"{folder}/{name}.keys", "<u4")
    if not len(stored):
        return out
    bits = bucket_bits(len(stored))
    size = os.path.getsize(f"{folder}/{name}.at") // ((1 << bits) + 1)
    cut = mapped(f"{folder}/{name}.at", f"<i{size}")
    bucket = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    want = ((keys << U(bits)) >> U(32)).astype(np.uint32)
    low, end = (cut[b] + even(len(stored), bits, b) for b in (bucket, bucket + 1))
    high = end
    while (low < high).any():
        middle = (low + high) // 2
        less = (low < high) & (stored[np.minimum(middle, len(stored) - 1)] < want)
        low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
    hit = np.flatnonzero((low < end) & (stored[np.minimum(low, len(stored) - 1)] == want))
    kinds = mapped(f"{folder}/{name}.kinds", "<i8").reshape(-1, columns)
    out[:, hit] = kinds[row_codes(folder, name, low[hit])].T
    return out


class Reader:
    def __init__(self, m: Model):
        self.m = m

    def look(self, name: str, keys: np.ndarray, shard: np.ndarray, columns: int) -> np.ndarray:
        """The rows of keys that lie in these shards, those of one shard in order."""
        order = np.lexsort((keys, shard))
        out = np.empty((columns, len(keys)), np.int64)
        cut = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            i = order[a:b]
            out[:, i] = looked_up(self.m.folder, f"{name}-{shard[i[0]]}", keys[i], columns)
        return out

    def score(self, tok: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """For each document: tokens, known tokens, base score and model score."""
        import pandas as pd

        m = self.m
        u, v = before(tok, at)

        def each(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Number of its distinct key for each token, the distinct keys, and where each first stands."""
            code, found = pd.factorize(keys)
            top = np.maximum.accumulate(code) if len(code) else code
            return code, found, np.flatnonzero(np.concatenate(([True], top[1:] > top[:-1]))) if len(code) else code

        code, word, _ = each(tok)
        kinds, counts = self.look("words", mix(word), shard_of(word, m.bits), 2)
        p = (m.floor + np.maximum(kinds - m.one[np.minimum(kinds, 3)], 0) / max(m.k, 1))[code]
        c = counts[code]

        def interpolated(p, count, discount, of, code_of):
            total, one, two, more = of
            taken = discount[1] * one + discount[2] * two + discount[3] * more
            total, taken = total[code_of], taken[code_of]
            return np.where(total > 0, (np.maximum(count - discount[np.minimum(count, 3)], 0) + taken * p) / np.maximum(total, 1), p)

        code, pair, first = each(pair_key(v, tok))
        of_v = v[first]
        often = np.isin(of_v, m.often)
        kinds = np.zeros(len(pair), np.int64)
        for name, some, shard in (("two", ~often, shard_of(of_v, m.bits)), ("often", often, shard_of(pair, m.bits))):
            kinds[some] = self.look(name, pair[some], shard[some], 1)[0]
        code_v, middle, _ = each(v)
        of = self.look("middle", mix(middle), shard_of(middle, m.bits), 4)
        if len(m.often):
            i = np.minimum(np.searchsorted(m.often, middle), len(m.often) - 1)
            there = m.often[i] == middle
            of[:, there] = m.of_often[i[there]].T
        p = interpolated(p, kinds[code], m.two, of, code_v)

        code, triple, first = each(triple_key(u, v, tok))
        count = self.look("three", triple, shards(u[first], v[first], m.often, m.bits), 1)[0]
        code_uv, context, first = each(pair_key(u, v))
        of = self.look("before", context, shards(u[first], v[first], m.often, m.bits), 4)
        p = interpolated(p, count[code], m.three, of, code_uv)
        per = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else x[:0]
        return [np.diff(at), per((c > 0).astype(np.int64)), per(np.log10((c + 0.1) / (m.n + 0.1 * (m.v + 1)))), per(np.log10(p))]


def local_folder(spark: SparkSession) -> str:
    """The shared folder as a path that workers can map files from."""
    where = urlparse(shared_dir(spark))
    if where.scheme not in ("", "file"):
        raise ValueError(f"workers map the model's files, so spark.checkpoint.dir must be a mounted folder, not {where.scheme}:")
    return where.path


def common_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's first chunk the tokens in all (word null) and the words that occur in it twice or more."""
    for _, data, off in chunks(batches, text=0):
        t, _ = tokens(data, off)
        word, count = counted(t)
        often = count > 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(0, word[often].view(np.int64)), mask=np.append(True, np.zeros(often.sum(), bool))), pa.array(np.append(len(t), count[often]))], ["word", "n"])
        break
    for _ in batches:  # the rest is read by no one
        break


def train(texts: DataFrame) -> Model:
    """The model of a column of texts."""
    spark = texts.sparkSession
    texts = texts.select(F.coalesce(F.col(texts.columns[0]), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(2, int(size // SHARD).bit_length())
    # which words are common changes how they are sent, and which middle words are dealt over all shards how work is
    # spread; neither changes a result
    share = texts.mapInArrow(common_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    share = share.orderBy(F.col("word").isNotNull(), F.desc("n"), "word").limit(1 + COMMON).toArrow()
    total = share["n"][0].as_py() if len(share) else 0
    common, n = share["word"][1:].to_numpy().astype(np.int64).view(U), share["n"][1:].to_numpy()
    frequent = np.sort(common[n << bits > 2 * total])
    folder = f"{local_folder(spark)}/lm-{uuid.uuid4().hex}"
    blocks = texts.mapInArrow(summed_trigrams(frequent, bits, common), BLOCK)
    first = blocks.groupBy("shard").applyInArrow(trigram_shard(folder, frequent, bits, common), SENT)
    told = written(first, "lm-sent")
    if len(frequent):
        pairs = written(told.where("kind = 'pair'").groupBy("shard").applyInArrow(pair_shard(folder, bits), SENT), "lm-pairs")
        told = told.where("kind = 'word'").unionAll(pairs)
    else:
        pairs = None
    words = told.where("kind = 'word'").select("shard", "n", "a", "b", "c").groupBy("shard").applyInArrow(word_shard(folder), "stats array<long>")
    summed_up = lambda df, n: list(df.agg(*(F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(n))).first())
    of_words = summed_up(words, 7)
    of_pairs = summed_up(told.where("kind = 'word'"), 10)
    middles = pairs.where("kind = 'middle'").groupBy("a").agg(*(F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(4))).collect() if pairs is not None else []
    of_often = {int(w): [0, 0, 0, 0] for w in frequent} | {int(np.frombuffer(r["a"], U)[0]): list(r)[1:] for r in middles}
    return Model(folder, bits, of_often, of_pairs, of_words)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        ids, tok, ats, held = [], [], [np.zeros(1, np.int64)], 0

        def flush():
            made = reader.score(np.concatenate(tok), np.concatenate(ats))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(x) for x in made)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for batch, data, off in chunks(batches):
            t, at = tokens(data, off)
            ids.append(batch.column(0))
            tok.append(t)
            ats.append(at[1:] + held)
            held += len(t)
            if held >= SCORED:
                yield flush()
                ids, tok, ats, held = [], [], [np.zeros(1, np.int64)], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def score_corpus(docs: DataFrame, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row; the model is
    trained on the rows whose crc32(id as text) mod folds is not 0."""
    model = train(docs.where(~held_out(id_col, folds)).select(text_col))
    made = score(docs, model, id_col, text_col)
    return made.select("doc_id", held_out("doc_id", folds).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))
