"""Operator 8, document fingerprints by prefix polynomial hashes.

Prefix arrays modulo two primes (random bases, a random value for each code point) give the hash of any span of a text by
one subtraction and one product for each prime: ``Prefixes`` answers span equality with them and finds longest common
extensions by binary search, for many pairs of places at once. A fingerprint is the hash of the whole text and, of the
hashes of all its spans of ``GRAM`` code points, 16 bits of the least in each of ``WIDTH`` parts of the hash range; the
share of parts in which two fingerprints agree estimates the resemblance J of their span sets, and their likeness is
2 J / (1 + J), the share of spans in common. Where both texts are at hand, ``prefix_edited``, ``prefix_next``,
``suffix_edited`` and ``suffix_next`` say exactly how long their longest common extensions from the start, and back from
the end, are.

``edited`` pairs each text with the next by id: texts are shuffled once, by range of id, and sorted; each task pairs
neighbours as they pass and holds two texts. Only the first and the last text of a partition are passed on, to be
paired across partitions by a join; after the last comes the first.

Defined results: a null text counts as empty, whose fingerprint is zeros and is like itself and nothing else; rows
without an id come after all others, rows of one id in the order of the input; every row gives a row; a single row is
its own next; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termweave.llm._spark import table, written
from termweave.llm._text import MODULI, U, mix, powers_of

GRAM = 24
WIDTH = 128
SLICE = 1 << 20  # code points that are hashed together
MARKS = mix(np.arange(1, 0x10001, dtype=U) * U(0x9FB21C651E98DF25))
LENDERS = np.argsort(np.random.default_rng(77).random((WIDTH, WIDTH)), axis=1)
EMPTY = "0" * (16 + 4 * WIDTH)


class Prefixes:
    """Prefix hashes of a text or of several texts one behind the other."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(points)
        marks = MARKS[points & 0xFFFF] + (points >> 16).astype(U) * U(0xC2B2AE3D27D4EB4F)
        self.sums, self.back = [], []
        for (prime, base), mark in zip(MODULI, (marks & U(0x3FFFFFFF), marks >> U(34)), strict=True):
            sums = np.zeros(self.n + 1, U)
            np.cumsum(mark * powers_of(prime, base, self.n) % U(prime), out=sums[1:])  # below 2**31 each: no overflow in a text
            self.sums.append(sums)
            self.back.append(powers_of(prime, pow(base, -1, prime), self.n + 1))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The two residues of each span and its length, in 64 bits; equal for equal spans wherever they stand."""
        one, two = ((sums[ends] - sums[starts]) % U(prime) * back[starts] % U(prime) for (prime, _), sums, back in zip(MODULI, self.sums, self.back, strict=True))
        return mix((one << U(32) | two) + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))

    def equal(self, i: int, j: int, n: int, other: Prefixes | None = None) -> bool:
        """Whether n code points from i are those from j (of the other text)."""
        o = other or self
        return i + n <= self.n and j + n <= o.n and self.spans(np.array([i]), np.array([i + n]))[0] == o.spans(np.array([j]), np.array([j + n]))[0]

    def extensions(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, other: Prefixes | None = None, back: bool = False) -> np.ndarray:
        """For each pair of places how many code points from i on are those from j on (of the other text), at most ``most``;
        with ``back``, how many before i are those before j."""
        o, low, high = other or self, np.zeros(len(i), np.int64), np.array(most, np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            a, b = (self.spans(i - middle, i), o.spans(j - middle, j)) if back else (self.spans(i, i + middle), o.spans(j, j + middle))
            low, high = np.where(a == b, middle, low), np.where(a == b, high, middle - 1)
        return low

    def extension(self, i: int, j: int, other: Prefixes | None = None) -> int:
        """How many code points from i on are those from j on (of the other text)."""
        return int(self.extensions(np.array([i]), np.array([j]), np.array([min(self.n - i, (other or self).n - j)]), other)[0])


def common(a: list[str], b: list[str]) -> tuple[list[int], list[int]]:
    """How long the common beginning, and the common end, of each pair of texts is."""
    p, q = Prefixes("".join(a)), Prefixes("".join(b))
    n, m = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    ends, ends_of = np.cumsum(n), np.cumsum(m)
    most = np.minimum(n, m)
    return p.extensions(ends - n, ends_of - m, most, q).tolist(), p.extensions(ends, ends_of, most, q, True).tolist()


def fingerprints(texts: list[str]) -> list[str]:
    out, a = [], 0
    while a < len(texts):
        b, held = a + 1, len(texts[a])
        while b < len(texts) and held + len(texts[b]) <= SLICE:
            held += len(texts[b])
            b += 1
        p = Prefixes("".join(texts[a:b]))
        ends = np.cumsum([len(t) for t in texts[a:b]])
        starts = np.concatenate(([0], ends[:-1]))
        whole = p.spans(starts, ends)
        at = np.arange(max(0, p.n - GRAM + 1))
        grams = p.spans(at, at + GRAM) if len(at) else np.zeros(0, U)
        for s, e, h in zip(starts.tolist(), ends.tolist(), whole.tolist(), strict=True):
            if s == e:
                out.append(EMPTY)
                continue
            own = np.sort(grams[s : e - GRAM + 1]) if e - s >= GRAM else np.array([h], U)
            edges = np.searchsorted(own, np.arange(WIDTH, dtype=U) << U(57))
            full = np.append(edges[1:], len(own)) > edges
            if not full.all():
                edges = np.where(full, edges, edges[LENDERS[np.arange(WIDTH), full[LENDERS].argmax(1)]])
            out.append(f"{h:016x}" + (own[edges] >> U(32)).astype(">u2").tobytes().hex())
        a = b
    return out


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    if EMPTY in (a, b):
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(s[16:]), np.uint16) for s in (a, b))
    j = float((x == y).mean())
    return 2 * j / (1 + j)


def replaced(text: str, following: str) -> str:
    """text with its last quarter replaced by as many code points of the following one's start, or all."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


EXTENSIONS = ["prefix_edited", "suffix_edited", "prefix_next", "suffix_next"]
COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, " + ", ".join(f"{c} long" for c in EXTENSIONS)
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), *[pa.int64()] * len(EXTENSIONS)]


def results(texts: list[str], prints: list[str], following: list[str], next_prints: list[str]) -> list[pa.Array]:
    edited = [replaced(t, f) for t, f in zip(texts, following, strict=True)]
    own = fingerprints(edited)
    extended = [*common(texts, edited), *common(texts, following)]
    rows = [(len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, likeness(p, q), likeness(p, n)) for t, e, p, q, n in zip(texts, edited, prints, own, next_prints, strict=True)]
    return [pa.array(c, k) for c, k in zip([*(zip(*rows, strict=True) if rows else [()] * 6), *extended], _KINDS, strict=True)]


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, doc_id, text) in order to the results of all rows but the last, and the ends of the partition: the text
    and fingerprint of its first row (end 0) and of its last (end 1)."""

    def made(part, ids, cols, end=None, text=None):
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), ids, *cols, pa.array([end] * n, pa.int32()), pa.array([text] * n, pa.string())], ["part", "doc_id", *(c.split()[0] for c in COLUMNS.split(", ")), "end", "text"])

    def only(print_):
        return [pa.array([x], k) for x, k in zip([None, None, print_, *[None] * (len(_KINDS) - 3)], _KINDS, strict=True)]

    last = None
    for batch in batches:
        a = 0
        texts = [t or "" for t in batch.column(2).to_pylist()]
        while a < len(texts):
            b, held = a + 1, len(texts[a])
            while b < len(texts) and held + len(texts[b]) <= SLICE:
                held += len(texts[b])
                b += 1
            ids, some, part = batch.column(1).slice(a, b - a), texts[a:b], batch.column(0)[0].as_py()
            prints = fingerprints(some)
            if last is None:
                yield made(part, ids.slice(0, 1), only(prints[0]), 0, some[0])
            else:
                ids, some, prints = pa.concat_arrays([last[0], ids]), [last[1], *some], [last[2], *prints]
            if len(some) > 1:
                yield made(part, ids.slice(0, len(some) - 1), results(some[:-1], prints[:-1], some[1:], prints[1:]))
            last, a = (ids.slice(len(some) - 1), some[-1], prints[-1]), b
    if last is not None:
        yield made(part, last[0], only(last[2]), 1, last[1])


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, fingerprint, next text, next fingerprint) to results."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), *results(*(c.to_pylist() for c in b.columns[1:]))], ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", made: list[str] | None = None) -> DataFrame:
    """doc_id and ``COLUMNS`` of every row of docs; with ``made``, which gets the table that the result is read from."""
    stored = [] if made is None else made
    rows = docs.select(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    order = ["none", "doc_id", "row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    made = written(placed.mapInArrow(neighbours, f"part int, doc_id {kind}, {COLUMNS}, end int, text string"), "fingerprints", stored, "zstd")  # halves hexadecimal digits
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    # numbers of the partitions that have rows: one small row each
    parts = made.where("end = 0").select("part")
    after = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"), F.min("part").over(Window.partitionBy()).alias("first")).select("part", F.coalesce("next", "first").alias("next"))
    heads = made.where("end = 0").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    tails = made.where("end = 1").select("part", "doc_id", "text", "fingerprint").join(after, "part").join(heads, "next")
    rest = tails.select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(across, f"doc_id {kind}, {COLUMNS}")
    return made.where("end is null").select("doc_id", *names).unionByName(rest)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
