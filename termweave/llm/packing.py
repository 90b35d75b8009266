"""Operator 4, best-fit packing: patterns of few pieces whose lengths fill a sequence, with repeat counts fitted to the
length histogram by non-negative least squares, rounded, and the residual packed best fit.

Only the histogram (at most ``size`` rows, whatever the corpus) reaches the driver. The plan it makes says how often
each pattern repeats; pieces find their places by (length, rank among pieces of that length), so the assignment is one
join with the plan. Ranks are counted per (length, salt) and shifted by prefix sums, and the join is by (length, run of
``RUN`` ranks), in which few slots lie: no length, however common, is ranked or placed in one task, and no piece meets
all slots of its length.

Defined results: null or empty text is one piece that holds only the end id; every row of the input is packed, so
repeated rows and null ids are too; an empty table gives an empty result; other columns are ignored; a text longer
than ``size`` is cut into full pieces and a last one.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termweave.llm._spark import removed, table, written
from termweave.llm._text import Sums, U, mix

END = 0  # the id behind each document
SLICE = 1 << 20  # characters of text that are encoded together
RANKED = 10_000  # pieces that one task ranks, about
RUN = 4096  # ranks of a length that are placed together
UNSURE = 255
KEPT = 1 << 21  # pre-tokens whose ids a worker keeps; beyond that it starts anew
#: White space of Unicode
BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class Encoder:
    """The ids of many texts at once: pre-tokens are found and hashed with numpy; each distinct one is split into
    pieces once by the tokenizer's own model. Texts with an added token's string are left to the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        old = unicodedata.ucd_3_2_0.category  # what Unicode has added since, libraries may read differently
        self.kinds = np.array([UNSURE if old(c := chr(i)) == "Cn" or old(c) != unicodedata.category(c) else {"L": 1, "N": 2}.get(old(c)[0], 3) for i in range(0x110000)], np.uint8)
        self.kinds[BLANKS] = 0
        self.marks = mix(np.arange(1, 0x10001, dtype=U) * U(0x2545F4914F6CDD1D))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in plain]
        self.bytes = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}
        self.forget()

    def forget(self):
        self.keys, self.at, self.size, self.ids = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def clean(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if (self.kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] == UNSURE).any():
            return self.whole.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def ask(self, code: int) -> int:
        """The kind of a character as the tokenizer itself has it."""
        cuts = [len(self.whole.pre_tokenizer.pre_tokenize_str(f"{x}{chr(code)}{x}")) for x in "a!"]
        return 1 if cuts[0] == 1 else 3 if cuts[1] == 1 else 2 if cuts[0] == 3 else 0

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the pre-tokens 's 't 're 've 'm 'll 'd, letters, single numbers, other signs."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[cp]
        if (unsure := kind == UNSURE).any():
            asked, back = np.unique(cp[unsure], return_inverse=True)
            kind[unsure] = np.array([self.ask(c) for c in asked.tolist()], np.uint8)[back]
        start = kind != 0
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        quote = np.flatnonzero((cp == 39) & start)
        if len(quote):
            padded = np.append(cp, [32, 32, 32]).astype(np.uint32)
            a, b = padded[quote + 1], padded[quote + 2]
            short = np.isin(a, [ord(c) for c in "stmd"])
            long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            n = np.where(short, 2, np.where(long, 3, 0))
            quote, n = quote[n > 0], n[n > 0]
            start[quote + 1] = False
            after = quote + n
            after = after[after < len(cp)]
            start[after] = kind[after] != 0
        solid = kind != 0
        s = np.flatnonzero(start)
        last = solid.copy()
        last[:-1] &= ~solid[1:] | start[1:]
        e = np.flatnonzero(last) + 1
        return s, e, Sums(self.marks[cp & 0xFFFF] + (cp >> 16).astype(U) * U(0x9E3779B97F4A7C15)).spans(s, e)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self.keys) + len(keys) > KEPT:
            self.forget()
        found = [[t.id for t in self.model.tokenize("".join(map(self.bytes.__getitem__, w.encode("utf-8", "surrogatepass"))))] for w in words]
        size = np.array([len(x) for x in found], np.int64)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
        keys, at, size = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.size, size])
        order = np.argsort(keys)
        self.keys, self.at, self.size = keys[order], at[order], size[order]

    def place(self, keys: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return np.where(self.keys[i] == keys, i, -1) if len(self.keys) else np.full(len(keys), -1)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        import pandas as pd

        special = {i: np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if any(s in t for s in self.special)}
        clean = ["" if i in special else self.clean(t) for i, t in enumerate(texts)]
        joined = " ".join(clean)
        ends = np.cumsum([len(t) + 1 for t in clean])
        s, e, h = self.spans(joined)
        if not len(s):
            return [special.get(i, np.zeros(0, np.uint32)) for i in range(len(texts))]
        code, keys = pd.factorize(h)
        place = self.place(keys)
        if len(new := np.flatnonzero(place < 0)):
            top = np.maximum.accumulate(code)
            first = np.flatnonzero(np.concatenate(([True], top[1:] > top[:-1])))
            if len(self.keys) + len(new) > KEPT:
                self.forget()
                new = np.arange(len(keys))
            self.learn(keys[new], [joined[s[i] : e[i]] for i in first[new]])
            place = self.place(keys)
        size, at = self.size[place][code], self.at[place][code]
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(at - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        cut = np.concatenate(([0], stop))[np.searchsorted(s, ends)]
        out = np.split(ids, cut[:-1])
        return [special.get(i, x) for i, x in enumerate(out)]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(docs: DataFrame, path: str, size: int) -> DataFrame:
    """(doc_id, text) to the pieces (doc_id, piece, start, length, ids_crc32)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            a = 0
            while a < len(texts):
                b, held = a + 1, len(texts[a])
                while b < len(texts) and held + len(texts[b]) < SLICE:
                    held += len(texts[b])
                    b += 1
                rows = []
                for i, ids in enumerate(encoder(path).encode(texts[a:b]), a):
                    raw = memoryview(np.append(ids, np.uint32(END)).astype("<u4").tobytes())
                    n = len(raw) // 4
                    rows += [(i, k // size, k, min(size, n - k), zlib.crc32(raw[4 * k : 4 * (k + size)])) for k in range(0, n, size)]
                a = b
                own, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All ways to fill a sequence exactly with one, two or three of the lengths, as rows padded with 0."""
    lengths = np.sort(lengths[lengths > 0])
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    out = [np.array([[size, 0, 0]])] if there[size] else []
    two = lengths[(lengths <= size // 2) & there[np.clip(size - lengths, 0, size)]]
    out.append(np.stack([size - two, two, np.zeros_like(two)], 1))
    for a in lengths[lengths * 3 <= size]:
        b = lengths[(lengths >= a) & (lengths <= (size - a) // 2)]
        b = b[there[size - a - b]]
        out.append(np.stack([size - a - b, b, np.full_like(b, a)], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fitted(pats: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts whose use of each length is nearest to the histogram, by accelerated projected
    gradient. Long pieces weigh more: short ones fill gaps later."""
    size = len(histogram) - 1
    weight = np.linspace(0.1, 1.0, size + 1)
    weight[0] = 0
    weight[1:] /= np.maximum(histogram[1:], 1)  # relative residuals
    touched = np.bincount(pats.ravel(), minlength=size + 1).astype(float)
    touched[0] = 1
    # the largest length use of a pattern, over which steps are scaled: a diagonal bound of the Hessian
    scale = (weight[pats] * touched[pats]).sum(1)
    scale[scale == 0] = 1
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        use = np.bincount(pats.ravel(), np.repeat(y, pats.shape[1]), size + 1)
        slope = (weight * (use - histogram))[pats].sum(1)
        new = np.maximum(0, y - slope / scale)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use the histogram up exactly; histogram[n] is the number of pieces of length n."""
    size, left, out = len(histogram) - 1, histogram.astype(np.int64).copy(), []
    pats = patterns(np.flatnonzero(left), size)
    if len(pats):
        x = fitted(pats, left.astype(float))
        for rounding in (np.floor, np.ceil):
            want = rounding(x).astype(np.int64)
            for i in np.argsort(-x, kind="stable")[: int((want > 0).sum())]:
                p = [n for n in pats[i].tolist() if n]
                k = min(int(want[i]), *(int(left[n]) // p.count(n) for n in set(p)))
                if k > 0:
                    for n in p:
                        left[n] -= k
                    out.append((tuple(p), k))
    # the residual: longest first, into the open sequences with the least room that fits
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]
    for n in range(size, 0, -1):
        k, r = int(left[n]), n
        while k:
            while r <= size and not room[r]:
                r += 1
            if r > size:
                fits = size // n
                full, rest = divmod(k, fits)
                if full:
                    room[size - fits * n][(n,) * fits] = room[size - fits * n].get((n,) * fits, 0) + full
                if rest:
                    room[size - rest * n][(n,) * rest] = room[size - rest * n].get((n,) * rest, 0) + 1
                break
            p, there = next(iter(room[r].items()))
            m = min(k, there)
            room[r][p] -= m
            if not room[r][p]:
                del room[r][p]
            q = (*p, n)
            room[r - n][q] = room[r - n].get(q, 0) + m
            k -= m
            r = min(r, max(n, r - n)) if r - n >= n else r
    return out + [(p, k) for kinds in room for p, k in kinds.items()]


def slots(made: list[tuple[tuple[int, ...], int]], size: int) -> pa.Table:
    """(length, low, n, sequence, offset): in which sequences, from the first on, the pieces of a length stand whose ranks
    are low .. low + n - 1."""
    used, out, sequence = [0] * (size + 1), [], 0
    for p, k in made:
        offset = 0
        for n in p:
            out.append((n, used[n], k, sequence, offset))
            used[n] += k
            offset += n
        sequence += k
    columns = np.array(out, np.int64).reshape(-1, 5).T
    return pa.table(dict(zip(("length", "low", "n", "sequence", "offset"), columns, strict=True)))


def pack(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of at most ``size`` ids."""
    spark, stored = docs.sparkSession, []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = written(cut(rows, path, size), "pieces", stored)
    histogram = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``size`` rows
        histogram[r["length"]] = r["count"]
    places = spark.createDataFrame(slots(plan(histogram), size))
    salts = max(1, int(histogram.sum()) // RANKED + 1)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = salted.withColumn("within", within).join(before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    run = lambda c: F.floor(c / RUN)
    where = places.select("*", F.explode(F.sequence(run(F.col("low")), run(F.col("low") + F.col("n") - 1))).alias("run"))
    met = ranked.withColumn("run", run(F.col("rank"))).join(where, ["length", "run"]).where("rank >= low and rank < low + n")
    out = written(met.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"), "packed")
    removed(spark, stored)
    return out


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
