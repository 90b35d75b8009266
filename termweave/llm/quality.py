"""Operator 2, quality classifier: a generalised additive model with pairwise interactions.

Features of each whole text are measured once, in vectorised passes over its bytes; whether two words are the same is
told with A-Z lower-cased. Shallow trees are boosted in
cycles, one feature after the other, then on the pairs with the most to gain; as each tree sees one feature or one
pair, the sum of its trees is a lookup table, and a score is an addition of table entries.

The model is fitted on the driver from at most ``sample`` labelled rows (default ``SAMPLE``), taken in the order of a
hash of their id; rows whose crc32(id as text) mod ``folds`` is 0 are held out and never seen. Everything else runs
over all rows.

Defined results: a null or empty text has features like any other and is scored; a null id counts as the id ''; every
row of the input gives a row; labels that are null are passed over; without labels of both kinds every score is the
share of label 1 (0.5 without any); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from termweave.llm._spark import table
from termweave.llm._text import LOWER, Sums, chunks, words

SAMPLE = 20_000  # labelled rows that the model is fitted on, at most
FOLDS = 5
THRESHOLD = 0.3
DIGITS = 9  # of a gain; equal ones go to the first cut, feature or pair
NAMES = ["log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "bar", "bang", "stop", "line_break", "wide", "distinct", "repeat", "top_word", "short", "capital", "longest_run"]
_CLASSES = np.zeros((256, 9))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*^~<>{}[]\\=+_@", b"|", b"!", b".,;:?", b"\n", bytes(range(128, 256)), b"abcdefghijklmnopqrstuvwxyz")):
    _CLASSES[list(_chars), _i] = 1


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, features); columns behind the text are kept."""
    for batch, data, off in chunks(batches):
        n = batch.num_rows
        out = np.zeros((n, len(NAMES)), np.float32)
        starts, ends, first = words(data, off)
        h = Sums(LOWER[data]).spans(starts, ends)
        size = ends - starts
        capital = np.isin(data[starts], np.arange(65, 91)) if len(starts) else np.zeros(0, bool)
        hist = np.stack([np.bincount(data[off[i] : off[i + 1]], minlength=256) for i in range(n)]) @ _CLASSES
        length = np.maximum(np.diff(off), 1)
        out[:, 0] = np.log1p(np.diff(off))
        out[:, 3] = hist[:, 0] / np.maximum(hist[:, 0] + hist[:, 8], 1)
        out[:, 4:11] = hist[:, 1:8] / length[:, None]
        for i in range(n):
            a, b = first[i], first[i + 1]
            if a == b:
                continue
            w, k = h[a:b], b - a
            out[i, 1] = np.log1p(k)
            out[i, 2] = min(size[a:b].mean(), 1e6)
            ordered = np.sort(w)
            at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
            out[i, 11] = (len(at) - 1) / k
            out[i, 13] = np.diff(at).max() / k
            same = w[1:] == w[:-1]
            out[i, 12] = same.mean() if k > 1 else 0
            out[i, 14] = (size[a:b] <= 3).mean()
            out[i, 15] = capital[a:b].mean()
            breaks = np.flatnonzero(np.concatenate(([True], ~same, [True])))
            out[i, 16] = np.log1p(np.diff(breaks).max())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(NAMES)).cast(pa.list_(pa.float32())), *batch.columns[2:]], ["doc_id", "features", *batch.schema.names[2:]])


@dataclass
class Additive:
    """Bin edges and lookup tables; a score is the sigmoid of their sum."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)], 1) if len(x) else np.zeros((0, len(edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, c = self.bins(x, self.edges), self.bins(x, self.coarse)
        total = np.full(len(x), self.base)
        for i, t in enumerate(self.tables):
            total += t[b[:, i]]
        for (i, j), t in self.pairs.items():
            total += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, lam: float, least: float) -> tuple[float, int]:
    """The best cut of a row of bins: its gain and where it is."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + lam) + gr**2 / (hr + lam) - g.sum() ** 2 / (h.sum() + lam), 0)
    gain = np.round(gain, DIGITS)
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray, lam: float, least: float) -> np.ndarray:
    """A tree of two levels over the bins of one feature, as its value in each bin."""
    out, parts = np.zeros(len(g)), [(0, len(g))]
    for _ in range(2):
        nxt = []
        for a, b in parts:
            gain, k = _split(g[a:b], h[a:b], lam, least)
            nxt += [(a, a + k), (a + k, b)] if gain > 1e-9 else [(a, b)]
        parts = nxt
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + lam)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, lam: float, least: float) -> tuple[float, np.ndarray]:
    """The best tree that cuts one of two features and then, on either side, the other; its gain and its values."""
    best, values, whole = 0.0, np.zeros(g.shape), g.sum() ** 2 / (h.sum() + lam)
    for flip in (False, True):
        G, H = (g.T, h.T) if flip else (g, h)
        for k in range(1, len(G)):
            total, out = 0.0, np.zeros(G.shape)
            for a, b in ((0, k), (k, len(G))):
                gs, hs = G[a:b].sum(0), H[a:b].sum(0)
                found, c = _split(gs, hs, lam, least)
                for s in (slice(0, c), slice(c, None)) if found > 0 else (slice(None),):
                    total += gs[s].sum() ** 2 / (hs[s].sum() + lam)
                    out[a:b, s] = -gs[s].sum() / (hs[s].sum() + lam)
            if (gain := round(total - whole, DIGITS)) > best:
                best, values = gain, (out.T if flip else out).copy()
    return best, values


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pairs: int = 6, pair_rounds: int = 20, rate: float = 0.15, bins: int = 48, coarse: int = 8, lam: float = 1.0, least: float = 2.0) -> Additive:
    """The model of features x and labels y (0 or 1)."""
    d = x.shape[1] if x.ndim == 2 else len(NAMES)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    cut = lambda n: [np.unique(np.quantile(x[:, i], np.linspace(0, 1, n + 1)[1:-1])) if len(y) else np.zeros(0) for i in range(d)]
    edges, rough = cut(bins), cut(coarse)
    m = Additive(float(np.log(p / (1 - p))), edges, [np.zeros(len(e) + 1) for e in edges], rough, {})
    if len(y) == 0 or y.min() == y.max():
        return m
    b, c, f = m.bins(x, edges), m.bins(x, rough), np.full(len(y), m.base)

    def slopes():
        q = 1 / (1 + np.exp(-f))
        return q - y, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for i in range(d):
            g, h = slopes()
            t = rate * _tree(np.bincount(b[:, i], g, len(edges[i]) + 1), np.bincount(b[:, i], h, len(edges[i]) + 1), lam, least)
            m.tables[i] += t
            f += t[b[:, i]]

    def grid(i, j, v):
        return np.bincount(c[:, i] * (len(rough[j]) + 1) + c[:, j], v, (len(rough[i]) + 1) * (len(rough[j]) + 1)).reshape(len(rough[i]) + 1, len(rough[j]) + 1)

    g, h = slopes()
    gains = {(i, j): _pair_tree(grid(i, j, g), grid(i, j, h), lam, least)[0] for i, j in combinations(range(d), 2)}
    for k in sorted(gains, key=lambda k: (-gains[k], k))[:pairs]:
        m.pairs[k] = np.zeros((len(rough[k[0]]) + 1, len(rough[k[1]]) + 1))
    for _ in range(pair_rounds):
        for (i, j), t in m.pairs.items():
            g, h = slopes()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, h), lam, least)[1]
            t += step
            f += step[c[:, i], c[:, j]]
    return m


def held_out(id_col: str, folds: int):
    """crc32(id as text) mod folds is 0; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; labels has the id and the label column."""
    return _classified(docs, labels, [], label, threshold, sample, folds, id_col, text_col)


def _classified(docs: DataFrame, labels: DataFrame, kept: list[Column], label: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """classify with further columns ``kept`` of docs, which go with their row: rows are measured and scored in one pass,
    once the model has been fitted on those drawn. Nothing is shuffled but ids and labels, and nothing is written."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *kept)
    measured = lambda *rest: StructType([source.schema[0], StructField("features", ArrayType(FloatType())), *rest])
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y")).where(F.col("y").isNotNull() & ~held_out("doc_id", folds))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    drawn = source.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "y")
    rows = drawn.mapInArrow(features, measured(StructField("y", DoubleType()))).toPandas().sort_values(["doc_id", "y"])
    x = np.array(rows["features"].tolist(), np.float64) if len(rows) else np.zeros((0, len(NAMES)))
    model = fit(x, (rows["y"].to_numpy() > 0.5).astype(float))

    def score(batches):
        for batch in features(batches):
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x)), *batch.columns[2:]], ["doc_id", "score", *batch.schema.names[2:]])

    rest = list(source.schema.fields[2:])
    scored = source.mapInArrow(score, StructType([source.schema[0], StructField("score", DoubleType()), *rest]))
    return scored.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(f.name for f in rest))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the classifier accepts."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    return _classified(docs, table(spark, sf_dir, "labels"), [whole]).where("predicted = 1").select(*(F.col(f"whole.`{c}`").alias(c) for c in docs.columns))
