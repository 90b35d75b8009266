"""Operator 13, toxicity by weak supervision.

Voters are found, not given. A lexicon is mined from the labelled sample: words, and beginnings of words, that toxic texts
hold far more often than others (by the log-likelihood ratio; of a word and its beginnings one stays). Each entry is a
voter that says toxic where it occurs more than by chance and nothing elsewhere; further voters look at how many entries a
text holds and how densely, or at patterns (shouting, exclamations, signs inside words), and may say either.

A generative label model explains all votes by a hidden class: for each class a tree of voters, in which a vote depends on
the class and on one other vote. The tree is the maximum spanning tree of the mutual information of votes within a class,
so that voters which say the same are not counted twice; its tables, the accuracies, are estimated by expectation
maximisation over labelled and unlabelled texts together, the latter with less weight. A given label anchors the classes:
votes may make it less sure but not overturn it. A linear classifier is then trained on the posterior labels, and scores
every text in one vectorised pass, with no shuffle.

The model is fitted on the driver from at most ``sample`` labelled texts and ``unlabelled`` others (taken in the order of a
hash of their id, from rows whose crc32(id as text) mod ``folds`` is not 0). Everything else runs over all rows.

Defined results: a null or empty text has no votes but is scored like any other; a null id counts as the id '' for
drawing; every row gives a row, repeated rows equal ones; null labels are passed over; without labels of both kinds every
score is the share of label 1 (0.5 without any); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from termweave.llm._spark import removed, table, written
from termweave.llm._text import LOWER, Sums, U, chunks, distinct, mix, owners
from termweave.llm.quality import held_out

SAMPLE = 20_000  # labelled texts that the model is fitted on, at most
UNLABELLED = 10_000  # further texts that the label model sees, at most
FOLDS = 5
THRESHOLD = 0.5
BEGINNINGS = (4, 5, 6, 7)  # code points of a word's beginnings
CANDIDATES = 50_000  # keys of toxic texts that are counted in the others, at most: those that most toxic texts hold
LEXICON = 128  # entries, at most
SUPPORT = 3  # toxic texts of the sample that hold an entry, at least
LEAST_G = 20.0  # log-likelihood ratio of an entry, at least
TRUST = 0.98  # that a given label is right
LEEWAY = 3.0  # log odds by which all votes together move a given label, at most
UNSURE = 0.3  # weight of a text without a label beside one with a label
OFTEN, DENSE = 2, 0.01  # hits, or hits a word, from which an entry says toxic
DIGITS = 9  # of what is compared; equal ones go to the first
PATTERNS = ["upper", "bang", "signs", "digits", "wide"]
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_IN = [np.isin(np.arange(256), list(x)) for x in (range(65, 91), b"!", b"#$%&*@^~_|", b"0123456789", range(128, 256))]


def keys_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word (a run of letters, A-Z lower-cased) and each of its keys, its beginnings and then itself: the key's
    hash, 0 where the word is shorter, one row a kind. The hashes of what each key extends, and each text's first word."""
    if not len(data):
        return np.zeros((len(BEGINNINGS) + 1, 0), U), np.zeros((len(BEGINNINGS) + 1, 0), U), np.zeros(len(off), np.int64), np.zeros(0, np.int64)
    solid, first = LETTER[data], np.zeros(len(data) + 1, bool)
    first[off] = True
    starts = np.flatnonzero(solid & (~np.concatenate(([False], solid[:-1])) | first[:-1]))
    ends = np.flatnonzero(solid & (~np.concatenate((solid[1:], [False])) | first[1:])) + 1
    points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    at = np.searchsorted(points, starts)
    sums = Sums(LOWER[data])
    out = np.zeros((len(BEGINNINGS) + 1, len(starts)), U)
    for r, k in enumerate(BEGINNINGS):
        stop = points[np.minimum(at + k, len(points) - 1)]
        long = (at + k < len(points)) & (stop <= ends)
        out[r, long] = sums.spans(starts[long], stop[long]) | U(1)
    out[-1] = mix(sums.spans(starts, ends)) | U(1)
    over = np.zeros_like(out)
    over[1:-1] = out[:-2]
    over[-1] = np.max(np.where(out[:-1] > 0, np.arange(len(BEGINNINGS))[:, None] + 1, 0), 0).astype(U)  # which beginning is the longest
    longest = over[-1].astype(np.int64)
    over[-1] = np.where(longest > 0, out[np.maximum(longest - 1, 0), np.arange(len(starts))], U(0))
    return out, over, np.searchsorted(starts, off), ends - starts


def in_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (key, over, n): how many of a chunk's texts hold each key, and the key that it extends."""
    for _, data, off in chunks(batches, text=0):
        keys, over, first, _ = keys_of(data, off)
        own = np.broadcast_to(owners(first), keys.shape)[keys > 0]
        flat, above = keys[keys > 0], over[keys > 0]
        order = np.lexsort((own, flat))
        flat, above, own = flat[order], above[order], own[order]
        new = np.concatenate(([True], (flat[1:] != flat[:-1]) | (own[1:] != own[:-1]))) if len(flat) else np.zeros(0, bool)
        flat, above = flat[new], above[new]
        at = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(flat[at].view(np.int64)), pa.array(above[at].view(np.int64)), pa.array(np.diff(np.append(at, len(flat))))], ["key", "over", "n"])


def counting(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts to (key, n): how many texts of a task hold each of the known keys (sorted)."""
        total = np.zeros(len(known), np.int64)
        for _, data, off in chunks(batches, text=0):
            keys, _, first, _ = keys_of(data, off)
            own = owners(first)
            for row in keys:
                at = np.minimum(np.searchsorted(known, row), len(known) - 1)
                hit = known[at] == row
                total += np.bincount(distinct(own[hit].astype(U) * U(len(known)) + at[hit].astype(U)) % U(len(known)), minlength=len(known)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(total[some])], ["key", "n"])

    return run


def ratio(a: np.ndarray, b: np.ndarray, n: float, m: float) -> np.ndarray:
    """The log-likelihood ratio G of a of n texts against b of m."""

    def part(k, total, p):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-300) / np.maximum(total * p, 1e-300)), 0)

    p = (a + b) / (n + m)
    return 2 * (part(a, n, p) + part(n - a, n, 1 - p) + part(b, m, p) + part(m - b, m, 1 - p))


def lexicon(keys: np.ndarray, over: np.ndarray, pos: np.ndarray, neg: np.ndarray, n: int, m: int, most: int = LEXICON) -> np.ndarray:
    """The keys (sorted) that say most for themselves; a key goes if it extends one that is chosen, or one that is chosen
    extends it."""
    g = np.round(ratio(pos, neg, n, m), DIGITS)
    good = (pos >= SUPPORT) & (g >= LEAST_G) & (pos * m > 2 * neg * n)
    above = dict(zip(keys.tolist(), over.tolist(), strict=True))

    def line(k):
        out = [k]
        while k := above.get(k, 0):
            out.append(k)
        return out

    lines = {i: line(int(keys[i])) for i in np.flatnonzero(good)}
    chosen, over_chosen = set(), set()
    for i in sorted(lines, key=lambda i: (-g[i], len(lines[i]), int(keys[i]))):
        if len(chosen) == most:
            break
        if not chosen.intersection(lines[i]) and int(keys[i]) not in over_chosen:
            chosen.add(int(keys[i]))
            over_chosen.update(lines[i])
    return np.array(sorted(chosen), U)


def measured(data: np.ndarray, off: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text how often it holds each entry, the number of its words, and the shares of its bytes in the patterns."""
    n = len(off) - 1
    keys, _, first, _ = keys_of(data, off)
    hits, own = np.zeros((n, len(known)), np.float32), owners(first)
    if len(known):
        for row in keys:
            at = np.minimum(np.searchsorted(known, row), len(known) - 1)
            hit = known[at] == row
            np.add.at(hits, (own[hit], at[hit]), 1)
    size = np.maximum(np.diff(off), 1)
    upto = [np.concatenate(([0], np.cumsum(x[data]))) for x in _IN]
    return hits, np.diff(first).astype(np.float32), np.stack([(u[off[1:]] - u[off[:-1]]) / size for u in upto], 1).astype(np.float32)


def votes(hits: np.ndarray, n_words: np.ndarray, patterns: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The votes of all voters on each text: 1 toxic, -1 not, 0 nothing. Entries come first; then how many different
    entries, how many hits, how dense (against two edges), none at all, some but thin; then the patterns."""
    words, total = np.maximum(n_words, 1), hits.sum(1)
    each, dense = ((hits >= OFTEN) | (hits >= DENSE * words[:, None]) & (hits > 0)).astype(np.int8), total / words
    say = lambda yes, no=False: np.where(yes, 1, np.where(no, -1, 0)).astype(np.int8)
    some, kinds = total > 0, (hits > 0).sum(1)
    more = [say(kinds >= 2), say(kinds >= 4), say(total >= 2), say(total >= 4), say(dense >= edges[0], ~some), say(dense >= edges[1], dense < edges[0]), say(False, ~some), say(False, some & (dense < edges[0]))]
    more += [say(patterns[:, 0] > 0.4), say(patterns[:, 1] > 0.02), say(patterns[:, 2] > 0.05), say(patterns[:, 3] > 0.2), say(False, patterns[:, 4] > 0.3)]
    return np.concatenate([each, np.stack(more, 1)], 1)


@dataclass
class LabelModel:
    """P(class) and, for each voter, P(vote | class, vote of its parent): a tree of voters within each class."""

    prior: float = 0.5
    parent: list[int] = field(default_factory=list)
    tables: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3, 3)))

    def log_odds(self, v: np.ndarray) -> np.ndarray:
        """What the votes of each row say, as the log odds of toxic."""
        x, out = v.astype(np.int64) + 1, np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for j, p in enumerate(self.parent):
            t = np.log(self.tables[j, 1] / self.tables[j, 0])
            out += t[x[:, p] if p >= 0 else 0, x[:, j]]
        return out

    def posterior(self, v: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        """P(toxic) of each row of votes; y holds given labels, nan where there is none."""
        a = self.log_odds(v)
        if y is not None:
            a = np.where(np.isnan(y), a, np.where(y == 1, 1, -1) * np.log(TRUST / (1 - TRUST)) + np.clip(a, -LEEWAY, LEEWAY))
        return 1 / (1 + np.exp(-np.clip(a, -50, 50)))

    def accuracies(self, v: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Of each voter the share of its votes that are right, by the posterior r."""
        right = (v == 1).T @ r + (v == -1).T @ (1 - r)
        return right / np.maximum((v != 0).sum(0), 1)


def correlated(onehot: np.ndarray, sides: tuple[np.ndarray, np.ndarray], voters: int) -> tuple[list[int], np.ndarray]:
    """Each voter's parent in the maximum spanning tree of mutual information within the classes (-1: the root), and that
    information; ``sides`` are the weights of the rows in either class."""
    info, all_of = np.zeros((voters, voters)), sides[0].sum() + sides[1].sum()
    for w in sides:
        total = w.sum()
        joint = ((onehot * w[:, None]).T @ onehot).reshape(voters, 3, voters, 3).transpose(0, 2, 1, 3) / total
        alone = np.einsum("jjaa->ja", joint)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = joint * np.log(joint / (alone[:, None, :, None] * alone[None, :, None, :]))
        info += total / all_of * np.where(joint > 0, part, 0).sum((2, 3))
    np.fill_diagonal(info, 0)
    info = np.round(info, DIGITS)
    parent, best, rest = [-1] * voters, np.full(voters, -1.0), np.ones(voters, bool)
    for _ in range(voters):
        i = int(np.where(rest, best, -2).argmax())
        rest[i] = False
        closer = rest & (info[i] > best)
        best[closer] = info[i][closer]
        for j in np.flatnonzero(closer):
            parent[j] = i
    return parent, info


def estimate(v: np.ndarray, y: np.ndarray, trees: int = 3, rounds: int = 6, weight: float = 1.0) -> LabelModel:
    """The label model of votes v and given labels y (nan where there is none), by expectation maximisation; ``weight`` is
    that of each table's prior, the voter's own shares in the class."""
    n, voters = v.shape
    onehot = (v[:, :, None] == np.array([-1, 0, 1])).astype(np.float64).reshape(n, -1)
    known = ~np.isnan(y)
    r, worth = np.where(y == 1, TRUST, 1 - TRUST), np.where(known, 1.0, 0.0)  # the first tables are those of the labelled rows
    m = LabelModel()
    for _ in range(trees):
        for k in range(rounds):
            sides = (worth * (1 - r), worth * r)
            if k == 0:
                parent, _ = correlated(onehot, sides, voters)
            m = LabelModel(float(np.clip(sides[1].sum() / worth.sum(), 1e-4, 1 - 1e-4)), parent, np.zeros((voters, 2, 3, 3)))
            for c, w in enumerate(sides):
                weighted = onehot * w[:, None]
                for j, p in enumerate(parent):
                    own = weighted[:, 3 * j : 3 * j + 3]
                    counts = onehot[:, 3 * p : 3 * p + 3].T @ own if p >= 0 else np.broadcast_to(own.sum(0), (3, 3))
                    back = (own.sum(0) + weight) / (own.sum() + 3 * weight)
                    m.tables[j, c] = (counts + weight * back) / (counts.sum(1, keepdims=True) + weight)
            r, worth = m.posterior(v, y), np.where(known, 1.0, UNSURE)
    return m


def inputs(hits: np.ndarray, n_words: np.ndarray, patterns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the linear classifier sees of each text; ``weights`` are those of the entries."""
    total, words, most = hits.sum(1), np.maximum(n_words, 1), hits.max(1, initial=0)
    strong = hits @ weights.astype(np.float32)
    out = [np.log1p(total), np.log1p(strong), np.log1p(most), np.sqrt(total / words), np.sqrt(strong / words), np.sqrt(most / words), (hits > 0).sum(1), np.log1p(n_words), total == 0, total == 1, most >= OFTEN]
    return np.concatenate([np.log1p(hits), np.stack(out, 1), patterns], 1).astype(np.float64)


@dataclass
class Linear:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.center) / self.scale @ self.weights + self.bias, -30, 30)))


def logistic(x: np.ndarray, r: np.ndarray, worth: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> Linear:
    """The linear classifier of inputs x, posterior labels r and weights of the rows, by Newton's method."""
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.concatenate([(x - center) / scale, np.ones((len(x), 1))], 1)
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        s = worth * np.maximum(p * (1 - p), 1e-5)
        step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(ridge), z.T @ (worth * (p - r)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Linear(center, scale, w[:-1], float(w[-1]))


@dataclass
class Toxicity:
    """A fitted model: the lexicon's keys and weights, the edges of the density voters, the label model, the classifier;
    ``share`` is every score where there is no classifier."""

    known: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    labels: LabelModel
    linear: Linear | None
    share: float

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.linear is None:
            return np.full(len(off) - 1, self.share)
        return self.linear.score(inputs(*measured(data, off, self.known), self.weights))


def fit(docs: DataFrame, labels: DataFrame, made: list[str], label: str = "toxic", sample: int = SAMPLE, unlabelled: int = UNLABELLED, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """The model of the labelled rows that are not held out, and of some that have no label."""
    c = lambda name: F.col(f"`{name}`")
    given = labels.select(c(id_col).alias("id"), c(label).cast("double").alias("y")).where(F.col("y").isNotNull() & ~held_out("id", folds)).groupBy("id").agg(F.max("y").alias("y"))
    ids = docs.select(c(id_col).alias("id")).where(~held_out("id", folds)).join(given, "id", "left")
    by = [F.xxhash64("id"), F.col("id")]
    drawn = ids.where("y is not null").distinct().orderBy(*by).limit(sample).unionAll(ids.where("y is null").distinct().orderBy(*by).limit(unlabelled))
    # at most sample + unlabelled rows of two numbers
    rows = docs.select(c(id_col).alias("id"), c(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "id")
    rows = written(rows, "sample", made, "zstd")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(k for y, k in sizes.items() if y is not None and y > 0.5)
    m = sum(k for y, k in sizes.items() if y is not None and y <= 0.5)
    nothing = Toxicity(np.zeros(0, U), np.zeros(0), np.zeros(2), LabelModel(), None, n / (n + m) if n + m else 0.5)
    if not n or not m:
        return nothing
    held = rows.where("y > 0.5").select("text").mapInArrow(in_toxic, "key long, over long, n long").groupBy("key").agg(F.sum("n").alias("n"), F.max("over").alias("over")).where(F.col("n") >= SUPPORT)
    found = held.orderBy(F.desc("n"), "key").limit(CANDIDATES).toPandas()
    keys = found["key"].to_numpy(np.int64).view(U)
    order = np.argsort(keys)
    keys, over, pos = keys[order], found["over"].to_numpy(np.int64).view(U)[order], found["n"].to_numpy(np.float64)[order]
    neg = np.zeros(len(keys))
    if len(keys):
        others = rows.where("y <= 0.5").select("text").mapInArrow(counting(keys), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
        neg[np.searchsorted(keys, others["key"].to_numpy(np.int64).view(U))] = others["n"]
    known = lexicon(keys, over, pos, neg, n, m)

    def measure(batches):
        for batch, data, off in chunks(batches, text=1):
            hits, words, patterns = measured(data, off, known)
            row = np.concatenate([hits, words[:, None], patterns], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in row], pa.binary())], ["id", "y", "row"])

    kind = rows.schema[0].dataType.simpleString()
    seen = rows.select("id", "text", "y").mapInArrow(measure, f"id {kind}, y double, row binary").toPandas().sort_values(["id", "y"], kind="stable")
    x = np.frombuffer(b"".join(seen["row"]), np.float32).reshape(len(seen), -1)
    hits, words, patterns = x[:, : len(known)], x[:, len(known)], x[:, len(known) + 1 :]
    y = seen["y"].to_numpy(np.float64)
    y = np.where(np.isnan(y), np.nan, y > 0.5)
    rate = [hits[y == c].sum(0) / max(words[y == c].sum(), 1) for c in (0, 1)]
    weights = np.log(np.maximum((rate[1] + 1e-6) / (rate[0] + 1e-6), 1.0))  # how much more often a word of a toxic text is this one
    dense = np.sort((hits.sum(1) / np.maximum(words, 1))[y == 1])
    edges = np.maximum(np.array([dense[int(len(dense) * q)] for q in (0.1, 0.5)]), 1e-6)
    v = votes(hits, words, patterns, edges)
    model = estimate(v, y)
    linear = logistic(inputs(hits, words, patterns, weights), model.posterior(v, y), np.where(np.isnan(y), UNSURE, 1.0))
    return Toxicity(known, weights, edges, model, linear, nothing.share)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE, unlabelled: int = UNLABELLED, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; labels has the id and the label column."""
    made: list[str] = []
    model = fit(docs, labels, made, label, sample, unlabelled, folds, id_col, text_col)
    removed(docs.sparkSession, made)

    def run(batches):
        for batch, data, off in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(data, off))], ["doc_id", "score"])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = source.mapInArrow(run, StructType([source.schema[0], StructField("score", DoubleType())]))
    return scored.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
