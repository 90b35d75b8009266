import math
import zlib
from collections import Counter
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa

from termweave.llm import quality as Q


def plain_features(text):
    """The features by their definition, one text at a time."""
    raw = (text or "").encode()
    words = [w for w in raw.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    count = lambda chars: sum(b in chars for b in raw)
    upper, lower = count(range(65, 91)), count(range(97, 123))
    n = max(len(raw), 1)
    out = [math.log1p(len(raw)), 0, 0, upper / max(upper + lower, 1), count(b"0123456789") / n, count(b"#$%&*^~<>{}[]\\=+_@") / n, count(b"|") / n, count(b"!") / n, count(b".,;:?") / n, count(b"\n") / n, count(range(128, 256)) / n, 0, 0, 0, 0, 0, 0]
    if words:
        folded = [w.lower() for w in words]  # bytes: A-Z alone
        k, seen = len(words), Counter(w.lower() for w in words)
        out[1], out[2] = math.log1p(k), min(sum(map(len, words)) / k, 1e6)
        out[11], out[13] = len(seen) / k, max(seen.values()) / k
        out[12] = sum(a == b for a, b in zip(folded[1:], folded[:-1], strict=True)) / (k - 1) if k > 1 else 0
        out[14], out[15] = sum(len(w) <= 3 for w in words) / k, sum(65 <= w[0] <= 90 for w in words) / k
        out[16] = math.log1p(max(len(list(g)) for _, g in groupby(folded)))
    return [float(np.float32(v)) for v in out]


class PlainModel:
    """The boosting written out: a row at a time, every cut tried by itself."""

    def __init__(self, x, y, rounds=120, pairs=6, pair_rounds=20, rate=0.15, bins=48, coarse=8, lam=1.0, least=2.0):
        self.lam, self.least = lam, least
        p = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
        self.base = math.log(p / (1 - p))
        cut = lambda n: [sorted(set(np.quantile([r[i] for r in x], np.linspace(0, 1, n + 1)[1:-1]).tolist())) for i in range(len(x[0]))]
        self.edges, self.rough = cut(bins), cut(coarse)
        self.tables = [[0.0] * (len(e) + 1) for e in self.edges]
        self.pairs = {}
        fine, wide = [self.bins(r, self.edges) for r in x], [self.bins(r, self.rough) for r in x]
        f = [self.base] * len(x)
        for _ in range(rounds):
            for i, table in enumerate(self.tables):
                values = self.tree(*self.sums(f, y, [(b[i],) for b in fine], (len(table),)))
                for k in range(len(table)):
                    table[k] += rate * values[k]
                f = [v + rate * values[b[i]] for v, b in zip(f, fine, strict=True)]
        shape = lambda i, j: (len(self.rough[i]) + 1, len(self.rough[j]) + 1)
        grids = lambda i, j: self.sums(f, y, [(b[i], b[j]) for b in wide], shape(i, j))
        gains = {(i, j): self.pair_tree(*grids(i, j), shape(i, j))[0] for i, j in combinations(range(len(self.tables)), 2)}
        chosen = sorted(gains, key=lambda k: (-gains[k], k))[:pairs]
        self.pairs = {k: {} for k in chosen}
        for _ in range(pair_rounds):
            for (i, j), table in self.pairs.items():
                step = self.pair_tree(*grids(i, j), shape(i, j))[1]
                for cell, v in step.items():
                    table[cell] = table.get(cell, 0.0) + rate * v
                f = [v + rate * step.get((b[i], b[j]), 0.0) for v, b in zip(f, wide, strict=True)]

    @staticmethod
    def bins(row, edges):
        return [sum(v >= e for e in es) for v, es in zip(row, edges, strict=True)]

    @staticmethod
    def sums(f, y, cells, shape):
        g, h = {}, {}
        for v, t, c in zip(f, y, cells, strict=True):
            q = 1 / (1 + math.exp(-v))
            g[c], h[c] = g.get(c, 0.0) + q - t, h.get(c, 0.0) + max(q * (1 - q), 1e-6)
        if len(shape) == 1:
            return [g.get((k,), 0.0) for k in range(shape[0])], [h.get((k,), 0.0) for k in range(shape[0])]
        return g, h

    def best_cut(self, g, h):
        best, at = 0.0, None
        for k in range(1, len(g)):
            gl, hl, gr, hr = sum(g[:k]), sum(h[:k]), sum(g[k:]), sum(h[k:])
            gain = gl**2 / (hl + self.lam) + gr**2 / (hr + self.lam) - sum(g) ** 2 / (sum(h) + self.lam) if hl >= self.least and hr >= self.least else 0
            if round(gain, 9) > best:
                best, at = round(gain, 9), k
        return best, at

    def tree(self, g, h):
        parts = [(0, len(g))]
        for _ in range(2):
            new = []
            for a, b in parts:
                gain, k = self.best_cut(g[a:b], h[a:b])
                new += [(a, a + k), (a + k, b)] if k and gain > 1e-9 else [(a, b)]
            parts = new
        out = [0.0] * len(g)
        for a, b in parts:
            out[a:b] = [-sum(g[a:b]) / (sum(h[a:b]) + self.lam)] * (b - a)
        return out

    def pair_tree(self, g, h, shape):
        best, values = 0.0, {}
        whole = sum(g.values()) ** 2 / (sum(h.values()) + self.lam)
        for flip in (False, True):
            n, m = shape[::-1] if flip else shape
            at = (lambda d, r, c: d.get((c, r), 0.0)) if flip else (lambda d, r, c: d.get((r, c), 0.0))
            for k in range(1, n):
                total, out = 0.0, {}
                for rows in (range(k), range(k, n)):
                    gs, hs = ([sum(at(d, r, c) for r in rows) for c in range(m)] for d in (g, h))
                    _, c = self.best_cut(gs, hs)
                    for side in ((range(c), range(c, m)) if c else (range(m),)):
                        a, b = sum(gs[x] for x in side), sum(hs[x] for x in side)
                        total += a**2 / (b + self.lam)
                        out |= {(x, r) if flip else (r, x): -a / (b + self.lam) for r in rows for x in side}
                if round(total - whole, 9) > best:
                    best, values = round(total - whole, 9), out
        return best, values

    def score(self, row):
        b, c = self.bins(row, self.edges), self.bins(row, self.rough)
        total = self.base + sum(t[k] for t, k in zip(self.tables, b, strict=True)) + sum(t.get((c[i], c[j]), 0.0) for (i, j), t in self.pairs.items())
        return 1 / (1 + math.exp(-min(max(total, -30), 30)))


def plain_scores(docs, labels):
    """The score of each document (id, text), learned from the labelled ones that are not held out."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0
    rows = {d: plain_features(t) for d, t in docs}
    known = sorted((d, q) for d, q in labels if q is not None and not held(d) and d in rows)
    model = PlainModel([rows[d] for d, _ in known], [q for _, q in known])
    return {d: model.score(r) for d, r in rows.items()}


def test_equals_the_plain_model(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    want = plain_scores(docs, labels)
    got = {r.doc_id: r for r in Q.op2_quality_classifier(spark, sf).collect()}
    assert got.keys() == want.keys()
    for d, s in want.items():
        assert abs(got[d].score - s) < 1e-6 and got[d].predicted == (s >= 0.3)


def test_features_of_odd_texts():
    texts = ["", None, "Wörd", "a a a b", " \n ", "X|Y!! 1#" * 400_000]
    got = pa.Table.from_batches(list(Q.features(iter([pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["doc_id", "text"])]))))
    rows = [dict(zip(Q.NAMES, r, strict=True)) for r in got["features"].to_pylist()]
    assert got["doc_id"].to_pylist() == list(range(6))
    assert rows[0] == rows[1] and all(np.isfinite(list(r.values())).all() for r in rows)
    assert rows[3]["distinct"] == 0.5 and rows[3]["top_word"] == 0.75 and abs(rows[3]["repeat"] - 2 / 3) < 1e-6
    assert rows[4]["log_words"] == 0 and rows[5]["bar"] == 0.125


def test_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.fit(x, y, pairs=1)
    assert list(m.pairs) == [(0, 1)] and ((m.score(x) > 0.5) == y).mean() > 0.95
    assert Q.fit(np.zeros((0, 17)), np.zeros(0)).score(np.zeros((2, 17))).tolist() == [0.5, 0.5]
    assert Q.fit(np.zeros((3, 17)), np.ones(3)).score(np.zeros((1, 17)))[0] > 0.9


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a", 3), (1, "a", 3), (None, None, 4), (5, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rows = Q.classify(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "5", "None"] and all(0 <= r.score <= 1 for r in rows)
    assert {str(r.doc_id): r.held_out for r in rows} == {"1": zlib.crc32(b"1") % 5 == 0, "5": zlib.crc32(b"5") % 5 == 0, "None": True}
    assert Q.classify(docs.limit(0), labels.limit(0)).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in Q.op2_quality_classifier(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i].predicted, q) for i, q in labels.items() if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert len(held) > 300 and np.mean([p == q for p, q in held]) > 0.97
    kept = Q.stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.predicted}
