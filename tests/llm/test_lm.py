import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from termweave.llm import lm as L


def toks(t):
    return [*(t or "").encode().lower().split(), None]


class Brute:
    """The trigram model by its definition."""

    def __init__(self, texts):
        self.c, self.uni = Counter(), Counter()
        for t in texts:
            w = ["begin", "begin", *toks(t)]
            self.c.update(zip(w[:-2], w[1:-1], w[2:], strict=True))
            self.uni.update(w[2:])
        self.k2 = Counter((v, w) for _, v, w in self.c)
        self.k1 = Counter(w for _, w in self.k2)
        self.D = [L.discounts(*(sum(x == i for x in c.values()) for i in (1, 2, 3, 4))) for c in (self.c, self.k2, self.k1)]
        self.at, self.mid = defaultdict(list), defaultdict(list)
        for (u, v, _), n in self.c.items():
            self.at[u, v].append(n)
        for (v, _), n in self.k2.items():
            self.mid[v].append(n)
        self.K = len(self.k2)
        self.floor = sum(self.D[2][min(x, 3)] for x in self.k1.values())
        self.n, self.v = sum(self.uni.values()), len(self.uni)

    def p1(self, w):
        if not self.K:
            return 1.0
        return (max(self.k1[w] - self.D[2][min(self.k1[w], 3)], 0) + self.floor / (self.v + 1)) / self.K

    @staticmethod
    def higher(count, seen, d, lower):
        return (max(count - d[min(count, 3)], 0) + sum(d[min(x, 3)] for x in seen) * lower) / sum(seen) if seen else lower

    def p(self, u, v, w):
        two = self.higher(self.k2[v, w], self.mid.get(v), self.D[1], self.p1(w))
        return self.higher(self.c[u, v, w], self.at.get((u, v)), self.D[0], two)

    def score(self, t):
        w = ["begin", "begin", *toks(t)]
        base = sum(math.log10((self.uni[x] + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in w[2:])
        known = {}
        log = lambda g: known[g] if g in known else known.setdefault(g, math.log10(self.p(*g)))
        return len(w) - 2, sum(x in self.uni for x in w[2:]), base, sum(map(log, zip(w[:-2], w[1:-1], w[2:], strict=True)))


def same(rows, docs):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    model = Brute([t for d, t in docs if not held(d)])
    cache = {}
    want = sorted((str(d), *cache.setdefault(t, model.score(t)), held(d)) for d, t in docs)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score, r.held_out) for r in rows)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[5] == w[5] and g[3] == pytest.approx(w[3], abs=1e-6) and g[4] == pytest.approx(w[4], abs=1e-6)
    assert {r.train_tokens for r in rows} == {model.n}
    return model


def test_equals_brute_force(spark):
    texts = ["the cat sat", "The cat  sat on\nthe mat", None, "", "a b a b a b", "the " * 3000, "é é ê", "the cat sat"]
    docs = [(i, texts[i % len(texts)]) for i in range(60)] + [(None, "new words here"), (3, "the dog")]
    model = same(L.score_corpus(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, score int").repartition(3)).collect(), docs)
    for u, v in (("begin", "begin"), (b"the", b"cat"), ("unseen", b"a"), ("unseen", "unseen")):  # distributions over the training tokens and one unknown
        assert sum(model.p(u, v, w) for w in model.uni) + model.p(u, v, b"unknown") == pytest.approx(1)


def test_frequent_words_are_dealt_over_shards(spark):
    """A word in a third of all places, and many shards."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["the", "the", rng.choice("abcdefgh"), f"w{rng.randrange(200)}"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    old, L.SHARD = L.SHARD, 400
    try:
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        assert len(L.train(df.select("text")).often) > 0
        same(L.score_corpus(df).collect(), docs)
    finally:
        L.SHARD = old


def test_empty_and_untrained(spark):
    assert L.score_corpus(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = L.score_corpus(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows] == [(3, 0, 0, 0.0)]


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = L.op6_lm_scoring(spark, "/root/testdata/sf0.01").collect()
    same(rows, docs)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_more_words_than_fit_a_number(monkeypatch):
    """Trigrams are summed alike where the words of a task are too many for one number of three."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(12))) for _ in range(60)] + ["", "a a a a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])

    def made():
        rows = [r for out in L.summed_trigrams(L.np.zeros(0, L.U), 2)(iter([batch])) for r in out.to_pylist()]
        return sorted((r["shard"], *map(int, x)) for r in rows for x in zip(*L.opened(r["n"], r["words"], r["entries"]), strict=True))

    one = made()
    monkeypatch.setattr(L, "NARROW", 3)
    assert made() == one and sum(x[-1] for x in one) == sum(len(t.split()) + 1 for t in texts)


def test_common_words_are_sent_by_rank():
    """Blocks hold the same trigrams whichever words are common, in fewer bytes than with a hash for each word."""
    import pyarrow as pa

    rng = random.Random(6)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.7)), 3000)}" for _ in range(rng.randrange(60))) for _ in range(400)] + ["", "w1 w1 w1 w1", "w2999"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    known, count = L.counted(L.tokens(*L.chunks(iter([batch]), text=0).__next__()[1:])[0])
    ranked = known[L.np.argsort(-count.astype(L.np.int64), kind="stable")]

    def made(common):
        rows = [r for out in L.summed_trigrams(L.np.zeros(0, L.U), 2, common)(iter([batch])) for r in out.to_pylist()]
        return sorted((r["shard"], *map(int, x)) for r in rows for x in zip(*L.opened(r["n"], r["words"], r["entries"], common), strict=True)), sum(len(r["words"]) for r in rows)

    none, plain = made(L.NONE)
    tokens_of = [[int(L.BEGIN)] * 2 + list(map(int, L.tokens(L.np.frombuffer(t.encode(), L.np.uint8), L.np.array([0, len(t)]))[0])) for t in texts]
    want = Counter(g for t in tokens_of for g in zip(t[:-2], t[1:-1], t[2:], strict=True))
    assert Counter({x[1:4]: x[4] for x in none}) == want and len(none) == len(want)
    for common in (ranked, ranked[:50], L.np.append(L.mix(ranked[:9]), ranked[:200])):
        assert made(common)[0] == none
    assert made(ranked)[1] < 0.4 * plain


def test_arrays_take_one_byte_a_row_and_two_a_bucket(tmp_path):
    """Rows of more than 255 kinds, keys dealt evenly and not; each key finds its row and others none."""
    rng = L.np.random.default_rng(7)
    for name, keys in (("even", L.mix(L.np.arange(70_000, dtype=L.U))), ("uneven", L.np.arange(1, 70_001, dtype=L.U) << L.U(24)), ("one", L.np.array([5], L.U)), ("none", L.np.zeros(0, L.U))):
        keys, n = L.np.sort(keys), len(keys)
        rows = [L.np.where(rng.random(n) < 0.9, 1, rng.integers(0, 10**6, n)), rng.integers(0, 3, n)]
        L.saved_keys(str(tmp_path), name, keys)
        L.saved_rows(str(tmp_path), name, *rows)
        assert (L.looked_up(str(tmp_path), name, keys, 2) == rows).all()
        assert not L.looked_up(str(tmp_path), name, keys + L.U(1 << 45), 2).any()
    assert (tmp_path / "even.rows").stat().st_size == 70_000
    assert (tmp_path / "even.at").stat().st_size <= 2 * (70_000 / 4 + 1)
