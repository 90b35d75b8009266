import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.llm import toxicity as T
from termweave.llm._text import chunks


def keys(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    return [T.keys_of(data, off) for _, data, off in chunks(iter([batch]), text=0)]


def folded(text):
    """Words as runs of letters: A-Z and a-z, and all beyond ASCII."""
    return re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abAB é日😀.-1\n", max_size=30), min_size=1, max_size=5))
def test_keys_are_words_and_their_beginnings(texts):
    names, n = {}, 0
    for hashes, over, first, size in keys(texts):
        words = [w for t in texts for w in folded(t)]
        assert first.tolist() == [sum(len(folded(t)) for t in texts[:i]) for i in range(len(texts) + 1)]
        assert size.tolist() == [len(w.encode()) for w in words]
        for i, w in enumerate(words):
            for r, k in enumerate(T.BEGINNINGS):
                assert (hashes[r, i] > 0) == (len(w) >= k)
                if len(w) >= k:
                    assert names.setdefault(int(hashes[r, i]), (k, w[:k])) == (k, w[:k])
                    assert over[r, i] == (hashes[r - 1, i] if r else 0)
            assert names.setdefault(int(hashes[-1, i]), ("all", w)) == ("all", w)
            longest = [int(hashes[r, i]) for r in range(len(T.BEGINNINGS)) if hashes[r, i] > 0]
            assert over[-1, i] == (longest[-1] if longest else 0)
            n += 1
    assert len(set(names.values())) == len(names)


def test_a_lexicon_has_one_key_of_a_word():
    known = np.array([10, 11, 12, 13, 20, 21], np.uint64)  # 10 > 11 > 12 are beginnings of one another, 20 > 21 too
    over = np.array([0, 10, 11, 0, 0, 20], np.uint64)
    pos, neg = np.array([40, 40, 30, 90, 30.0, 30]), np.array([0, 0, 0, 900, 200.0, 0])
    assert T.lexicon(known, over, pos, neg, 100, 1000).tolist() == [10, 21]
    assert T.lexicon(known, over, pos, neg, 100, 1000, most=1).tolist() == [10]


def test_ratio_is_the_likelihood_ratio():
    a, b, n, m = 7, 3, 20, 40
    log = lambda k, t, p: k * np.log(p) + (t - k) * np.log(1 - p)
    want = 2 * (log(a, n, a / n) + log(b, m, b / m) - log(a, n, 10 / 60) - log(b, m, 10 / 60))
    assert abs(T.ratio(np.array([a]), np.array([b]), n, m)[0] - want) < 1e-9


def test_the_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(3)
    n, truth = 6000, None
    truth = (rng.random(n) < 0.3).astype(int)
    right = [0.9, 0.8, 0.7, 0.75]
    said = [np.where(rng.random(n) < p, truth, 1 - truth) * 2 - 1 for p in right]
    said.append(np.where(rng.random(n) < 0.97, said[2], -said[2]))  # all but a copy of the third
    v = np.stack(said, 1).astype(np.int8)
    v[rng.random(n) < 0.2, 0] = 0
    y = np.where(np.arange(n) < 300, truth, np.nan)
    m = T.estimate(v, y)
    r = m.posterior(v)
    assert abs(m.prior - 0.3) < 0.05
    got = m.accuracies(v, r)
    assert np.abs(got - np.array([*right, 0.7])).max() < 0.06
    assert m.parent[4] == 2 or m.parent[2] == 4
    # the copy adds next to nothing: the model agrees with the true posterior of independent voters
    odds = np.log(0.3 / 0.7) + sum(v[:, j] * np.log(p / (1 - p)) for j, p in enumerate(right))
    assert np.abs(r - 1 / (1 + np.exp(-odds))).mean() < 0.06
    labelled = ~np.isnan(y)
    assert ((m.posterior(v, y)[labelled] > 0.5) == (truth[labelled] == 1)).all()


def test_logistic_is_the_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    r = 1 / (1 + np.exp(-(x @ [1.0, -2, 0] + 0.5)))
    m = T.logistic(x, r, np.ones(400), penalty=1e-6)
    assert np.abs(m.score(x) - r).max() < 1e-4


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0


def test_held_out_rows_of_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    got = T.op13_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    rows = [r for r in got if r.held_out]
    hit = sum(r.toxic and r.predicted for r in rows)
    assert sum(r.predicted and not r.toxic for r in rows) <= 2
    assert hit >= 0.9 * sum(r.toxic for r in rows)


def test_held_out_labels_are_never_read(spark):
    docs = [(i, ("vile grubnik here " if i % 3 == 0 else "fine weather today ") * (1 + i % 4)) for i in range(200)]
    labels = [(i, int(i % 3 == 0)) for i in range(200)]
    turned = [(d, 1 - y if held(d) else y) for d, y in labels]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = ([tuple(r) for r in T.classify(df, spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("doc_id").collect()] for x in (labels, turned))
    assert a == b
    assert all(p == int(d % 3 == 0) for d, _, _, p in a)


def test_odd_rows(spark):
    docs = [(i, "you grubnik!! " * 3 if i % 2 else "quiet lines of text\n") for i in range(60)]
    docs += [(None, "grubnik " * 5), (None, None), (100, None), (101, ""), (102, "grubnik " * 100_000), (103, "calm " * 100_000), (104, "x" * 300_000), (1, docs[1][1])]
    labels = [(i, i % 2) for i in range(60)] + [(5, None), (None, 1), (7, 1), (9999, 1)]
    df = spark.createDataFrame([(*d, 0.1, "fr") for d in docs], "doc_id long, text string, score double, y string").repartition(3)
    rows = T.classify(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == len(docs) and sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in docs)
    at = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert at[102].predicted == 1 and at[103].predicted == 0 and at[101].predicted == 0 and at[100].score == at[101].score
    assert len({r.score for r in rows if r.doc_id == 1}) == 1


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)])
def test_labels_of_one_kind_or_none(spark, labels, score):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "doc_id long, text string")
    rows = T.classify(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == 3 and {r.score for r in rows} == {score}
    assert T.classify(df.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() == []
