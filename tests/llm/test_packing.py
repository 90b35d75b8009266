import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ 's't're'll\n\t1٣²ΣİǅßéÀ日😀<|endoftext|>._-'\x1c\x85　") | st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=4))
def test_ids_are_the_tokenizers(texts):
    texts.append("it's <|endoftext|> we'll")
    e = K.encoder(PATH)
    assert [x.tolist() for x in e.encode(texts)] == [list(e.whole.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_uses_the_histogram_up(lengths):
    histogram = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, np.int64)
    made = K.plan(histogram)
    used = np.zeros(65, np.int64)
    for p, k in made:
        assert sum(p) <= 64 and k > 0
        for n in p:
            used[n] += k
    assert (used == histogram).all()
    assert sum(k for _, k in made) <= max(1.25 * sum(lengths) / 64 + 2, sum(n > 32 for n in lengths) * 1.2 + 2)


def check(docs, rows, size):
    e = K.encoder(PATH)
    want = []
    for d, t in docs:
        ids = [*e.whole.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d, k // size, k, len(x := ids[k : k + size]), zlib.crc32(np.array(x, "<u4").tobytes())) for k in range(0, len(ids), size)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_rows(spark):
    docs = [(1, "one two three"), (None, None), (2, ""), (1, "one two three"), (3, "word " * 300), (4, "é" * 50)]
    df = spark.createDataFrame([(d, t, "x", 5) for d, t in docs], "doc_id long, text string, salt string, length int")
    check(docs, K.pack(df, PATH, 64).collect(), 64)


def test_empty_table(spark):
    assert K.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = K.op4_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    n = check([(r.doc_id, r.text) for r in docs], rows, 2048)
    assert n <= sum(r.length for r in rows) / 2048 * 1.02 + 1
