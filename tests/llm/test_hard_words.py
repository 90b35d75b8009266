"""Words that have one hash for every odd base, where polynomials are taken modulo 2**64, are told apart by all operators."""

import hashlib
import zlib

import numpy as np
import public_tokenizers

from termweave.llm import lm, neardup, packing, quality, repeats
from termweave.llm._text import LOWER, Sums

ORDER = [bin(i).count("1") % 2 for i in range(1024)]
ONE, TWO = "".join("ab"[b] for b in ORDER), "".join("ba"[b] for b in ORDER)


def test_the_words_would_collide():
    for base in (3, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
        assert len({sum(ord(c) * pow(base, i, 2**64) for i, c in enumerate(w)) % 2**64 for w in (ONE, TWO)}) == 1
    data = np.frombuffer((ONE + TWO).encode(), np.uint8)
    assert len(set(Sums(LOWER[data]).spans(np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 2


def test_near_duplicates(spark):
    df = spark.createDataFrame([(1, ONE), (2, TWO), (3, ONE), (4, f"{ONE} x"), (5, f"{TWO} x")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, shingle=4).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (1, 4), 5: (1, 5)}


def test_packing(spark):
    df = spark.createDataFrame([(1, ONE), (2, TWO), (3, f"{TWO} {ONE}")], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = packing.encoder(path).whole
    rows = packing.pack(df, path).collect()
    for d, t in ((1, ONE), (2, TWO), (3, f"{TWO} {ONE}")):
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert [(r.length, r.ids_crc32) for r in rows if r.doc_id == d] == [(len(ids), zlib.crc32(ids.tobytes()))]


def test_language_model(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10][:3]
    df = spark.createDataFrame([(held, TWO), *((i, f"{ONE} x") for i in train)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_corpus(df).collect()}
    assert got[held].n_known == 1  # the end alone
    assert got[train[0]].n_known == 3


def test_repeats(spark):
    df = spark.createDataFrame([(1, ONE), (2, TWO[:1023] + "c"), (3, ONE[:500])], "doc_id long, text string")
    raw = [ONE, TWO[:1023] + "c", ONE[:500]]
    starts = {}
    for i, t in enumerate(raw):
        for k in range(len(t) - 399):
            starts.setdefault(t[k : k + 400], []).append((i, k))
    for r in repeats.find_repeats(df).collect():
        t = raw[r.doc_id - 1]
        gone = np.zeros(len(t), bool)
        for s, at in starts.items():
            for i, k in at:
                if i == r.doc_id - 1 and len(at) > 1:
                    gone[k : k + 400] = True
        kept = "".join(c for c, g in zip(t, gone, strict=True) if not g)
        assert r.n_removed == gone.sum()
        assert (hashlib.sha256(bytes(r.kept)).digest() if r.kept is not None else bytes(r.digest)) == hashlib.sha256(kept.encode()).digest()


def test_quality(spark):
    df = spark.createDataFrame([(1, f"{ONE} {TWO}"), (2, f"{ONE} {ONE}")], "doc_id long, text string")
    rows = df.mapInArrow(quality.features, "doc_id long, features array<float>").collect()
    at = quality.NAMES.index("distinct")
    assert {r.doc_id: r.features[at] for r in rows} == {1: 1.0, 2: 0.5}
