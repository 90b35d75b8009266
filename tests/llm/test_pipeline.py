import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import test_decontamination as D
import test_neardup as N
import test_quality as Q
import test_secrets as S
from tokenizers import Tokenizer

from termweave.llm import decontamination, neardup, packing, quality, secrets


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = start = spark.read.parquet(f"{sf}/documents.parquet").cache()
    kept = []
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, sf), name)
        assert docs.schema == start.schema
        kept.append({r.doc_id: r for r in docs.collect()})
        assert len(kept[-1]) == docs.count()
    good, apart, clean, masked = kept
    ids = {r.doc_id for r in quality.op2_quality_classifier(spark, sf).where("predicted = 1").collect()}
    assert set(good) == ids
    one = neardup.near_duplicates(start.where(start.doc_id.isin([*good])), 5).where("kept").collect()
    assert set(apart) == {r.doc_id for r in one}
    leaks = {r.doc_id for r in decontamination.find_leaks(start, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert set(clean) == set(apart) - leaks and leaks & set(apart)
    assert set(masked) == set(clean)
    for d, r in masked.items():
        assert not secrets.strong(r.text) or secrets.MASK in r.text
        assert r.n_chars == (len(r.text) if secrets.MASK in r.text else start_chars(clean, d))
    pieces = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == set(masked)
    assert len({r.sequence_id for r in pieces}) <= sum(r.length for r in pieces) / 2048 * 1.02 + 1


def start_chars(rows, d):
    return rows[d].n_chars


def test_run(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and packing.op4_best_fit_packing(spark, "/root/testdata/sf0.001").count() > len(rows)


def leaks_of(text, items):
    """Whether some item overlaps the text, by all alignments with items that share four words in a row with it: where a
    stretch of 13 words has two differences, four words in a row agree."""
    grams = lambda w: {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    own = grams(D.words(text))
    return any((len(D.words(s)) < 13 or own & grams(D.words(s))) and D.brute(text, s) for s in items)


def masked_plainly(text):
    """The text with its spans cut out, by the brute force of the secrets' own test."""
    out, at = [], 0
    spans = sorted((int(a), int(b)) for a, b in (s.split(":")[1:] for s in S.brute(text).split(",") if s))
    for a, b in spans:
        if a >= at:
            out += [text[at:a], secrets.MASK]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def test_all_stages_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()]
    docs, labels = read("documents", "doc_id", "text"), read("labels", "doc_id", "quality")
    scores = Q.plain_scores(docs, labels)
    good = [(d, t) for d, t in docs if scores[d] >= 0.3]
    groups = N.brute([d for d, _ in good], [t for _, t in good], 5)
    apart = [(d, t) for d, t in good if groups[d][1] == d or not groups[d][0]]
    items = [t for (t,) in read("benchmark", "text")]
    clean = [(d, t) for d, t in apart if not leaks_of(t, items)]
    want = {d: masked_plainly(t) for d, t in clean}
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = P.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(want) and len(good) < len(docs) and len(apart) < len(good)
    for d, t in want.items():
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d)
        assert pieces == [(i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for i, a in enumerate(range(0, len(ids), 2048))]
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([a for a, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 2048 for s in held.values())


def test_odd_rows_pass_all_stages(spark):
    """Null texts and ids, empty texts, repeated rows, columns that clash with helper names, and an empty table."""
    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40).collect()
    rows = [(r.doc_id, r.text, 77, 78, "s", "w", 5) for r in base] + [(None, None, 1, 2, None, "x", 0), (None, "", 1, 2, "y", None, 0), (base[0].doc_id, base[0].text, 3, 4, "z", "z", None), (10**9, "word " * 60_000, 9, 9, "l", "l", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, _row int, spans string, whole string, n_chars int")
    for docs in (df, df.limit(0)):
        for name, stage in P.STAGES[:-1]:
            docs = P.written(stage(spark, docs, sf), name)
            assert docs.columns == df.columns
            for r in docs.collect():
                assert (r.row, r._row) in {(x[2], x[3]) for x in rows}
        assert {r.doc_id for r in P.STAGES[-1][1](spark, docs, sf).collect()} == {r.doc_id for r in docs.collect()}
