import hashlib
import random
from collections import Counter

import numpy as np

from termweave.llm import repeats as R


def brute(texts, length=400, keep_first=False):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out, before = [], set()
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            s = r[i : i + length]
            if s in before if keep_first else seen[s] > 1:
                gone[i : i + length] = True
            before.add(s)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def repeated_words(texts, words=50):
    """How many words of each text are in strings of so many words that start elsewhere too, and their longest stretch."""
    rows = [(t or "").encode().lower().split() for t in texts]
    seen = Counter(tuple(r[i : i + words]) for r in rows for i in range(len(r) - words + 1))
    out = []
    for r in rows:
        hit = np.zeros(len(r), bool)
        for i in range(len(r) - words + 1):
            if seen[tuple(r[i : i + words])] > 1:
                hit[i : i + words] = True
        out.append((int(hit.sum()), max(map(len, "".join("x" if h else " " for h in hit).split()), default=0)))
    return out


def made(seed, n):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices("abcdeé \n", k=k))
    shared = [word(k) for k in (380, 399, 400, 401, 460, 900, 1500)]
    texts = []
    for _ in range(n):
        texts.append("".join(rng.choice([word(rng.randrange(300)), rng.choice(shared), rng.choice(shared)[rng.randrange(60) :]]) for _ in range(rng.randrange(5))))
    texts += [texts[0], texts[1], texts[1], "z" * 1200, "ab" * 700, None, "", word(399)]
    for t in rng.sample(texts[:n], n // 4):
        cut = rng.randrange(len(t) + 1)
        texts.append(t[:cut] + "XY" + t[cut + 1 :])
    return texts


def answers(df, **k):
    rows = R.find_repeats(df, **k).orderBy("row").collect()
    sha = lambda r: hashlib.sha256(bytes(r.kept)).hexdigest() if r.kept is not None else bytes(r.digest).hex()
    return [r.doc_id for r in rows], [(r.n_bytes, r.n_removed, r.n_spans, sha(r)) for r in rows]


def test_equals_brute_force(spark):
    texts = made(1, 120)
    ids = [i if i % 7 else None for i in range(len(texts))]
    spark.createDataFrame([(i, t, 9) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, row int").coalesce(1).write.parquet(path := __import__("tempfile").mkdtemp(prefix="spark-") + "/d")
    df = spark.read.parquet(path)
    old = R.PACK, R.SHARD
    R.PACK, R.SHARD = 5000, 2000
    try:
        assert answers(df) == (ids, brute(texts))
    finally:
        R.PACK, R.SHARD = old
    assert answers(df, keep_first=True) == (ids, brute(texts, keep_first=True))
    assert answers(df.limit(0)) == ([], [])


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = R.op9_suffix_array_dedup(spark, sf).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    said = {r.doc_id: (r.repeated_words, r.longest_repeat) for r in rows}
    assert said == dict(zip([d.doc_id for d in docs], repeated_words([d.text for d in docs]), strict=True))
    assert got == dict(zip([d.doc_id for d in docs], brute([d.text for d in docs]), strict=True))


def test_passages_of_words(spark):
    rng = random.Random(5)
    word = lambda k: [f"v{rng.randrange(10**6)}" for _ in range(k)]
    passage, short = word(51), ["ab"] * 3 + word(60)
    texts = [" ".join([*word(40), *passage, *word(70)]), " ".join([*word(3), *map(str.upper, passage)]), " ".join(word(49)), " ".join(short), " ".join(short), None, "", " ".join(passage[:49]), " ".join(["z"] * 51), " ".join(word(30_000))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, grams string").repartition(3)
    got = {r.doc_id: (r.repeated_words, r.longest_repeat) for r in R.find_repeats(df).collect()}
    assert got == dict(enumerate(repeated_words(texts))) and got[0] == got[1] == (51, 51) and got[8] == (51, 51)


def test_rows_keep_their_numbers(spark):
    """A second scan that is split otherwise finds the same rows."""
    sf, name = "/root/testdata/sf0.01", "spark.sql.files.maxPartitionBytes"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.write.option("parquet.block.size", 200_000).parquet(path := __import__("tempfile").mkdtemp(prefix="spark-") + "/d")
    want = dict(zip((d := docs.collect()) and [r.doc_id for r in d], brute([r.text for r in d]), strict=True))
    before, written = spark.conf.get(name), R.written
    try:
        spark.conf.set(name, "64m")

        def other(*a, **k):
            out = written(*a, **k)
            spark.conf.set(name, "150k")
            return out

        R.written = other
        rows = R.find_repeats(spark.read.parquet(path)).collect()
    finally:
        R.written = written
        spark.conf.set(name, before)
    sha = lambda r: hashlib.sha256(bytes(r.kept)).hexdigest() if r.kept is not None else bytes(r.digest).hex()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, sha(r)) for r in rows} == want
