import random
from collections import defaultdict

from termweave.llm import neardup as N


def sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(ids, texts, k, percent=80):
    """Components by comparing every pair."""
    s = sets(texts, k)
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    where = defaultdict(list)
    for i, x in enumerate(s):
        for e in x:
            where[e].append(i)
    for i, x in enumerate(s):
        both = defaultdict(int)
        for e in x:
            for j in where[e]:
                if j < i:
                    both[j] += 1
        for j, n in both.items():
            if 100 * n >= percent * (len(x) + len(s[j]) - n):
                up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(s[i]), least[find(i)]) for i, d in enumerate(ids)}


def corpus(seed, n, edits):
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(3000)]
    bases = [rng.choices(v, k=rng.choice([2, 3, 4, 5, 8, 20, 60, 200, 900])) for _ in range(n)]
    texts = [" ".join(b) for b in bases]
    for _ in range(3 * n):
        b = list(rng.choice(bases[: n // 3]))
        for _ in range(rng.randrange(1 + len(b) // edits)):
            b[rng.randrange(len(b))] = rng.choice(v)
        texts.append(rng.choice([" ", "\n", "\t "]).join(b).upper() if rng.random() < 0.2 else " ".join(b))
    common = rng.choices(v, k=60)
    texts += [" ".join(common + rng.choices(v, k=rng.randrange(60, 200))) for _ in range(n)]
    rng.shuffle(texts)
    return texts


def test_components_equal_brute_force(spark):
    for seed, edits in ((1, 45),):
        texts = corpus(seed, 150, edits)
        ids = random.Random(seed).sample(range(10_000), len(texts))
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
        df.write.parquet(path := __import__("tempfile").mkdtemp(prefix="spark-") + "/d")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.read.parquet(path), 4).collect()}
        assert got == brute(ids, texts, 4)


def test_large_mixed_nodes_branch(spark):
    rng = random.Random(4)
    v = [f"w{i}" for i in range(500)]
    common = rng.choices(v, k=110)
    texts = [" ".join(common + rng.choices(v, k=60)) for _ in range(420)]
    texts += [" ".join([*texts[i].split()[:-3], "a", "b", "c"]) for i in range(40)]
    old, N.BLOCK, N.FEW = (N.BLOCK, N.FEW), 4, 4
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, 4).collect()}
    finally:
        N.BLOCK, N.FEW = old
    assert got == brute(range(len(texts)), texts, 4)


def test_rows(spark):
    rows = [(7, "a b c d e f"), (3, "A b  c d e f"), (3, "A b  c d e f"), (None, "a b c d e f"), (None, "only here no id"), (1, None), (2, ""), (5, "x"), (6, "X"), (9, "long " * 60_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, component_id string").coalesce(1)
    got = sorted(map(str, (tuple(r) for r in N.near_duplicates(df, 4).collect())))
    want = [(7, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (None, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (5, 1, 5, True), (6, 1, 5, False), (9, 1, 9, True)]
    assert got == sorted(map(str, want))
    kept = N.stage(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "None", "1", "2", "5", "9"])
    assert N.near_duplicates(df.limit(0)).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.op5_minhash_near_dedup(spark, sf).collect()}
    assert got == brute([r.doc_id for r in rows], [r.text for r in rows], 4)
