import itertools
import random
import re

import regex

from termweave.llm import decontamination as D


def words(t):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]


def brute(doc, item):
    """Whether some alignment has a stretch that agrees enough: all alignments are tried."""
    a, b = words(doc), words(item)
    if len(b) < D.LEAST or not set(a) & set(b):
        return False
    w = min(D.WINDOW, len(b))
    for d in range(-len(b), len(a)):
        same = [a[p + d] == b[p] for p in range(max(0, -d), min(len(b), len(a) - d))]
        if sum(same) * 100 >= D.PERCENT * w and any(100 * sum(same[i : i + w]) >= D.PERCENT * w for i in range(len(same) - w + 1)):
            return True
    return False


def test_masks_miss_nothing():
    for n in range(D.LEAST, D.WINDOW + 1):
        wrong = n * (100 - D.PERCENT) // 100
        masks = D.masks_of(n, D.PERCENT)
        for gone in itertools.combinations(range(n), wrong):
            assert any(all(m[k] == "0" for k in gone) for m in masks)
        assert min(m.count("1") for m in masks) >= (n - wrong) // 2


def test_every_place_of_a_seed(spark):
    rng = random.Random(1)
    a = [f"a{i}" for i in range(10)]
    between, behind = [f"b{i}" for i in range(10)], ["c0", "c1", "c2"]
    item = " ".join([*a, *between, *a, *behind])
    later = [*a, *behind]
    later[1], later[6] = "x", "y"
    d = spark.createDataFrame([(1, " ".join(later)), (2, " ".join(rng.sample(later, 13)))], "doc_id long, text string")
    assert [(r.doc_id, r.doc_word, r.matched) for r in D.find_leaks(d, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [(1, -20, 11)]


def test_rows(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 6, 9, 10, 11, 12, 15, 40])))) for i in range(40)] + [(90, None), (91, "")]
    docs = []
    for i in range(120):
        text = rng.choices(vocabulary, k=rng.randrange(60))
        if i % 3:
            part = words(rng.choice(items[:40])[1])
            part = part[rng.randrange(3) :]
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = "other" if part else part
            text[10:10] = part
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text).upper() if i % 2 else " ".join(text)))
    docs += [(None, items[3][1] * 1), (200, None), (201, ""), (5, docs[5][1]), (300, "x " * 40_000 + (items[4][1] or ""))]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").coalesce(2)
    b = spark.createDataFrame([(*r, "t") for r in items], "item_id long, text string, doc_id string")
    got = sorted(str((r.doc_id, r.item_id)) for r in D.find_leaks(d, b).collect())
    assert got == sorted(str((x, i)) for x, t in docs for i, s in items if brute(t, s)) and len(got) > 30
    assert D.find_leaks(d.limit(0), b).collect() == D.find_leaks(d, b.limit(0)).collect() == []
    D_BLOCK, D.BLOCK = D.BLOCK, 100
    try:
        assert sorted(str((r.doc_id, r.item_id)) for r in D.find_leaks(d, b).collect()) == got
    finally:
        D.BLOCK = D_BLOCK


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows, tests = docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect()
    got = {(r.doc_id, r.item_id) for r in D.op7_benchmark_decontamination(spark, sf).collect()}
    squeeze = lambda t: re.sub(r"\s+", " ", t)
    whole = {(d, i) for d, t in rows for i, s in tests if squeeze(s) in squeeze(t)}
    assert whole <= got and len(whole) > 5
    assert all(brute(next(t for d, t in rows if d == x), next(s for i, s in tests if i == y)) for x, y in got)
    kept = D.stage(spark, docs, sf)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got}
