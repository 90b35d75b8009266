import hashlib
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from termweave.llm import merkle as M

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, arity):
    """The root of a list of digests, and for each the siblings level by level, left and right of it."""
    proofs, place, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(place):
            run = p - p % arity
            proofs[i].append((level[run:p], level[p + 1 : run + arity]))
            place[i] = p // arity
        level = [H(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], proofs


def brute(rows, arity):
    """(doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, siblings)."""
    named = [(r, H(*map(field, r))) for r in rows]
    key = lambda x: (x[0][2] is not None, (x[0][2] or "").encode())
    groups = [sorted(g, key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for _, g in groupby(sorted(named, key=key), key)]
    subtrees = [tree([leaf for _, leaf in g], arity) for g in groups]
    root, above = tree([s for s, _ in subtrees], arity) if subtrees else ("", [])
    return [(r[0], leaf, sub, root, [*p, *up]) for g, (sub, proofs), up in zip(groups, subtrees, above, strict=True) for (r, leaf), p in zip(g, proofs, strict=True)]


def check(spark, rows, arity, parts=3):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx int").repartition(parts)
    leaf = M.digest(*(M.field(F.col(c)) for c in M.FIELDS))
    out = M.manifest(df, "lang", "doc_id", leaf, {"size": F.lit(4)}, arity)
    out = out.withColumn("folded", M.fold(F.col("leaf"), F.col("steps"))).withColumn("wrong", M.fold(F.lit(H("other")), F.col("steps")))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, sibs) for r, sibs in ((r, r.sibs) for r in out.withColumn("sibs", M.siblings(F.col("steps"))).collect())]
    want = brute(rows, arity)
    assert sorted(map(repr, got)) == sorted(repr((*w[:4], "".join("".join(a) + "".join(b) for a, b in w[4]))) for w in want)
    for r in out.collect():
        assert r.folded == r.root and r.wrong != r.root and r.size == 4


def made(rng, n, langs):
    return [(rng.randrange(n * 2), rng.choice(["s1", "", None]), rng.choice(langs), rng.choice([None, 0, 5]), rng.choice(["é日\n", "", None, "text"])) for _ in range(n)]


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_equals_the_plain_tree(spark, arity):
    rng = random.Random(arity)
    rows = made(rng, 75, ["en", "en", "en", "", "é", "z", None])
    rows += [rows[0]] * 20 + [(None, None, None, None, None)] * 2 + [(10**6, "s", "alone", 1, "only row"), (10**6 + 1, "s", "en", 1, "long " * 30_000)]
    check(spark, rows, arity)


def test_few_rows(spark):
    for n in (1, 2, 3):
        check(spark, [(i, "s", "en", i, "t") for i in range(n)], 2, 1)
    check(spark, [(1, "s", "en", 1, "t"), (2, "s", "de", 1, "t")], 2)
    empty = spark.createDataFrame([], "doc_id long, lang string")
    out = M.manifest(empty, "lang", "doc_id", M.field(F.col("doc_id")))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "steps"] and out.collect() == []
    with pytest.raises(ValueError):
        M.manifest(empty, "lang", "doc_id", M.field(F.col("doc_id")), arity=1)


def test_a_group_with_nearly_all_rows_is_dealt_out(spark):
    """Equal rows too come to lie in several partitions."""
    df = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit("en").alias("name"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed, runs = M.laid(df, ["name"], ["doc_id"], [])
        sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) > 4 and max(sizes) < 8_000
    idx = sorted(r.idx for r in M.ranked(placed, runs, ["name"]).select("idx").collect())
    assert idx == list(range(20_000))
