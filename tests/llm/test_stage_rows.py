"""The stages judge each row by itself, whatever its id."""

import random

import pytest

from termweave.llm import decontamination, neardup, quality

SF = "/root/testdata/sf0.01"
AGAIN = 10**9


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def staged(spark, stage, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, at int").repartition(3).cache()
    kept = stage(spark, df, SF)
    assert kept.columns == df.columns
    return sorted(r["at"] for r in kept.collect())


def test_quality(spark, documents):
    n = len(documents)
    rows = documents + [(None, t) for _, t in documents] + [(AGAIN, t) for _, t in documents]
    kept = staged(spark, quality.stage, rows)
    first = [i for i in kept if i < n]
    assert 0 < len(first) < n
    assert kept == first + [i + n for i in first] + [i + 2 * n for i in first]


def test_decontamination(spark):
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    clean = "nothing of this stands in any of the tests"
    assert staged(spark, decontamination.stage, [(None, item), (None, clean), (7, clean), (7, f"so {item}"), (8, clean)]) == [1, 2, 4]
    assert staged(spark, decontamination.stage, [(None, clean), (7, clean)]) == [0, 1]


def test_near_dedup(spark):
    rng = random.Random(2)
    one, two = ([f"{c}{rng.randrange(10**6)}" for _ in range(200)] for c in "ab")
    edited = lambda words, i: " ".join([*words[:-1], f"end{i}"])
    nulls = [(None, edited(one, i)) for i in range(5)]
    assert len(staged(spark, neardup.stage, nulls)) == 1
    under_one_id = [(1, edited(one, 0)), (1, edited(two, 0)), (2, edited(one, 1)), (3, edited(two, 1)), (None, edited(two, 2)), (None, ""), (None, None)]
    assert staged(spark, neardup.stage, under_one_id) == [0, 1, 5, 6]
    df = spark.createDataFrame(under_one_id, "doc_id long, text string").coalesce(1)
    assert [r.component_id for r in neardup.near_duplicates(df).collect()].count(1) == 5
