"""Versions of datasets, pages of the graph, and the lookup of genomes."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from termweave.operators import evidence, graph, lookup
from termweave.sources.datasets import Datasets


@pytest.fixture
def store(spark):
    return Datasets(spark, tempfile.mkdtemp(prefix="spark-"))


def values(df):
    return sorted(r.x for r in df.collect())


def test_a_new_version_takes_the_place_of_the_old(spark, store):
    numbers = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    store.save("a", {"records": numbers(1, 2), "fields": numbers(9)}, name="first")
    old = store.load("a")
    made = store.save("a", {"records": numbers(3)}, name="second")
    assert (made["number"], made["rows"], made["about"]) == (2, {"records": 1}, {"name": "second"})
    assert values(store.load("a")) == [3] and values(old) == [1, 2]
    with pytest.raises(KeyError):
        store.load("a", "fields")
    assert store.tidy("a") == 1 and store.tidy("a") == 0 and values(store.load("a")) == [3]
    assert store.save("a", {"records": numbers()})["number"] == 3 and values(store.load("a")) == []


def test_a_failed_write_leaves_the_old_version(spark, store):
    store.save("a", {"records": spark.range(2).select(F.col("id").alias("x"))})
    bad = spark.range(2000).select(F.when(F.col("id") == 1999, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        store.save("a", {"first": spark.range(1), "records": bad})
    assert values(store.load("a")) == [0, 1] and store.manifest("a")["number"] == 1
    assert len(os.listdir(f"{store.root}/data/a")) == 1


def test_of_two_writers_one_fails(spark, store):
    store.save("a", {"records": spark.range(1).select(F.col("id").alias("x"))})
    late = Datasets(spark, store.root)
    late._number = lambda dataset: 0  # has looked before the other published
    with pytest.raises(RuntimeError, match="another writer"):
        late.save("a", {"records": spark.range(5).select(F.col("id").alias("x"))})
    assert values(store.load("a")) == [0] and len(os.listdir(f"{store.root}/data/a")) == 1


def test_dropping_takes_all_of_a_dataset(spark, store):
    one = spark.range(1).select(F.col("id").alias("x"))
    for name in ("a", "b"):
        store.save(name, {"records": one, "reports": one})
    store.save("a", {"records": one})
    store.drop("a")
    assert os.listdir(f"{store.root}/data") == ["b"] == os.listdir(f"{store.root}/manifests")
    assert sorted(map(tuple, store.listed().collect())) == [("b", 1, "records", 1), ("b", 1, "reports", 1)]
    assert [tuple(r) for r in store.all_of("reports").collect()] == [(0, "b")]
    for missing in (lambda: store.load("a"), lambda: store.drop("a"), lambda: store.all_of("other")):
        with pytest.raises(KeyError):
            missing()
    with pytest.raises(ValueError, match="dataset id"):
        store.save("../b", {"records": one})


def test_pages_of_the_graph(spark):
    rows = [(i, 30 - i, json.dumps({"record_id": f"SAMN{i}", "note": "x" * (900 if i % 4 == 0 else 10)})) for i in range(30)]
    df = spark.createDataFrame(rows, "record_id long, line long, payload string")
    shown, scope = graph.page(df, ["line"], number=2, size=10, most_bytes=2200)
    here = sorted(rows, key=lambda r: r[1])[10:20]
    used, want = 0, []
    for r in here:
        if used + len(r[2]) <= 2200:
            used, want = used + len(r[2]), [*want, r[0]]
    assert sorted(r.record_id for r in shown.collect()) == sorted(want) and 0 < len(want) < 10
    assert scope == {"matching_records": 30, "records_examined": len(want), "records_skipped_for_size": 10 - len(want), "page": 2, "pages": 3, "record_limit": 10}
    nodes = graph.nodes(evidence.mentions(evidence.statements(shown))).where("type = 'sample'")
    assert nodes.count() == len(want)
    assert graph.page(df, ["record_id"], 99, 25)[1]["page"] == 2 and graph.page(df.limit(0), ["line"])[1] == {"matching_records": 0, "records_examined": 0, "records_skipped_for_size": 0, "page": 1, "pages": 1, "record_limit": 25}
    for size in (10, 25, 50, 100):
        assert graph.page(df, ["line"], size=size)[1]["records_examined"] == min(size, 30)
    with pytest.raises(ValueError, match="10, 25, 50 or 100"):
        graph.page(df, ["line"], size=20)


@pytest.fixture(scope="module")
def tables(spark):
    g = [("GCF_1", "GCF_1", "GCA_1", "S1", "P1", "https://h/nuccore/CP1.2?x"), ("GCF_2", None, "GCA_2", "S2", "P9", None), ("GCF_3", "GCF_3", "GCA_1", "S9", None, "https://h/nuccore/CP3"), ("GCF_4", "GCF_4", "GCA_4", "S4", "P1", "https://h/other")]
    genome = spark.createDataFrame(g, "accession string, current string, paired string, biosample string, bioproject string, wgs_url string")
    bv = [(1, "GCA_1", "S1", "CP3"), (2, None, "S2", "CP1,X"), (3, "GCF_1", None, None), (4, "GCF_2", None, "CP3,CP9"), (5, None, "S4", None), (6, None, "S4", None)]
    bvbrc = spark.createDataFrame(bv, "id int, assembly_accession string, biosample_accession string, genbank_accessions string")
    projects = spark.createDataFrame([("P1", "one"), ("P2", "two"), (None, "none")], "accession string, title string")
    samples = spark.createDataFrame([("S1", "E1"), ("S2", None), ("S4", "E4")], "accession string, sra_sample string")
    runs = spark.createDataFrame([(f"X{i:03}", "E1" if i < 60 else "E9") for i in range(70)], "accession string, sample_accession string")
    return genome, bvbrc, projects, samples, runs


def test_lookup_of_many_and_of_one(spark, tables):
    names = ["GCF_1", "GCA_1", "GCF_2", "GCF_3", "GCA_4", "nothing", None, "GCF_1"]
    many = {r.wanted: r for r in lookup.genomes(spark.createDataFrame([(n,) for n in names], "wanted string"), *tables).collect()}
    assert set(many) == {"GCF_1", "GCA_1", "GCF_2", "GCF_3", "GCA_4", "nothing"}
    said = lambda r: (r.genome and r.genome.accession, r.matched_by, r.bvbrc and [b.id for b in r.bvbrc], r.bioproject and r.bioproject.title, r.biosample and r.biosample.accession, r.sra_experiments and len(r.sra_experiments))
    assert said(many["GCF_1"]) == said(many["GCA_1"]) == ("GCF_1", "assembly_accession", [1, 3], "one", "S1", 50)
    assert said(many["GCF_2"]) == ("GCF_2", "biosample_accession", [2], None, "S2", None)  # a null key: the first rule is skipped
    assert said(many["GCF_3"]) == ("GCF_3", "assembly_accession", [1], None, None, None)
    assert said(many["GCA_4"]) == ("GCF_4", "biosample_accession", [5, 6], "one", "S4", None)
    assert said(many["nothing"]) == (None,) * 6
    assert [e.accession for e in many["GCF_1"].sra_experiments] == [f"X{i:03}" for i in range(50)]
    for name in ("GCA_1", "nothing"):
        one = lookup.genomes(spark.createDataFrame([(name,)], "wanted string"), *tables)
        assert one.collect() == [many[name]]
        assert "NestedLoop" not in one._jdf.queryExecution().executedPlan().toString()
    bare = lookup.genomes(spark.createDataFrame([("GCF_1",)], "wanted string"), *tables[:4])
    assert "sra_experiments" not in bare.columns and bare.count() == 1
