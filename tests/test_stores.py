"""The leaf store as an index, paged sources, and the selector's order of fields."""

import json
import os
import tempfile

import pytest

from termweave.operators import evaluate, explorer, linkage, normalize, retrieve
from termweave.plans.stages import Stage, holds, run
from termweave.sources import records


@pytest.fixture(scope="module")
def leaves(spark):
    rows = [(i, json.dumps({"name": f"Item {i}", "n": i % 7 if i % 5 else None, "deep": {"a/b": "x" if i % 3 else "Item"}, f"own{i % 40}": True})) for i in range(400)]
    return explorer.leaves(spark.createDataFrame(rows, "record_id long, payload string"))


@pytest.fixture(scope="module")
def store(spark, leaves):
    return explorer.LeafStore(spark, tempfile.mkdtemp(prefix="spark-") + "/index").write(leaves)


def test_the_store_holds_all_leaves(leaves, store):
    key = lambda df: sorted(map(repr, map(tuple, df.select("record_id", "field", "kind", "value").collect())))
    assert key(store.leaves()) == key(leaves)
    assert {(r.field, *r.kinds) for r in store.fields().collect()} == {(r.field, *r.kinds) for r in explorer.dictionary(leaves).collect()}


def test_searches_and_orders_are_those_of_the_leaves(leaves, store):
    held = [tuple(r) for r in leaves.select("record_id", "field", "value").collect()]
    for text, name in (("ITEM 3", None), ("item", "/deep/a~1b"), ("item", "/nowhere"), ("true", None)):
        want = {i for i, f, v in held if v is not None and text.lower() in v.lower() and name in (None, f)}
        assert {r.record_id for r in store.search(text, name).collect()} == want
    numbers = sorted(((float(v) if v is not None else None, i) for i, f, v in held if f == "/n"), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert [r.record_id for r in store.ordered("/n", True).collect()] == [i for _, i in numbers]


def test_one_field_reads_one_folder(store):
    plan = store.of("/name")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(field,/name)" in plan
    files = store.of("/name").inputFiles()
    folders = {os.path.basename(os.path.dirname(f)) for f in files}
    everything = {os.path.basename(os.path.dirname(f)) for f in store.leaves().inputFiles()}
    assert len(everything) > 10 and len(folders) <= len(everything)
    rows = store.of("/name").select("value")
    assert "kind" not in rows._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert rows.count() == 400


def pages(folder, sizes):
    for i, n in sizes.items():
        with open(f"{folder}/page-{i}.json", "w") as f:
            json.dump([{"id": f"{i}-{k}", "n": k} for k in range(n)], f)
    return folder


@pytest.mark.parametrize(("sizes", "want"), [({1: 3, 2: 3, 3: 1}, 7), ({1: 3, 2: 2, 3: 3}, 5), ({0: 3, 1: 3, 3: 3}, 6), ({5: 0, 6: 3}, 0), ({9: 3, 10: 3, 11: 0, 12: 3}, 6), ({2: 3}, 3)])
def test_pages_end_with_the_short_one(spark, sizes, want):
    rows = records.read_pages(spark, pages(tempfile.mkdtemp(prefix="spark-"), sizes), "id string, n int", size=3).orderBy("page", "pos").collect()
    assert len(rows) == want and all(r.id == f"{r.page}-{r.pos}" and r.n == r.pos for r in rows)


def test_the_selector_has_an_order_of_its_own(spark):
    row = {"bvbrc": {"host_name": "annotated", "disease": ["flu", "", "cold"], "isolation_source": None}, "biosamples": [{"host": "sampled", "attributes": [{"name": "host", "value": "attribute"}, {"name": "isolation source", "value": " swab "}, {"name": "env_broad_scale", "value": "sea"}]}]}
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(row), json.dumps({"bvbrc": {"host_name": "b"}})]))
    a, b = sorted(normalize.selected(df, ["host", "disease", "isolation_source", "environment", "geo_loc_name"]).collect(), key=lambda r: r.host, reverse=True)
    assert (a.host, a.disease, a.isolation_source, a.environment, a.geo_loc_name) == ("sampled", "flu; cold", "swab", "", "") and (b.host, b.disease) == ("b", "")
    flat = {r.host for r in normalize.flat(df).collect()}
    assert "attribute" in flat  # the other order
    with pytest.raises(ValueError, match="unknown field depth"):
        normalize.selected(df, ["depth"])
    two = spark.read.json(spark.sparkContext.parallelize([json.dumps(row | {"k": i}) for i in range(3)]))
    assert [r.k for r in linkage.unique_by(normalize.selected(two, ["host", "disease"]), ["host", "disease"], ["k"]).collect()] == [0]


def test_shares_and_unordered_embeddings(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 3)], "k string, v int")
    assert sorted(map(repr, map(tuple, evaluate.shares(df, ["k"], {"values": "v"}).collect()))) == sorted(map(repr, [("a", 3, 2, 75.0), (None, 1, 1, 25.0)]))
    asked = spark.createDataFrame([("r", "M", "t")], "record_id string, ontology string, query_text string")
    known = spark.createDataFrame([("r", "M", "t", [1.0, 2.0], 1), ("r", "M", "t", [3.0, 0.0], 0)], "record_id string, ontology string, query_text string, embedding array<double>, pos int")
    assert retrieve.embedded(asked, known).first().embedding == [1.0, 2.0]
    for rows in (known, known.orderBy("pos")):
        assert retrieve.embedded(asked, rows.drop("pos")).first().embedding == [3.0, 0.0]


def test_a_stage_is_checked_once_it_is_written(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    later = []
    stages = lambda check: [Stage("kept", ("rows",), lambda s, df: df, check), Stage("more", ("kept",), lambda s, df: later.append(1) or df)]
    made = run(spark, stages(holds("k", least=2)), folder, {"rows": rows})
    assert made["more"].count() == 2 and later == [1]
    for check, what in ((holds("k", "v"), "nulls in v"), (holds("w"), "no column w"), (holds(least=3), "2 rows, 3 at least")):
        with pytest.raises(ValueError, match=f"stage kept: {what}"):
            run(spark, stages(check), folder, {"rows": rows})
    assert later == [1]
