import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.operators import retrieve


@pytest.fixture(scope="module")
def terms(spark):
    """A label that holds a third and more of all vectors, small ones, none, and repeated ids."""
    rng = np.random.default_rng(5)
    of = ["hot"] * 3000 + ["small"] * 20 + ["one"] + [None] * 1500
    rows = [(o, i // 2, [float(x) for x in rng.integers(-9, 9, 4)] if i % 50 else None) for i, o in enumerate(of)]
    return spark.createDataFrame(rows, "ontology string, id long, embedding array<float>").repartition(5).cache()


def test_no_block_grows_with_its_ontology(terms):
    rows = terms.where("embedding is not null and ontology is not null")
    sizes = {}
    for r in retrieve._blocks(rows, "t", 100).selectExpr("ontology", "size(t) as n").collect():
        sizes.setdefault(r.ontology, []).append(r.n)
    assert {o: sum(n) for o, n in sizes.items()} == {r.ontology: r["count"] for r in rows.groupBy("ontology").count().collect()}
    assert len(sizes["hot"]) == 30 and max(sizes["hot"]) < 160 and len(sizes["small"]) == len(sizes["one"]) == 1


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_blocks_change_no_result(terms, metric):
    queries = terms.where("id % 5 = 0")
    rank = lambda rows: sorted((r.ontology, r.query_id, r.rank, r.term_id, r.score) for r in rows.collect())
    got = rank(retrieve.nearest(queries, terms, 7, metric, block=100))
    assert got == rank(retrieve.nearest(queries, terms, 7, metric))
    vectors = [r for r in terms.collect() if r.embedding is not None and r.ontology is not None]
    by = {}
    for r in vectors:
        by.setdefault(r.ontology, []).append(r)
    want = {}
    for r in vectors:
        if r.id % 5 == 0:
            own = by[r.ontology]
            s = np.round(retrieve.scores(np.array([r.embedding], float), np.array([x.embedding for x in own], float), metric), 6)[0] + 0.0
            want.setdefault((r.ontology, r.id), []).extend((x if metric == "l2" else -x, t.id) for x, t in zip(s, own, strict=True))
    want = sorted((o, i, k, t, x if metric == "l2" else -x + 0.0) for (o, i), found in want.items() for k, (x, t) in enumerate(sorted(found)[:7]))
    assert [g[:4] for g in got] == [w[:4] for w in want] and [g[4] for g in got] == pytest.approx([w[4] for w in want])


TIES = [i / 2000 for i in range(-1399, 1400, 2)]  # where three decimals are a matter of the last bit


def test_flags_of_assembled_results_round_scores_as_sql_does(spark):
    rows = [(str(i), i, [("O", ["t"])], x) for i, x in enumerate(TIES)]
    plans = spark.createDataFrame([(*r[:3], []) for r in rows], "record_id string, line long, mappings array<struct<ontology string, query_texts array<string>>>, flags array<string>")
    matches = spark.createDataFrame([(r[0], 0, 0, 1, "l", r[3], 0) for r in rows], "record_id string, bucket int, place int, term_id int, label string, score double, rank int")
    got = {r.record_id: r.flags for r in retrieve.assembled(plans, matches, "line").collect()}
    told = duckdb.execute("select printf('%.3f', unnest($1::double[]))", [TIES]).fetchall()
    assert got == {r[0]: [f"O: top match score {t} below threshold 0.7 for query 't'"] for r, (t,) in zip(rows, told, strict=True)}


def test_flags_round_scores_as_sql_does(spark):
    rows = [(1, i, x, 0) for i, x in enumerate(TIES)]
    matches = spark.createDataFrame(rows, "ontology int, query_id int, score double, rank int")
    got = {r.query_id: r.flag for r in retrieve.flags(matches.select("ontology", F.col("query_id").alias("id")), matches).collect()}
    told = duckdb.execute("select printf('%.3f', unnest($1::double[]))", [TIES]).fetchall()
    assert got == {r[1]: f"1: top match score {t} below threshold 0.7 for query '{r[1]}'" for r, (t,) in zip(rows, told, strict=True)}
