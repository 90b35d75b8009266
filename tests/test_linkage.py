"""Numbers over ranges, and keys that begin with others."""

import pytest
from pyspark.sql import functions as F

from termweave.operators import linkage as L
from termweave.operators import lookup


def test_a_million_rows_with_a_column_beside_the_order(spark):
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.concat(F.lit("payload "), "id").alias("beside")).repartition(7)
    made = L.surrogate(df, ["k"])
    assert made.columns == ["k", "beside", "id"]
    row = made.agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    assert tuple(row) == (1_000_000, 1_000_000, 1, 1_000_000)
    ordered = made.select("k", F.lag("k").over(L.Window.partitionBy(F.floor(F.col("id") / 1000)).orderBy("id")).alias("before"))
    assert ordered.where("before >= k").count() == 0


def test_equal_rows_nulls_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "a")] * 300 + [(None, "b")] * 5 + [(0, None)], "k int, beside string")
    rows = L.surrogate(df, ["k"], "number").collect()
    assert sorted(r.number for r in rows) == list(range(1, 307))
    assert {r.number for r in rows if r.k is None} == set(range(1, 6)) and next(r.number for r in rows if r.k == 0) == 6
    assert L.surrogate(df.limit(0), ["k"]).collect() == []


def test_a_right_key_may_begin_with_a_left_one(spark):
    left = spark.createDataFrame([(1, ["CP005288", None]), (2, ["CP0052"]), (3, [""]), (4, None), (5, ["é日"])], "id int, keys array<string>")
    right = spark.createDataFrame([(10, ["CP005288.1", "X"]), (11, ["CP005288"]), (12, [None, "CP00529.2"]), (13, []), (14, ["é日本"]), (15, ["é"])], "id int, keys array<string>")
    rules = [("exact", F.col("keys"), F.col("keys")), ("begins", F.col("keys"), F.col("keys"), True)]
    made = L.match_rules(left, right, rules)
    assert sorted(map(tuple, made.collect())) == [(1, 10, "begins"), (1, 11, "exact"), (2, 10, "begins"), (2, 11, "begins"), (2, 12, "begins"), (5, 14, "begins")]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    many = spark.range(1, L.MOST_LENGTHS + 2).select("id", F.array(F.expr("repeat('x', cast(id as int))")).alias("keys"))
    with pytest.raises(ValueError, match="lengths"):
        L.match_rules(many, right, rules)


def test_lists_of_the_best_rule_hold_what_pairs_hold(spark):
    left = spark.createDataFrame([(1, ["a", "b"], "x"), (2, ["b", None], "x"), (3, ["q"], "x"), (4, None, "y"), (5, ["q"], None), (6, ["a"], "y")], "id int, many array<string>, one string")
    right = spark.createDataFrame([(10, "a", "x"), (11, "b", "x"), (11, "c", "z"), (12, "b", "y"), (13, None, "y"), (None, "q", "y")], "id int, a string, b string")
    rules = [("first", F.col("many"), F.array("a")), ("second", F.array("one"), F.split("b", ","))]
    found, lists = L.ruled_lists(left, right, rules)
    got = {r.left_id: (r.rule, [tuple(x) for x in r.rows]) for r in found.join(lists, ["rule", "keys"]).collect()}
    pairs = L.first_rule(L.match_rules(left, right, rules), ["first", "second"]).join(right.withColumnRenamed("id", "right_id"), "right_id")
    want = {}
    for r in pairs.collect():
        want.setdefault(r.left_id, (["first", "second"].index(r.matched_by), []))[1].append((r.right_id, r.a, r.b))
    assert {k: v for k, v in got.items() if v[1]} == {k: (rule, sorted(rows)) for k, (rule, rows) in want.items()}


def most_rows(node) -> int:
    """The most rows that an operator of a plan that was run has made."""
    kind, own = node.getClass().getSimpleName(), node.metrics().get("numOutputRows")
    below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, below)])


def test_lookup_makes_no_row_for_each_pair(spark):
    n = 1000
    k = F.col("id").cast("string")
    genome = spark.range(n).select(F.concat(F.lit("A"), k).alias("accession"), F.lit(None).cast("string").alias("current"), F.lit(None).cast("string").alias("paired"), F.lit("S").alias("biosample"), F.lit("P").alias("bioproject"), F.lit(None).cast("string").alias("wgs_url"))
    bvbrc = spark.range(n).select("id", F.concat(F.lit("B"), k).alias("assembly_accession"), F.lit("S").alias("biosample_accession"), F.lit("V").alias("genbank_accessions"))
    none = spark.createDataFrame([], "accession string, sra_sample string")
    made = lookup.genomes(genome.select(F.col("accession").alias("wanted")), genome, bvbrc, none, none)
    made = made.select("matched_by", F.size("bvbrc").alias("n"))
    assert {tuple(r) for r in made.collect()} == {("biosample_accession", n)}
    assert most_rows(made._jdf.queryExecution().executedPlan()) < 40 * n
