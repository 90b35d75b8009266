"""Ontology graphs: closure, information content and pairwise similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.plans.session import checkpoints

TOP = "owl:Thing"
PREDICATES = {"MONDO": ["is_a"], "UBERON": ["is_a", "part_of"], "ENVO": ["is_a", "part_of"]}


def edges(terms: DataFrame) -> DataFrame:
    """terms (ontology, id, is_a, part_of) to edges (ontology, child, parent, predicate)."""
    of = lambda p: terms.select("ontology", F.col("id").alias("child"), F.explode(p).alias("parent"), F.lit(p).alias("predicate"))
    return of("is_a").unionByName(of("part_of"))


def closure(links: DataFrame, nodes: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, ancestor) with every node its own ancestor, along links (child, parent): paths are doubled each round, so
    a graph of depth d takes log2(d) rounds, and distinct pairs end cycles. Only pairs that the last round has found are
    joined again. Every round is checkpointed."""
    pairs = nodes.select(F.col("node"), F.col("node").alias("ancestor")).unionByName(links.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))).where("node is not null and ancestor is not null").distinct()
    checkpoints(links.sparkSession)
    pairs = fresh = pairs.checkpoint()
    for _ in range(rounds):
        # a path that is not known yet goes on from one of the last round, or leads to one
        ahead = fresh.join(pairs.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above")), "ancestor").select("node", F.col("above").alias("ancestor"))
        behind = pairs.join(fresh.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above")), "ancestor").select("node", F.col("above").alias("ancestor"))
        fresh = ahead.unionAll(behind).distinct().join(pairs, ["node", "ancestor"], "left_anti").checkpoint()
        if fresh.isEmpty():
            return pairs
        pairs = pairs.unionAll(fresh)
    raise ValueError(f"paths of more than 2**{rounds} links")


def information_content(pairs: DataFrame) -> DataFrame:
    """(term, ic): -log2 of the share of all nodes that are the term or below it."""
    n = pairs.where("node = ancestor").count()
    return pairs.groupBy(F.col("ancestor").alias("term")).agg(F.countDistinct("node").alias("below")).select("term", (-F.log2(F.col("below") / F.lit(n))).alias("ic"))


def similarity(wanted: DataFrame, pairs: DataFrame, ic: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """wanted (a, b) with jaccard, resnik, phenodigm, mica and comparable.

    mica is the common ancestor of most information, of those within the tolerance the first by name; a pair without a
    common ancestor has resnik 0 and mica owl:Thing; one with a term outside the graph has jaccard 1 or 0 by equality
    and nothing else; phenodigm is null where it would be 0.
    """
    below = pairs.where(F.col("ancestor") != TOP)
    sizes = below.groupBy("node").agg(F.count("*").alias("n"))
    one, two = below.select(F.col("node").alias("a"), "ancestor"), below.select(F.col("node").alias("b"), "ancestor")
    asked = wanted.select("a", "b").distinct()
    common = asked.join(one, "a").join(two, ["b", "ancestor"]).join(ic.withColumnRenamed("term", "ancestor"), "ancestor")
    best = common.groupBy("a", "b").agg(F.count("*").alias("both"), F.max("ic").alias("top"), F.collect_list(F.struct("ancestor", "ic")).alias("all"))
    near = F.array_min(F.transform(F.filter("all", lambda x: x["ic"] >= F.col("top") * (1 - tolerance)), lambda x: x["ancestor"]))
    best = best.select("a", "b", "both", "top", near.alias("mica"))
    out = wanted.join(best, ["a", "b"], "left").join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a", "left").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b", "left")
    known = F.col("na").isNotNull() & F.col("nb").isNotNull()
    both = F.coalesce("both", F.lit(0))
    jaccard = F.when(known, both / (F.col("na") + F.col("nb") - both)).otherwise((F.col("a") == F.col("b")).cast("double"))
    resnik = F.when(known, F.coalesce("top", F.lit(0.0)))
    return out.select("a", "b", jaccard.alias("jaccard"), resnik.alias("resnik"), F.when((resnik > 0) & (jaccard > 0), F.sqrt(resnik * jaccard)).alias("phenodigm"), F.when(known, F.coalesce("mica", F.lit(TOP))).alias("mica"), known.alias("comparable"))
