"""Evaluation against curated terms: alignment of accessions, precision, recall and F1, means per ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termweave.functions.text import assembly_parts


def prf1(gold: Column, predicted: Column) -> list[Column]:
    """precision, recall, f1 and support of rows of gold and predicted labels; '' or null is no label."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    tp, p, g = F.count_if(has(gold) & (gold == predicted)), F.count_if(has(predicted)), F.count_if(has(gold))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return [share(tp, p).alias("precision"), share(tp, g).alias("recall"), share(2 * tp, p + g).alias("f1"), g.alias("support")]


def f1_table(rows: DataFrame) -> DataFrame:
    """rows (ontology, gold, predicted) to precision, recall, f1 and support per ontology, 'micro avg' over all rows and
    'macro avg', the mean over ontologies."""
    each = rows.groupBy("ontology").agg(*prf1(F.col("gold"), F.col("predicted")))
    micro = rows.agg(F.lit("micro avg").alias("ontology"), *prf1(F.col("gold"), F.col("predicted")))
    macro = each.agg(F.lit("macro avg").alias("ontology"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    return each.unionByName(micro).unionByName(macro)


def predicted_label(gold: Column, terms: Column) -> Column:
    """The gold label if it is among the terms, else the first term, else ''."""
    return F.when(F.array_contains(terms, gold), gold).otherwise(F.coalesce(F.get(terms, 0), F.lit("")))


def align(records: DataFrame, gold: DataFrame) -> DataFrame:
    """(record, gold_accession, rule): each record's accession in gold, else its twin in the other database with the
    same version, else the twin's only version there; several gold rows of an accession are one."""
    r = records.select(F.col("accession").alias("record"), assembly_parts(F.col("accession")).alias("p")).where("p is not null").distinct()
    g = gold.select(F.col("accession").alias("gold_accession"), assembly_parts(F.col("accession")).alias("q")).where("q is not null").distinct()
    other = F.when(F.col("p.db") == "GCA", "GCF").otherwise("GCA")
    own = r.join(g, F.col("record") == F.col("gold_accession")).select("record", "gold_accession", F.lit(1).alias("rule"))
    keyed = r.select("record", "p", other.alias("db"), F.col("p.number").alias("number"))
    twins = keyed.join(g.select("gold_accession", F.col("q.db").alias("db"), F.col("q.number").alias("number"), F.col("q.version").alias("version")), ["db", "number"])
    same = twins.where("version = p.version").select("record", "gold_accession", F.lit(2).alias("rule"))
    only = twins.groupBy("record").agg(F.min("gold_accession").alias("gold_accession"), F.countDistinct("version").alias("n")).where("n = 1").select("record", "gold_accession", F.lit(3).alias("rule"))
    found = own.unionByName(same).unionByName(only)
    return found.groupBy("record").agg(F.min_by("gold_accession", F.struct("rule", "gold_accession")).alias("gold_accession"), F.min("rule").alias("rule"))


def shares(df: DataFrame, by: list[str], distinct: dict[str, str] | None = None, digits: int = 6) -> DataFrame:
    """For each combination of ``by`` its rows as n, their percentage of all rows, and for each (name, column) of
    ``distinct`` how many values the column has. The total is added up over the groups, not over the rows."""
    counted = df.groupBy(*by).agg(F.count("*").alias("n"), *(F.countDistinct(c).alias(name) for name, c in (distinct or {}).items()))
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), digits))


def means(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Means of the columns (nulls left out) per ontology and over 'all', with n_scored and n_records."""
    return scores.groupingSets([["ontology"], []], "ontology").agg(*(F.avg(c).alias(c) for c in columns), F.count(columns[0]).alias("n_scored"), F.count("*").alias("n_records"), F.grouping("ontology").alias("_all")).withColumn("ontology", F.when(F.col("_all") == 1, "all").otherwise(F.col("ontology"))).drop("_all")


def grid(records: DataFrame, ontologies: list[str], *measured: DataFrame) -> DataFrame:
    """A row for each record and ontology with what was measured of them, null where nothing was."""
    out = records.select("record_id", F.explode(F.array(*map(F.lit, ontologies))).alias("ontology"))
    for m in measured:
        out = out.join(m, ["record_id", "ontology"], "left")
    return out


def melted(wide: DataFrame, ontologies: list[str], facts: list[str] = ("gold", "pred", "match")) -> DataFrame:
    """A row for each record and ontology of a table with columns <ontology>_<fact>: record_id, ontology, f1_<fact>."""
    rows = F.array(*(F.struct(F.lit(o).alias("ontology"), *(F.col(f"{o}_{f}").alias(f"f1_{f}") for f in facts)) for o in ontologies))
    return wide.select("record_id", F.inline(rows))


def wide_f1(rows: DataFrame, ontologies: list[str]) -> DataFrame:
    """rows (record_id, ontology, gold, terms) to one row for each record with <ontology>_gold, _pred and _match."""
    pred = predicted_label(F.coalesce("gold", F.lit("")), F.coalesce("terms", F.array().cast("array<string>")))
    held = rows.select("record_id", "ontology", F.coalesce("gold", F.lit("")).alias("gold"), pred.alias("pred"))
    fact = lambda o, c: F.coalesce(F.max(F.when(F.col("ontology") == o, F.col(c))), F.lit(""))
    out = held.groupBy("record_id").agg(*(fact(o, c).alias(f"{o}_{c}") for o in ontologies for c in ("gold", "pred")))
    return out.select("record_id", *(c for o in ontologies for c in (f"{o}_gold", f"{o}_pred", ((F.col(f"{o}_gold") != "") & (F.col(f"{o}_gold") == F.col(f"{o}_pred"))).cast("int").alias(f"{o}_match"))))


def record_scores(predicted: DataFrame, gold: DataFrame, scored: DataFrame, metrics: list[str]) -> DataFrame:
    """(record_id, ontology, status, n_terms, metrics): the mean of each metric over a record's terms of an ontology,
    nulls left out. status: scored, no_gold_term (the record's gold has none of the ontology), no_matching_record.

    predicted: record_id, ontology, term_id; gold: record_id, ontology, gold (null: none); scored: ontology, a (the
    term), b (the gold term) and the metrics."""
    own = predicted.join(gold.select("record_id", "ontology", "gold").distinct(), ["record_id", "ontology"], "left")
    known = gold.select("record_id", F.lit(True).alias("known")).distinct()
    pairs = scored.select("ontology", F.col("a").alias("term_id"), F.col("b").alias("gold"), *metrics).distinct()
    both = own.join(known, "record_id", "left").join(pairs, ["ontology", "term_id", "gold"], "left")
    status = F.when(F.max("known").isNull(), "no_matching_record").when(F.max("gold").isNull(), "no_gold_term").otherwise("scored")
    return both.groupBy("record_id", "ontology").agg(status.alias("status"), F.count("term_id").alias("n_terms"), *(F.avg(m).alias(m) for m in metrics))
