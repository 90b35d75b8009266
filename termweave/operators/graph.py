"""The evidence graph: typed nodes and edges projected from linked records, each edge with what it rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termweave.functions.text import repository, repository_url
from termweave.operators.explorer import within_budget

TYPES = ["study", "sample", "sequence", "publication", "organism", "disease", "repository", "program"]
RECORDS_PER_NODE, EVIDENCE_PER_EDGE, MOST_NODES, MOST_EDGES = 8, 5, 400, 800


def organism(taxon: Column, name: Column) -> Column:
    """NCBITaxon:n for a positive decimal taxon, else name: and the folded name."""
    return F.when(F.rlike(taxon, F.lit("^0*[1-9][0-9]*$")), F.concat(F.lit("NCBITaxon:"), F.regexp_replace(taxon, "^0+", ""))).when(F.trim(name) != "", F.concat(F.lit("name:"), F.lower(F.trim(name))))


def nodes(mentions: DataFrame) -> DataFrame:
    """mentions (type, identifier, label, record_id) to one node each with a label (the first that is not the
    identifier itself, if any), its page, at most eight record ids, and the number of records.

    A record counts once for a node before nodes are put together, and only eight rows of a node leave a task, so an
    entity that every record names is no large group."""
    keys = ["type", "identifier"]
    better = F.min(F.when(F.col("label") != F.col("identifier"), F.col("label")))
    once = mentions.where("identifier is not null and identifier <> ''").groupBy(*keys, "record_id").agg(better.alias("label"))
    counted = once.groupBy(*keys).agg(F.substring(F.coalesce(F.min("label"), F.min("identifier")), 1, 200).alias("label"), F.count("record_id").alias("n_records"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("record_id"))).where(F.col("n") <= RECORDS_PER_NODE)
    shown = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list("record_id")).alias("record_ids"))
    return counted.join(shown, keys).select(*keys, "label", repository_url(F.col("identifier"), F.col("type")).alias("url"), "record_ids", "n_records")


def edges(claims: DataFrame) -> DataFrame:
    """claims (source, target, relation, status, evidence) to one edge each with at most five distinct evidences;
    loops are dropped."""
    keys = ["source", "target", "relation", "status"]
    own = claims.where("source is not null and target is not null and source <> target").select(*keys, "evidence")
    # equal evidence has one rank, and what is beyond the fifth does not leave its task: one shuffle
    ranked = own.withColumn("n", F.dense_rank().over(Window.partitionBy(*keys).orderBy("evidence"))).where(F.col("n") <= EVIDENCE_PER_EDGE)
    identity = F.substring(F.sha2(F.concat_ws("\x1f", *keys), 256), 1, 16)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_set("evidence")).alias("evidence")).withColumn("edge_id", identity)


def node_keys(mentions: DataFrame) -> DataFrame:
    """(type, identifier) of the nodes alone."""
    return mentions.where("identifier is not null and identifier <> ''").select("type", "identifier").distinct()


def edge_keys(claims: DataFrame) -> DataFrame:
    """(source, target, relation, status) of the edges alone."""
    return claims.where("source is not null and target is not null and source <> target").select("source", "target", "relation", "status").distinct()


def registered(mentions: DataFrame) -> DataFrame:
    """Claims that studies, samples and sequences are registered in the archive that their accession's form tells."""
    of = repository(F.col("identifier"), F.col("type"))
    rows = mentions.where(F.col("type").isin("study", "sample", "sequence") & of.isNotNull()).select("type", "identifier").distinct()
    return rows.select(F.concat_ws(":", "type", "identifier").alias("source"), F.concat(F.lit("repository:"), of).alias("target"), F.lit("registered in").alias("relation"), F.lit("derived").alias("status"), F.col("identifier").alias("evidence"))


def proposed_disease(proposals: DataFrame) -> DataFrame:
    """Claims of proposals whose record is the row's own, whose ontology is MONDO and whose term was retrieved."""
    ok = (F.col("record_id") == F.col("proposal_record_id")) & (F.col("ontology") == "MONDO") & F.rlike("term_id", F.lit(r"^MONDO:\d+$")) & F.array_contains("candidate_curies", F.col("term_id"))
    return proposals.where(ok).select(F.concat(F.lit("sample:"), "record_id").alias("source"), F.concat(F.lit("disease:"), "term_id").alias("target"), F.lit("proposed disease").alias("relation"), F.lit("proposed").alias("status"), F.col("record_id").alias("evidence"))


def type_counts(made: DataFrame) -> DataFrame:
    """Nodes of each of the eight types, 0 where there is none."""
    spark = made.sparkSession
    kinds = spark.createDataFrame([(t,) for t in TYPES], "type string")
    return kinds.join(made.groupBy("type").count(), "type", "left").select("type", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def view(made: DataFrame, links: DataFrame, most_nodes: int = MOST_NODES, most_edges: int = MOST_EDGES) -> tuple[DataFrame, DataFrame]:
    """A bounded view to look at: the first nodes by type and identifier, and edges between them alone."""
    shown = made.orderBy("type", "identifier").limit(most_nodes)
    keys = shown.select(F.concat_ws(":", "type", "identifier").alias("key"))
    return shown, links.join(keys.withColumnRenamed("key", "source"), "source", "left_semi").join(keys.withColumnRenamed("key", "target"), "target", "left_semi").orderBy("source", "target", "relation").limit(most_edges)


def bounds(made: DataFrame, links: DataFrame, most_nodes: int = MOST_NODES, most_edges: int = MOST_EDGES) -> DataFrame:
    """One row that says what ``view`` leaves out: nodes and nodes_dropped, edges, edges_dangling (an end was dropped) and
    edges_dropped (beyond the cap). Only the keys of the nodes that are shown are sent to all tasks."""
    keys = F.broadcast(made.orderBy("type", "identifier").limit(most_nodes).select(F.concat_ws(":", "type", "identifier").alias("key")))
    end = lambda side: keys.select(F.col("key").alias(side), F.lit(1).alias(f"{side}_shown"))
    both = F.col("source_shown").isNotNull() & F.col("target_shown").isNotNull()
    told = links.join(end("source"), "source", "left").join(end("target"), "target", "left").agg(F.count("*").alias("edges"), F.count_if(both).alias("inside"))
    over = lambda n, most: F.greatest(F.col(n) - most, F.lit(0).cast("long"))
    counted = made.agg(F.count("*").alias("nodes")).join(told)
    return counted.select("nodes", over("nodes", most_nodes).alias("nodes_dropped"), "edges", (F.col("edges") - F.col("inside")).alias("edges_dangling"), over("inside", most_edges).alias("edges_dropped"))


PAGE_SIZES, PAGE_BYTES = (10, 25, 50, 100), 8 << 20


def page(selected: DataFrame, order: list[str], number: int = 1, size: int = 25, most_bytes: int = PAGE_BYTES) -> tuple[DataFrame, dict]:
    """A page of selected records (record_id, line, payload) in order, cut to so many bytes of payload, and its scope: how
    many records match, were examined and were skipped for their size, and which page of how many this is. Of a page, at
    most 100 rows, ids and lengths are fetched; a number beyond the last page is the last one."""
    if size not in PAGE_SIZES:
        raise ValueError("choose 10, 25, 50 or 100 records")
    matching = selected.count()
    pages = max(1, -(-matching // size))
    number = min(max(1, number), pages)
    here = selected.orderBy(*order).offset((number - 1) * size).limit(size)
    own = [c for c in order if isinstance(c, str) and c != "record_id"]
    ids, skipped = within_budget(here, own or ["record_id"], most_bytes)
    shown = selected.where(F.col("record_id").isin(ids))
    return shown, {"matching_records": matching, "records_examined": len(ids), "records_skipped_for_size": skipped, "page": number, "pages": pages, "record_limit": size}


def as_json(shown: DataFrame, links: DataFrame) -> DataFrame:
    """A view as one JSON text (nodes, edges, types): bounded by what ``view`` shows, so one row holds it."""
    packed = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    n, e, t = packed(shown, "nodes"), packed(links, "edges"), packed(type_counts(shown), "types")
    return n.join(e).join(t).select(F.to_json(F.struct("nodes", "edges", "types")).alias("value"))
