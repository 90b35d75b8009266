"""Exact nearest neighbours per ontology, their flags, and candidates merged over the queries of a record.

Queries and terms are dealt into blocks of an ontology; block pairs meet by an equi-join and are scored by one matrix
product each, of which only the best k of each query leave the task. An ontology of n rows is n / ``BLOCK`` blocks, so
no side is broadcast or collected; only the block counts of ontologies larger than a block are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termweave.functions.text import three_decimals

BLOCK = 4096  # rows of an ontology in a block, about
SLICE = 256  # queries of a block that are scored at a time


def _counts(df: DataFrame, prefix: str, block: int) -> DataFrame:
    """(ontology, blocks) of the ontologies that need more than one."""
    return F.broadcast(df.groupBy("ontology").agg(F.ceil(F.count("*") / block).alias(f"{prefix}_blocks")).where(f"{prefix}_blocks > 1"))


def _blocks(df: DataFrame, prefix: str, block: int = BLOCK) -> DataFrame:
    """Rows dealt by a row number, as ids may repeat."""
    numbered = df.select("ontology", "id", "embedding", F.monotonically_increasing_id().alias("row"))
    dealt = numbered.join(_counts(df, prefix, block), "ontology", "left")
    part = F.pmod(F.xxhash64("row"), F.coalesce(f"{prefix}_blocks", F.lit(1)))
    packed = F.collect_list(F.struct("id", "embedding"))
    return dealt.groupBy("ontology", part.alias(f"{prefix}_block")).agg(packed.alias(prefix))


def scores(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """Larger is better for cosine and dot; l2 is the squared distance, smaller is better. Zero vectors score 0."""
    if metric == "cosine":
        q, t = (x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n) for x in (q, t))
    if metric == "l2":
        return np.maximum((q**2).sum(1)[:, None] - 2 * q @ t.T + (t**2).sum(1)[None, :], 0)
    return q @ t.T


def nearest(queries: DataFrame, terms: DataFrame, k: int = 10, metric: str = "cosine", block: int = BLOCK, digits: int = 6) -> DataFrame:
    """queries and terms (ontology, id, embedding) to (ontology, query_id, term_id, score, rank); rank from 0, ties by id.

    Null embeddings and null ontologies are left out; k may exceed the number of terms. Scores are in double, rounded to ``digits``.
    """
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric {metric}")

    def side(packed: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        return np.array(packed.field("id").to_pylist()), packed.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(packed), -1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, q), (terms_of, t) = (side(batch.column(c)[i].values) for c in (1, 2))
                for a in range(0, len(ids), SLICE):
                    s = np.round(scores(q[a : a + SLICE], t, metric), digits) + 0.0
                    key = s if metric == "l2" else -s
                    order = np.lexsort((np.broadcast_to(terms_of, s.shape), key), axis=1)[:, :k]
                    found = [np.repeat(ids[a : a + SLICE], order.shape[1]), terms_of[order].ravel(), np.take_along_axis(s, order, 1).ravel()]
                    ontology = batch.column(0).take(pa.array(np.full(order.size, i)))
                    types = *(batch.column(c).type.value_type.field("id").type for c in (1, 2)), pa.float64()
                    yield pa.RecordBatch.from_arrays([ontology, *map(pa.array, found, types)], ["ontology", "query_id", "term_id", "score"])

    queries, terms = (x.where("embedding is not null and ontology is not null") for x in (queries, terms))
    t = _blocks(terms, "t", block)
    # a block of queries goes to each block of terms of its ontology, so that these are dealt over the tasks
    last = F.coalesce("t_blocks", F.lit(1)) - 1
    q = _blocks(queries, "q", block).join(_counts(terms, "t", block), "ontology", "left").select("ontology", "q", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("t_block"))
    kinds = f"ontology {terms.schema['ontology'].dataType.simpleString()}, query_id {queries.schema['id'].dataType.simpleString()}, term_id {terms.schema['id'].dataType.simpleString()}, score double"
    found = q.join(t, ["ontology", "t_block"]).select("ontology", "q", "t").mapInArrow(best, kinds)
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("ontology", "query_id").orderBy(order, "term_id")) - 1)
    return ranked.where(F.col("rank") < k)


def flags(queries: DataFrame, matches: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(ontology, query_id, score, flag): what to tell of each query's best match; flag is null if there is nothing."""
    top = matches.where("rank = 0").select("ontology", "query_id", "score")
    both = queries.select("ontology", F.col("id").alias("query_id")).join(top, ["ontology", "query_id"], "left")
    low = F.format_string("%s: top match score %s below threshold %s for query '%s'", F.col("ontology").cast("string"), three_decimals(F.col("score")), F.lit(str(threshold)), F.col("query_id").cast("string"))
    none = F.format_string("%s: no matches found for query '%s'", F.col("ontology").cast("string"), F.col("query_id").cast("string"))
    return both.withColumn("flag", F.when(F.col("score").isNull(), none).when(F.col("score") < threshold, low))


def merged(matches: DataFrame, k: int = 10) -> DataFrame:
    """Matches (record, bucket, term_id, label, score) of several queries to one list per bucket: each term once with its
    largest score and the label that came with it (the first on ties), ranked anew by score and id."""
    one = matches.groupBy("record", "bucket", "term_id").agg(F.max("score").alias("score"), F.min_by("label", F.struct(-F.col("score"), "label")).alias("label"))
    by = Window.partitionBy("record", "bucket").orderBy(F.col("score").desc(), "term_id")
    return one.withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < k)


def vector_table(df: DataFrame, keys: list[str] = ("id", "name"), prefix: str = "d") -> DataFrame:
    """A table with a column for each dimension (d0, d1, ...) as one with the keys and an array ``embedding``; a key that
    is not there raises."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    wide = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    return df.select(*keys, F.array(*(F.col(c).cast("double") for c in wide)).alias("embedding"))


def wide_table(df: DataFrame, dimensions: int, prefix: str = "d") -> DataFrame:
    """The inverse of ``vector_table``."""
    return df.select(*(c for c in df.columns if c != "embedding"), *(F.get("embedding", F.lit(i)).alias(f"{prefix}{i}") for i in range(dimensions)))


def requests(plans: DataFrame) -> DataFrame:
    """plans (record_id, mappings with ontology and query_texts) to one row for each text that is to be embedded:
    (record_id, bucket, place, ontology, query_text)."""
    mapped = plans.select("record_id", F.posexplode("mappings").alias("bucket", "m"))
    return mapped.select("record_id", "bucket", F.col("m.ontology").alias("ontology"), F.posexplode("m.query_texts").alias("place", "query_text")).select("record_id", "bucket", "place", "ontology", "query_text")


def embedded(asked: DataFrame, embeddings: DataFrame, dimensions: int | None = None) -> DataFrame:
    """asked with the embedding of its (record_id, ontology, query_text). A request without one raises, and so does an
    embedding of another number of dimensions. Of embeddings with one key the last by ``pos`` counts; without such a
    column no order is known, and the largest counts."""
    keys = ["record_id", "ontology", "query_text"]
    last = F.max_by("embedding", "pos") if "pos" in embeddings.columns else F.max("embedding")
    one = embeddings.groupBy(*keys).agg(last.alias("embedding"))
    made = asked.join(one, keys, "left")
    bad = F.col("embedding").isNull() if dimensions is None else F.col("embedding").isNull() | (F.size("embedding") != dimensions)
    first = made.where(bad).select(*keys, "embedding").limit(1).collect()
    if first and first[0]["embedding"] is None:
        raise ValueError("no embedding for record '{}' ontology '{}' query_text '{}'".format(*first[0][:3]))
    if first:
        raise ValueError(f"an embedding has {len(first[0]['embedding'])} dimensions, the terms of {first[0]['ontology']} have {dimensions}")
    return made


def assembled(plans: DataFrame, matches: DataFrame, order: str, threshold: float = 0.7) -> DataFrame:
    """(record_id, buckets, flags): for each record its buckets in the order of its mappings, each with its texts and
    their matches, and the plan's flags followed by those of its texts, which stand by ontology in the order in which
    ontologies first appear.

    plans: record_id, flags, mappings; ``order``: their column that orders records. matches: record_id, bucket, place,
    term_id, label, score, rank. Records with one id become one, whose buckets follow one another and whose flags are
    those of the last; a text without matches has an empty list."""
    rows = plans.select(F.col(order).alias("_order"), "record_id", "flags", F.posexplode_outer("mappings").alias("bucket", "m"))
    texts = rows.select("_order", "record_id", "bucket", F.col("m.ontology").alias("ontology"), F.posexplode_outer("m.query_texts").alias("place", "text"))
    found = matches.groupBy("record_id", "bucket", "place").agg(F.array_sort(F.collect_list(F.struct("rank", "term_id", "label", "score"))).alias("matches"))
    none = F.array().cast(found.schema["matches"].dataType)
    held = texts.join(found, ["record_id", "bucket", "place"], "left").withColumn("matches", F.coalesce("matches", none))
    score = F.col("matches")[0]["score"]
    told = F.when(F.size("matches") == 0, F.format_string("%s: no matches found for query '%s'", "ontology", "text")).when(score < threshold, F.format_string("%s: top match score %s below threshold %s for query '%s'", "ontology", three_decimals(score), F.lit(str(threshold)), "text"))
    held = held.withColumn("flag", F.when(F.col("text").isNotNull(), told))
    turn = texts.where("ontology is not null").groupBy("ontology").agg(F.min(F.struct("_order", "bucket")).alias("turn"))  # a row for each ontology
    held = held.join(turn, "ontology", "left")
    by_bucket = held.where("bucket is not null").groupBy("record_id", "_order", "bucket", "ontology").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("place", "text", "matches")))).alias("query_texts"))
    buckets = by_bucket.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_order", "bucket", "ontology", "query_texts"))), lambda b: F.struct(b["ontology"].alias("ontology"), b["query_texts"].alias("query_texts"))).alias("buckets"))
    raised = held.where("flag is not null").groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "_order", "bucket", "place", "flag"))), lambda x: x["flag"]).alias("raised"))
    own = plans.groupBy("record_id").agg(F.max_by(F.coalesce("flags", F.array().cast("array<string>")), order).alias("own"))
    out = own.join(buckets, "record_id", "left").join(raised, "record_id", "left")
    return out.select("record_id", F.coalesce("buckets", F.array().cast(buckets.schema["buckets"].dataType)).alias("buckets"), F.concat("own", F.coalesce("raised", F.array().cast("array<string>"))).alias("flags"))


def empty_buckets(buckets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(record, flag): a flag for each bucket (record, bucket) in which no candidate was found."""
    return buckets.select("record", "bucket").distinct().join(candidates.select("record", "bucket").distinct(), ["record", "bucket"], "left_anti").select("record", F.concat(F.lit("empty_rag_"), "bucket").alias("flag"))
