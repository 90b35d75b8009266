"""Resolution by a client - a language model, or whatever else proposes terms - with a guard behind it.

A client is given as a loader, which each task calls once, of a function from a record's candidates, as a list of dicts
(curie, label, ontology, score), to a list of proposals, as dicts (curie, role, confidence). It runs in the tasks, a record
at a time. What it says is not trusted: a record on which it fails, or says what cannot be read, is resolved by rules, with
a flag that holds the error; a term that no retrieval found for the record is dropped, with a flag; scores, labels and
ontologies come from retrieval alone.

Defined results: a record without candidates is given an empty list; null scores and labels are passed on as None; a term
that is proposed twice counts once (the first role); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.text import confidence, confidence_of_score
from termweave.operators.resolve import outcome

Client = Callable[[list[dict]], list[dict]]
SAID = "array<struct<curie:string,role:string,confidence:string>>"
LONGEST = 200  # characters of an error that a flag keeps
REMOVED = "invented_curie_removed"


def asked(candidates: DataFrame, records: DataFrame, load: Callable[[], Client]) -> DataFrame:
    """(record, said, error) of every record; candidates: record, bucket, term_id, label, score, rank."""
    one = F.struct("bucket", "rank", F.col("term_id").cast("string").alias("curie"), "label", "score")
    lists = candidates.groupBy("record").agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    rows = records.select("record").distinct().join(lists, "record", "left")
    kind = rows.schema["record"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = load()
        for batch in batches:
            said, errors = [], []
            for found in batch.column(1).to_pylist():
                try:
                    told = client([{"curie": c["curie"], "label": c["label"], "ontology": c["bucket"], "score": c["score"]} for c in found or []])
                    said.append([{"curie": str(t["curie"]), "role": str(t.get("role") or "primary"), "confidence": str(t.get("confidence", ""))} for t in told])
                    errors.append(None)
                except Exception as e:  # whatever a client raises is that record's error
                    said.append(None)
                    errors.append(str(e)[:LONGEST] or type(e).__name__)
            item = pa.struct([(n, pa.string()) for n in ("curie", "role", "confidence")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.list_(item)), pa.array(errors, pa.string())], ["record", "said", "error"])

    return rows.mapInArrow(run, f"record {kind}, said {SAID}, error string")


def resolved_by(candidates: DataFrame, records: DataFrame, load: Callable[[], Client], least: float = 0.8) -> DataFrame:
    """(record, terms, outcome, candidate_curies, flags, abstain_reason), as ``resolve.resolved``, from what a client says.
    A client is asked once a record and task; checkpoint the result if it is used more than once."""
    said = asked(candidates, records, load)
    curies = candidates.groupBy("record").agg(F.array_sort(F.collect_set(F.col("term_id").cast("string"))).alias("candidate_curies"))
    scored = candidates.groupBy("record", F.col("term_id").cast("string").alias("curie")).agg(F.min_by(F.struct("bucket", "label", "score"), F.struct(-F.col("score"), "bucket")).alias("found"))
    best = candidates.where((F.col("rank") == 0) & (F.col("score") > least)).groupBy("record").agg(F.array_sort(F.collect_list(F.struct("bucket", F.col("term_id").cast("string").alias("curie"), "label", "score"))).alias("rules"))
    term = lambda bucket, curie, label, score, role, sure: F.struct(bucket.alias("bucket"), curie.alias("term_id"), label.alias("label"), score.alias("score"), role.alias("role"), sure.alias("confidence"))
    # the guard: what was said, joined with what was found
    named = said.select("record", F.posexplode("said").alias("i", "t")).groupBy("record", F.col("t.curie").alias("curie")).agg(F.min(F.struct("i", "t")).alias("first")).select("record", "curie", "first.*")
    guarded = named.join(scored, ["record", "curie"], "left")
    kept = F.when(F.col("found").isNotNull(), F.struct("i", term(F.col("found.bucket"), F.col("curie"), F.col("found.label"), F.col("found.score"), F.col("t.role"), confidence(F.col("t.confidence"))).alias("t")))
    told = guarded.groupBy("record").agg(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["t"]).alias("told"), F.max(F.col("found").isNull()).alias("some_invented"))
    both = said.select("record", "error").join(told, "record", "left").join(best, "record", "left").join(curies, "record", "left")
    by_rule = F.transform("rules", lambda r: term(r["bucket"], r["curie"], r["label"], r["score"], F.lit("primary"), confidence_of_score(r["score"])))
    none = lambda c, like: F.coalesce(c, F.array().cast(like))
    kind = both.schema["told"].dataType
    failed = F.col("error").isNotNull()
    flags = F.filter(F.array(F.when(failed, F.concat(F.lit("resolve_agent_error: "), "error")), F.when(F.col("some_invented"), REMOVED)), lambda f: f.isNotNull())
    out = both.select("record", none(F.when(failed, by_rule).otherwise(F.col("told")), kind).alias("terms"), none(F.col("candidate_curies"), "array<string>").alias("candidate_curies"), flags.alias("flags"), "error")
    nothing = F.size("terms") == 0
    reason = F.when(nothing, F.coalesce(F.concat(F.lit("Resolve agent failed: "), "error"), F.lit("No terms selected")))
    return out.withColumns({"outcome": outcome(F.col("terms"), F.col("flags")), "abstain_reason": reason}).drop("error")
