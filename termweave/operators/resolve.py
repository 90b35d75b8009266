"""Rule-based planning and resolution of records, with the soft checks that flag doubtful results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from termweave.functions.text import confidence_of_score

# Words that point to an ontology, host names that are not sites, attributes with fields of their own.
CLINICAL = ["infection", "disease", "patient", "clinical", "sepsis", "pneumonia", "abscess", "wound"]
SITES = ["blood", "wound", "throat", "nasal", "swab", "skin", "lung", "tissue", "sputum", "urine", "stool"]
HOSTS = ["homo sapiens", "mus musculus", "human", "mouse"]
SKIPPED = ["isolation_source", "host", "strain", "geo_loc_name", "collection_date"]
FIELDS = [("isolation_source", "UBERON"), ("body_sample_site", "UBERON"), ("tissue", "UBERON"), ("disease", "MONDO"), ("environment", "ENVO")]


def has_word(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(c), w))


def _mapping(ontology: str, path: str, text: Column) -> Column:
    return F.struct(F.lit(ontology).alias("ontology"), F.lit(path).alias("path"), text.alias("query_text"))


def _listed(values: Column, path, rules: list[tuple[str, list[str]]]) -> Column:
    """Mappings of a list of texts: for each text one to every ontology of whose words it holds one."""

    def one(v: Column, i: Column) -> Column:
        text = F.nullif(F.trim(v), F.lit(""))
        return F.array(*(F.when(has_word(text, words), F.struct(F.lit(o).alias("ontology"), path(i).alias("path"), text.alias("query_text"))) for o, words in rules))

    return F.filter(F.flatten(F.transform(values, one)), lambda m: m.isNotNull())


def planned(records: DataFrame, error: str | None = None) -> DataFrame:
    """records with mappings (ontology, path, query_text) and flags: field values go to their ontology, host names only
    raise looks_like_host, notes, descriptions, comments (a text or a list) and further sample attributes (a map
    biosample_attrs) to MONDO or UBERON by the words in them; none: empty_record. ``error`` says why rules are used."""
    there = {f.name: f.dataType for f in records.schema}
    maps, hosts = [], []
    for name, ontology in FIELDS:
        if name in there:
            value = F.nullif(F.trim(F.col(name)), F.lit(""))
            host = F.coalesce(F.lower(value).isin(HOSTS), F.lit(False))
            maps.append(F.when(value.isNotNull() & ~host, F.array(_mapping(ontology, name, value))))
            hosts.append(F.when(host, F.array(F.lit("looks_like_host"))))
    for name in ("note", "biosample_description", "bioproject_title"):
        if name in there:
            maps.append(_listed(F.array(F.col(name)), lambda i, name=name: F.lit(name), [("MONDO", CLINICAL), ("UBERON", SITES)]))
    if "comments" in there:
        said = F.col("comments") if isinstance(there["comments"], K.ArrayType) else F.array(F.col("comments").cast("string"))
        maps.append(_listed(said, lambda i: F.concat(F.lit("comments["), i.cast("string"), F.lit("]")), [("MONDO", CLINICAL), ("UBERON", SITES[:8])]))
    if "biosample_attrs" in there:
        names = F.filter(F.map_keys("biosample_attrs"), lambda n: ~n.isin(SKIPPED))
        values = F.transform(names, lambda n: F.element_at("biosample_attrs", n))
        maps.append(_listed(values, lambda i: F.concat(F.lit("biosample."), F.get(names, i)), [("UBERON", SITES[:10]), ("MONDO", CLINICAL)]))
    empty = F.array().cast("array<struct<ontology:string,path:string,query_text:string>>")
    mappings = F.flatten(F.array(*(F.coalesce(m, empty) for m in maps), empty))
    texts = F.array().cast("array<string>")
    out = records.withColumn("mappings", mappings)
    none = F.when(F.size("mappings") == 0, F.array(F.lit("empty_record"))).otherwise(texts)
    told = F.array(F.lit(f"plan_agent_error: {error}")) if error else texts
    return out.withColumn("flags", F.concat(told, *(F.coalesce(h, texts) for h in hosts), none))


def plan_checks(plans: DataFrame, longest: int = 200) -> Column:
    """Flags of a plan's mappings."""
    m = F.col("mappings")
    texts, names = F.transform(m, lambda x: x["query_text"]), F.transform(m, lambda x: x["ontology"])
    tests = [
        (F.size(m) == 0, "no_mappings"),
        (F.exists(texts, lambda t: F.char_length(t) > longest), "long_query_text"),
        (F.size(F.array_distinct(texts)) < F.size(texts), "duplicate_query_texts"),
        (F.size(F.array_distinct(names)) < F.size(names), "duplicate_ontology_mappings"),
    ]
    return F.filter(F.array(*(F.when(t, F.lit(n)) for t, n in tests)), lambda x: x.isNotNull())


def retrieve_checks(buckets: Column, least: float = 0.5) -> Column:
    """Flags of a record's buckets (ontology, candidates with curie and score): none found, one found twice in a bucket,
    or nothing in it that scores ``least``."""

    def told(test, name: str) -> Column:
        return F.transform(F.filter(buckets, test), lambda b: F.concat(F.lit(f"{name}_"), b["ontology"]))

    curies = lambda b: F.transform(b["candidates"], lambda c: c["curie"])
    size = lambda b: F.coalesce(F.size(b["candidates"]), F.lit(0))
    best = lambda b: F.array_max(F.transform(b["candidates"], lambda c: c["score"]))
    found = F.concat(told(lambda b: size(b) <= 0, "empty_rag"), told(lambda b: F.size(F.array_distinct(curies(b))) < F.size(curies(b)), "duplicate_curies"), told(lambda b: (size(b) > 0) & (best(b) < least), "low_scores"))
    return F.array_distinct(found)


def resolve_checks(made: DataFrame) -> DataFrame:
    """made (terms with ontology, term_id, role and confidence; candidate_curies, abstain_reason, flags, outcome) with
    further flags, a reason where there is neither a term nor a reason, and the outcome that follows from both."""
    t, none = F.col("terms"), F.size("terms") == 0
    primary = F.transform(F.filter(t, lambda x: x["role"] == "primary"), lambda x: x["ontology"])
    no_reason = none & (F.coalesce("abstain_reason", F.lit("")) == "")
    tests = [
        (F.size(F.array_except(F.transform(t, lambda x: x["term_id"]), F.col("candidate_curies"))) > 0, "term_not_in_candidates"),
        (no_reason, "empty_terms_no_reason"),
        (F.size(F.array_distinct(primary)) < F.size(primary), "multiple_primary_same_ontology"),
        (F.exists(t, lambda x: ~F.coalesce(x["confidence"].isin("low", "medium", "high"), F.lit(False))), "invalid_confidence"),
        (F.exists(t, lambda x: (x["role"] == "primary") & (x["confidence"] == "low")), "low_confidence_primary"),
    ]
    new = F.filter(F.array(*(F.when(test, F.lit(name)) for test, name in tests)), lambda x: x.isNotNull())
    flags = F.array_union("flags", new)
    after = F.when(F.size(flags) == 0, "proposed").when(F.col("outcome") == "proposed", "proposed_with_flags").otherwise(F.col("outcome"))
    return made.withColumns({"flags": flags, "abstain_reason": F.when(no_reason, "Unknown reason (flagged by checker)").otherwise(F.col("abstain_reason")), "outcome": F.when(none, "insufficient_evidence").otherwise(after)})


def best_scores(candidates: DataFrame) -> DataFrame:
    """(record, term_id, score): the best score of each term over a record's buckets."""
    return candidates.groupBy("record", "term_id").agg(F.max("score").alias("score"))


def resolved(candidates: DataFrame, records: DataFrame, least: float = 0.8, error: str | None = None) -> DataFrame:
    """candidates (record, bucket, term_id, label, score, rank) to (record, terms, outcome, candidate_curies, flags,
    abstain_reason): of each bucket the first candidate if it scores above ``least``; records without one lack evidence.
    ``error`` says why rules are used. A term has the role primary and a confidence by its score."""
    term = F.struct("bucket", "term_id", "label", "score", F.lit("primary").alias("role"), confidence_of_score(F.col("score")).alias("confidence"))
    chosen = F.col("rank") == 0
    lists = candidates.groupBy("record").agg(F.array_sort(F.collect_list(F.when(chosen & (F.col("score") > least), term))).alias("terms"), F.array_sort(F.collect_set("term_id")).alias("candidate_curies"))
    both = records.select("record").distinct().join(lists, "record", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c)
    out = both.select("record", empty("terms"), empty("candidate_curies"))
    some = F.size("terms") > 0
    told = F.array(F.lit(f"resolve_agent_error: {error}")) if error else F.array().cast("array<string>")
    reason = F.when(~some, F.lit(f"Resolve agent failed: {error}" if error else "No terms selected"))
    return out.withColumns({"outcome": F.when(some, "proposed_with_flags").otherwise("insufficient_evidence"), "flags": told, "abstain_reason": reason})


def invented(terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """The proposed (record, term_id) that no retrieval found: to be dropped, whatever proposed them."""
    return terms.join(candidates.select("record", "term_id").distinct(), ["record", "term_id"], "left_anti")


def outcome(terms: Column, flags: Column) -> Column:
    """proposed, proposed_with_flags or insufficient_evidence."""
    return F.when(F.size(terms) == 0, "insufficient_evidence").when(F.size(flags) > 0, "proposed_with_flags").otherwise("proposed")


def merged_flags(own: Column, upstream: Column) -> Column:
    """Flags of earlier stages join the others after the outcome is fixed: a sorted set."""
    return F.array_sort(F.array_union(own, upstream))
