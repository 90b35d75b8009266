"""The record explorer: typed filters over the leaves of schemaless records, search, sorting, pages, reports."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPERATORS = ("contains", "eq", "ne", "gt", "gte", "lt", "lte", "null", "missing", "exists")
MOST_FILTERS = 20
SIZES = (25, 50, 100)


def kind(value: Column) -> Column:
    """null, boolean, number, text or json of a variant."""
    t = F.schema_of_variant(value)
    return F.when(t == "VOID", "null").when(t == "BOOLEAN", "boolean").when(t == "STRING", "text").when(F.rlike(t, F.lit("^(ARRAY|OBJECT)")), "json").otherwise("number")


def leaves(records: DataFrame, depth: int = 30) -> DataFrame:
    """records (record_id, payload as JSON text) to (record_id, field, kind, value): a JSON pointer for each leaf;
    arrays and empty objects stay one json leaf. Each level of nesting is one explode; payloads that are no JSON
    objects give nothing, and nesting deeper than ``depth`` raises."""
    now = records.select("record_id", F.lit("").alias("field"), F.try_parse_json("payload").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT<"))
    out = None
    for _ in range(depth + 1):
        inside = now.sparkSession.tvf.variant_explode(F.col("v").outer())
        steps = now.lateralJoin(inside).select("record_id", "field", "key", F.col("value").alias("v"))
        named = steps.withColumn("field", F.concat("field", F.lit("/"), F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))).drop("key")
        nested = F.schema_of_variant("v").startswith("OBJECT<") & (F.schema_of_variant("v") != "OBJECT<>")
        text = F.when(kind(F.col("v")) == "json", F.to_json("v")).otherwise(F.expr("cast(v as string)"))
        done = named.where(~nested).select("record_id", "field", kind(F.col("v")).alias("kind"), text.alias("value"))
        out = done if out is None else out.unionByName(done)
        now = named.where(nested)
        if now.limit(1).count() == 0:
            return out
    raise ValueError(f"nested deeper than {depth} levels")


def dictionary(values: DataFrame) -> DataFrame:
    """(field, kinds): the sorted kinds of each field."""
    return values.groupBy("field").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def condition(operator: str, value: str | float | None, numeric: bool, of: Column | None = None, text: Column | None = None) -> Column:
    """Whether a leaf (columns kind and value, or ``of`` and ``text``) matches; ``numeric`` says that the field holds
    nothing but numbers and nulls."""
    of, text = F.col("kind") if of is None else of, F.col("value") if text is None else text
    n, number = text.try_cast("double"), of == "number"
    if operator in ("gt", "gte", "lt", "lte") or operator in ("eq", "ne") and numeric:
        x = float(value)
        if not math.isfinite(x):
            raise ValueError("the operand must be finite")
        return number & {"gt": n > x, "gte": n >= x, "lt": n < x, "lte": n <= x, "eq": n == x, "ne": n != x}[operator]
    if operator == "contains":
        return F.coalesce(F.contains(F.lower(text), F.lower(F.lit(str(value)))), F.lit(False))
    if operator in ("eq", "ne"):
        return (text == str(value)) if operator == "eq" else (text != str(value))
    return {"null": of == "null", "exists": F.lit(True)}[operator]


def place(field_name: str) -> str:
    """The path of a field in a variant."""
    keys = [k.replace("~1", "/").replace("~0", "~") for k in field_name.split("/")[1:]]
    return "$" + "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in keys)


def holds(payload: Column, name: str, operator: str, operand: str | float | None, numeric: bool) -> Column:
    """Whether a record's payload (JSON text) matches, as a condition on its row: the field alone is looked up, nothing
    is laid out or joined. A non-empty object is no leaf, so a field that leads to one is missing."""
    v = F.try_variant_get(F.try_parse_json(payload), place(name), "variant")
    t = F.schema_of_variant(v)
    there = v.isNotNull() & ~(t.startswith("OBJECT<") & (t != "OBJECT<>"))
    if operator == "missing":
        return ~there
    of = kind(v)
    text = F.when(of == "json", F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))
    return F.coalesce(there & condition(operator, operand, numeric, of, text), F.lit(False))


BUCKETS, SHARES = 64, 16  # folders of a leaf store, and files that one field's leaves are dealt to


class LeafStore:
    """Leaves (record_id, field, kind, value) written once as an index: folders by a hash of the field, rows in order of
    the field, so that what asks for one field reads one folder and in it the row groups of the field; and the dictionary
    as a small table of its own. A field that all records have is dealt over ``SHARES`` files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def bucket(name: Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")

    def write(self, values: DataFrame) -> LeafStore:
        placed = values.withColumn("bucket", self.bucket(F.col("field"))).repartition("bucket", F.pmod(F.xxhash64("record_id"), F.lit(SHARES)))
        placed.sortWithinPartitions("bucket", "field", "record_id").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/leaves")
        dictionary(self.leaves().select("field", "kind")).coalesce(1).write.parquet(f"{self.path}/fields")
        return self

    def leaves(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/leaves").drop("bucket")

    def fields(self) -> DataFrame:
        """(field, kinds), from the small table alone."""
        return self.spark.read.parquet(f"{self.path}/fields")

    def of(self, name: str) -> DataFrame:
        """The leaves of one field, from its folder alone."""
        number = self.spark.range(1).select(self.bucket(F.lit(name))).first()[0]
        return self.spark.read.parquet(f"{self.path}/leaves").where((F.col("bucket") == number) & (F.col("field") == name)).drop("bucket")

    def search(self, text: str, name: str | None = None) -> DataFrame:
        """The record_ids of which some leaf, or that of one field, contains the text; kinds are not read."""
        held = self.leaves() if name is None else self.of(name)
        return held.where(F.contains(F.lower("value"), F.lit(text.lower()))).select("record_id").distinct()

    def ordered(self, name: str, descending: bool = False) -> DataFrame:
        """(record_id, value) of one field in order, numbers as such where the field holds no other kind, null ones last."""
        row = self.fields().where(F.col("field") == name).first()
        key = F.col("value").try_cast("double") if row and set(row["kinds"]) <= {"number", "null"} else F.col("value")
        return self.of(name).select("record_id", "value").orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "record_id")


@dataclass
class Query:
    """What to show: filters (field, operator, operand) that must all hold, a text that some leaf contains, order, page."""

    filters: list[tuple[str, str, str | float | None]] = field(default_factory=list)
    search: str | None = None
    sort: str | None = None
    descending: bool = False
    page: int = 1
    size: int = 25

    def select(self, records: DataFrame, values: DataFrame | None, kinds: dict[str, list[str]]) -> DataFrame:
        """The records (record_id, payload, ...) that match: filters are conditions on the payload, which are checked as it
        is read; a searched text is looked for in the leaves ``values``, or where these are None in those of what is left.
        Without a search nothing is laid out."""
        if len(self.filters) > MOST_FILTERS:
            raise ValueError(f"more than {MOST_FILTERS} filters")
        out = records
        for name, operator, operand in self.filters:
            if operator not in OPERATORS or name not in kinds:
                raise ValueError(f"unknown operator or field: {operator} {name}")
            out = out.where(holds(F.col("payload"), name, operator, operand, set(kinds[name]) <= {"number", "null"}))
        if self.search:
            held = leaves(out) if values is None else values
            out = out.join(held.where(condition("contains", self.search, False)).select("record_id").distinct(), "record_id", "left_semi")
        return out

    def ordered(self, selected: DataFrame, values: DataFrame | None, kinds: dict[str, list[str]]) -> DataFrame:
        """In order, missing values last either way, ties by record_id; with the value sorted by as sort_value."""
        if not self.sort:
            return selected.orderBy("record_id")
        v = F.try_variant_get(F.try_parse_json("payload"), place(self.sort), "variant")
        leaf = F.when(kind(v) == "json", F.when(~(F.schema_of_variant(v).startswith("OBJECT<") & (F.schema_of_variant(v) != "OBJECT<>")), F.to_json(v))).otherwise(F.try_variant_get(v, "$", "string"))
        shown = selected.withColumn("sort_value", leaf)
        key = F.col("sort_value").try_cast("double") if set(kinds[self.sort]) <= {"number", "null"} else F.col("sort_value")
        return shown.orderBy(key.desc_nulls_last() if self.descending else key.asc_nulls_last(), "record_id")

    def paged(self, ordered: DataFrame) -> DataFrame:
        size = self.size if self.size in SIZES else SIZES[0]
        return ordered.offset((max(1, self.page) - 1) * size).limit(size)


def report_matches(records: DataFrame, entries: DataFrame) -> DataFrame:
    """(record_id, entry_id) of the exact two-key match of record_id and run_id; many to many is kept."""
    return records.select("record_id", "run_id").join(entries.select("entry_id", "record_id", "run_id"), ["record_id", "run_id"]).select("record_id", "entry_id")


def scope(records: DataFrame, entries: DataFrame, name: str) -> DataFrame:
    """all, matched (a row for each match), matched_records (each record once) or unmatched."""
    found = report_matches(records, entries)
    if name == "all":
        return records
    if name == "matched":
        return records.join(found, "record_id")
    return records.join(found.select("record_id").distinct(), "record_id", {"matched_records": "left_semi", "unmatched": "left_anti"}[name])


def commented(records: DataFrame, comments: DataFrame) -> DataFrame:
    """records with their comment, null without one."""
    return records.join(comments.select("record_id", "comment"), "record_id", "left")


def matched_view(records: DataFrame, entries: DataFrame, reports: DataFrame, comments: DataFrame, report_id: int | None = None, run: str | None = None, digest: str = "payload_hash") -> DataFrame:
    """A row for each record and distinct report entry that matches it, with the report's name and the record's comment.

    entries: entry_id, report_id, record_id, run_id, line, payload; of equal payloads of a report that match a record the
    first entry counts. Records, entries and reports may be cut down to one report or run."""
    own = entries
    if report_id is not None:
        own = own.where(F.col("report_id") == report_id)
    if run is not None:
        own = own.where(F.col("run_id").cast("string") == run)
    named = own.join(reports.select("report_id", F.col("name").alias("report_name")), "report_id")
    facts = named.select("record_id", "run_id", F.struct("entry_id", "report_id", F.col("line").alias("report_line"), F.col("payload").alias("report_payload"), "report_name").alias("e"))
    met = records.join(facts, ["record_id", "run_id"]).select(*records.columns, "e.*")
    first = met.groupBy("record_id", "report_id", F.sha2(F.to_json(F.try_parse_json("report_payload")), 256).alias(digest)).agg(F.min_by(F.struct(*(c for c in met.columns if c not in ("record_id", "report_id"))), "entry_id").alias("row"))
    return commented(first.select("record_id", "report_id", "row.*"), comments)


def in_matched_order(view: DataFrame, order: list[Column | str]) -> DataFrame:
    """The records' own order, then report, line and entry."""
    return view.orderBy(*order, "report_id", "report_line", "entry_id")


def results_of(view: DataFrame, record_id: object, page: int = 1, size: int = 25) -> DataFrame:
    """A page of a record's results: the newest report first, then by run and line."""
    return view.where(F.col("record_id") == record_id).orderBy(F.col("report_id").desc(), "run_id", "report_line").offset((max(1, page) - 1) * size).limit(size)


def comment_key(fields: list[str]) -> str:
    """A top-level key for comments that no record has: comments, comments_2, ..."""
    taken = {f.split("/")[1].replace("~1", "/").replace("~0", "~") for f in fields}
    key, n = "comments", 2
    while key in taken:
        key, n = f"comments_{n}", n + 1
    return key


def exported(key: str) -> Column:
    """The column payload as it is, or with the column comment as its last key where there is one."""
    body = F.rtrim(F.regexp_replace("payload", r"\s*\}\s*$", ""))
    pair = F.concat(F.substring(F.to_json(F.struct(F.col("comment").alias(key))), F.lit(2), F.lit(1 << 30)))
    return F.when(F.col("comment").isNull(), F.col("payload")).otherwise(F.concat(body, F.when(F.endswith(body, F.lit("{")), "").otherwise(","), pair))


def bioproject_accessions(payload: Column) -> Column:
    """The distinct accessions of a payload's bioprojects in order, joined by ', '; null without any."""
    listed = F.try_variant_get(F.try_parse_json(payload), "$.bioprojects", "array<variant>")
    texts = F.transform(listed, lambda p: F.when(F.schema_of_variant(F.try_variant_get(p, "$.accession", "variant")) == "STRING", F.nullif(F.trim(F.try_variant_get(p, "$.accession", "string")), F.lit(""))))
    return F.nullif(F.array_join(F.array_distinct(F.filter(texts, lambda t: t.isNotNull())), ", "), F.lit(""))


def within_budget(page: DataFrame, order: list[str], most_bytes: int = 8 << 20) -> tuple[list, int]:
    """The ids of a page's records whose payloads fit into so many bytes when they are taken in order, and how many did not
    fit; a later, smaller one may still fit. A page is at most 100 rows (``SIZES``), of which ids and lengths are fetched."""
    sizes = page.select(*dict.fromkeys(["record_id", *order]), F.octet_length("payload").alias("n")).orderBy(*order).limit(SIZES[-1]).collect()
    used, taken = 0, []
    for r in sizes:
        if used + r["n"] <= most_bytes:
            used += r["n"]
            taken.append(r["record_id"])
    return taken, len(sizes) - len(taken)


def unmatched_entries(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """The report entries that match no record."""
    return entries.join(matches.select("entry_id").distinct(), "entry_id", "left_anti")
