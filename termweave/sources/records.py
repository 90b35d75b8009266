"""Readers and writers of record files, and imports that take all of a file or nothing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_FIELDS, MOST_LEVELS, MOST_BYTES = 500, 30, 64 << 20
MOST_COLUMNS = 2000
REPORT_BYTES, REPORT_ROWS, PAIR_BYTES, PAIR_ROWS = 1 << 20, 100_000, 16 << 20, 10_000
SOURCE = "array<struct<path:string,name:string,value:string>>"
PLAN = f"record_id string, mappings array<struct<ontology:string,src_fields:{SOURCE},query_texts:array<string>>>, flags array<string>"
MATCH = "struct<term_id:string,term_name:string,label:string,score:double,rank:int>"
RETRIEVAL = f"record_id string, buckets array<struct<ontology:string,src_fields:{SOURCE},query_texts:array<struct<text:string,matches:array<{MATCH}>>>>>, flags array<string>"


def read_jsonl(spark: SparkSession, path: str, schema: str, ids: DataFrame | None = None, id_col: str = "record_id", limit: int | None = None) -> DataFrame:
    """Rows of a JSONL file, plain or gzipped; blank lines and lines that do not parse are left out, and rows whose id
    is not among ids. ``limit`` counts rows that are given; 0 or None is all."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.where("_corrupt is null").drop("_corrupt")
    if ids is not None:
        rows = rows.join(ids.select(id_col).distinct(), id_col, "left_semi")
    return rows.limit(limit) if limit else rows


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """Plans with their flags, none where a line has no flags."""
    return read_jsonl(spark, path, PLAN).withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def read_retrieval(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval results, one row for each record."""
    return read_jsonl(spark, path, RETRIEVAL).withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def matches_of(retrieval: DataFrame) -> DataFrame:
    """(record, bucket, term_id, label, score) of every match, for ``retrieve.merged``; a bucket is its ontology."""
    buckets = retrieval.select(F.col("record_id").alias("record"), F.explode("buckets").alias("b"))
    texts = buckets.select("record", F.col("b.ontology").alias("bucket"), F.explode("b.query_texts").alias("t"))
    return texts.select("record", "bucket", F.explode("t.matches").alias("m")).select("record", "bucket", "m.term_id", "m.label", "m.score")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A gold table from CSV with a header, JSON lines or a JSON array, by the name of its file."""
    return spark.read.option("header", "true").csv(path) if path.endswith(".csv") else spark.read.option("multiLine", str(path.endswith(".json")).lower()).json(path)


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """Proposals from JSON lines (.jsonl) or a JSON array (.json)."""
    return spark.read.option("multiLine", str(path.endswith(".json")).lower()).json(path)


def read_texts(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """(id, text) of documents to embed: a Parquet table, or a text file with a document in each line that is not blank."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("id", F.col(column).alias("text"))
    return numbered_lines(spark, path).where("trim(value) <> ''").select(F.col("line").cast("string").alias("id"), F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines counted from 1 within their file. Splits of a file are read in parallel; how many lines
    lie before a split comes from a count of each, a small row that is sent to all tasks."""
    row = F.monotonically_increasing_id().alias("row")
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), row, "value")
    counts = raw.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("file", "start", (before - F.col("first") + 1).alias("shift"))
    return raw.join(F.broadcast(offsets), ["file", "start"]).select("file", (F.col("row") + F.col("shift")).alias("line"), "value")


def write_jsonl(df: DataFrame, path: str, order: str | None = None, compress: bool = False) -> None:
    """One JSON object a line with nulls kept; sorted across files if an order is given."""
    rows = df.orderBy(order) if order else df
    rows.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.option("compression", "gzip" if compress else "none").text(path)


def jsonl_to_parquet(spark: SparkSession, path: str, out: str) -> None:
    """The whole file decides the schema."""
    spark.read.json(path).write.option("compression", "zstd").mode("overwrite").parquet(out)


def read_pages(spark: SparkSession, folder: str, schema: str, size: int = 50) -> DataFrame:
    """(page, pos, columns) of a folder of pages, each a JSON array in a file with the page's number, as a paged service
    gives them: up to the first page with fewer than ``size`` rows, or before the first number that is missing."""
    number = F.regexp_extract("_metadata.file_name", r"(\d+)\.json", 1)
    whole = spark.read.text(folder, wholetext=True).select(number.alias("page"), F.from_json("value", f"array<struct<{schema}>>").alias("items"))
    whole = whole.where("page <> ''").withColumn("page", F.col("page").cast("int"))
    sizes = whole.select("page", F.coalesce(F.size("items"), F.lit(0)).alias("n"))
    first, short = sizes.agg(F.min("page"), F.min(F.when(F.col("n") < size, F.col("page")))).first()
    gap = sizes.where(F.col("page") > first).join(sizes.select((F.col("page") + 1).alias("page")), "page", "left_anti").agg(F.min("page")).first()[0] if first is not None else None
    kept = whole if short is None else whole.where(F.col("page") <= short)
    kept = kept if gap is None else kept.where(F.col("page") < gap)
    return kept.select("page", F.posexplode("items").alias("pos", "item")).select("page", "pos", "item.*")


def read_links(spark: SparkSession, path: str, column: int) -> DataFrame:
    """(key, pos, target) of a tab-separated link file, first column the key; a short line raises when it is read."""
    lines = numbered_lines(spark, path).select(F.col("line").alias("pos"), F.split("value", "\t").alias("c")).where("c[0] <> ''")
    target = F.when(F.size("c") >= column, F.get("c", F.lit(column - 1))).otherwise(F.raise_error(F.lit(f"a line has fewer than {column} columns")))
    return lines.select(F.get("c", F.lit(0)).alias("key"), "pos", target.alias("target"))


def read_accessions(spark: SparkSession, path: str, column: int | str) -> DataFrame:
    """Distinct accessions of a tab-separated file with a header (column counted from 1) or of {column: {row: value}}."""
    if isinstance(column, int):
        c = F.get(F.split("value", "\t"), F.lit(column - 1))
        lines = numbered_lines(spark, path).where("line > 1")
        values = lines.select(F.trim(c).alias("accession"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>")[column].alias("m"))
        values = whole.select(F.explode(F.map_values("m")).alias("accession"))
    return values.where("accession <> ''").distinct()


def _violation(line: Column, required: list[str], most_bytes: int) -> Column:
    """What is wrong with a line, or null."""
    v = F.try_parse_json(line)
    kind = F.schema_of_variant(v)
    depth = F.aggregate(F.split(F.regexp_replace(F.regexp_replace(line, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", ""), ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda s, c: F.struct((s["d"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("d"), F.greatest(s["m"], s["d"] + F.when(c.isin("{", "["), 1).otherwise(0)).alias("m")), lambda s: s["m"])
    infinite = F.exists(F.regexp_extract_all(F.regexp_replace(line, r'"(?:[^"\\]|\\.)*"', '""'), F.lit(r"-?\d+(?:\.\d+)?[eE][+-]?\d+"), F.lit(0)), lambda x: F.abs(x.cast("double")) == float("inf"))
    out = F.when(F.octet_length(line) > most_bytes, "line too long").when(v.isNull(), "no JSON, or a key twice").when(~kind.startswith("OBJECT"), "no object").when(infinite, "number not finite").when(depth > MOST_LEVELS, "nested too deep")
    for name in required:
        of = F.try_variant_get(v, f"$['{name}']", "string")
        out = out.when(of.isNull() | (of == "") | (F.schema_of_variant(F.try_variant_get(v, f"$['{name}']", "variant")) != "STRING"), f"{name} must be a text")
    return out


def _pointers(v: dict, above: str = "") -> Iterator[str]:
    """The JSON pointers of an object's leaves; lists and empty objects are leaves."""
    for key, x in v.items():
        name = f"{above}/{key.replace('~', '~0').replace('/', '~1')}"
        if isinstance(x, dict) and x:
            yield from _pointers(x, name)
        else:
            yield name


def first_fields(lines: DataFrame, most: int = MOST_FIELDS) -> DataFrame:
    """(field, line) of the first ``most`` + 1 fields of (line, payload), with the first line that each is in. A task holds
    and sends on no more fields than that, those of its first lines: a later one has as many before it in any case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[str, int] = {}
        for batch in batches:
            if len(first) > most:
                continue
            for line, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = json.loads(payload)
                except (ValueError, RecursionError):
                    continue
                for name in _pointers(found) if isinstance(found, dict) else ():
                    first[name] = min(line, first.get(name, line))
                if len(first) > most:
                    break
        names = [n.encode("utf-8", "replace") for n in first]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array(list(first.values()), pa.int64())], ["field", "line"])

    found = lines.select(F.col("line").cast("long"), "payload").mapInArrow(run, "field string, line long")
    return found.groupBy("field").agg(F.min("line").alias("line")).orderBy("line", "field").limit(most + 1)


def strict_import(spark: SparkSession, path: str, required: list[str] = (), most_rows: int | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(line, payload) of every line that is not blank, if all are JSON objects within the limits and have the required
    texts; else a ValueError with the first bad line. Nothing is written before the whole file has passed."""
    lines = numbered_lines(spark, path)
    lines = lines.select("line", F.when(F.col("line") == 1, F.ltrim(F.col("value"), F.lit("﻿"))).otherwise(F.col("value")).alias("payload")).where("trim(payload) <> ''")
    bad = lines.select("line", _violation(F.col("payload"), list(required), most_bytes).alias("what")).where("what is not null").agg(F.min(F.struct("line", "what")).alias("first")).first()["first"]
    limit = first_fields(lines if bad is None else lines.where(F.col("line") < bad["line"])).agg(F.count("*").alias("n"), F.max("line").alias("line")).first()
    if limit["n"] > MOST_FIELDS:
        raise ValueError(f"line {limit['line']}: more than {MOST_FIELDS} fields")
    if bad:
        raise ValueError(f"line {bad['line']}: {bad['what']}")
    if most_rows is not None and lines.count() > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    return lines


def report_import(spark: SparkSession, path: str) -> DataFrame:
    """(line, payload) of a report: objects with texts record_id and run_id, within a report's limits."""
    return strict_import(spark, path, ["record_id", "run_id"], REPORT_ROWS, REPORT_BYTES)


def pair_import(spark: SparkSession, records: str, proposals: str) -> DataFrame:
    """(record_id, payload): each record with its proposal, as {"source_record": ..., "proposal": ...}. In both files each
    row needs a text record_id that no other row has, and both keep the limits of a small import; else a ValueError."""

    def side(path: str, name: str) -> DataFrame:
        rows = strict_import(spark, path, ["record_id"], PAIR_ROWS, PAIR_BYTES)
        rows = rows.select(F.try_variant_get(F.parse_json("payload"), "$.record_id", "string").alias("record_id"), "line", F.col("payload").alias(name))
        twice = rows.groupBy("record_id").agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n > 1").orderBy("line").first()
        if twice:
            raise ValueError(f"{path}, line {twice['line']}: each row needs a unique record_id")
        if (rows.agg(F.sum(F.octet_length(name))).first()[0] or 0) > PAIR_BYTES:
            raise ValueError(f"{path} exceeds {PAIR_BYTES >> 20} MiB")
        return rows.drop("line")

    raw = side(records, "record")
    if raw.isEmpty():
        raise ValueError("no source records")
    both = raw.join(side(proposals, "proposal"), "record_id", "left")
    return both.select("record_id", F.concat(F.lit('{"source_record":'), "record", F.lit(',"proposal":'), F.coalesce("proposal", F.lit("null")), F.lit("}")).alias("payload"))


def write_lines(df: DataFrame, column: str, path: str, order: list[Column | str] = ()) -> None:
    """A text column as lines: exports of payloads, reports and graphs. In order, files are ranges of the order."""
    (df.orderBy(*order) if order else df).select(F.col(column).alias("value")).write.text(path)


def write_evaluation(df: DataFrame, path: str, run_id: str) -> None:
    """Evaluation rows as JSON lines with run_id first and NaN as null, to path, or below it by the name of the run."""
    plain = [F.when(~F.isnan(c), F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes if c != "run_id"]
    target = path if path.endswith(".jsonl") else f"{path}/{run_id}.jsonl"
    write_jsonl(df.select(F.lit(run_id).alias("run_id"), *plain), target)


def write_csv(df: DataFrame, path: str, order: list[str] = ()) -> None:
    (df.orderBy(*order) if order else df).write.option("header", "true").csv(path)


def write_word_matrix(words: DataFrame, path: str) -> None:
    """words (word, embedding) as Parquet with a row for each dimension and a column for each word: for vocabularies of as
    many words as a table may have columns. Other embeddings are written as they are."""
    rows = words.select("word", F.posexplode("embedding").alias("dim", "x"))
    names = [r[0] for r in words.select("word").distinct().orderBy("word").limit(MOST_COLUMNS + 1).collect()]
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} words")
    rows.groupBy("dim").pivot("word", names).agg(F.first("x")).orderBy("dim").drop("dim").write.parquet(path)


def write_parquet(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Tables of embeddings and vectors, in folders by the given columns, so that a reader of one ontology reads its own."""
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)


def with_run_id(df: DataFrame) -> DataFrame:
    """The name of the folder that a row's file lies in, as the first column run_id, in place of any other."""
    run = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return df.select(run.alias("run_id"), *(c for c in df.columns if c != "run_id"))
