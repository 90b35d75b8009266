"""Where the operators of this subpackage keep what they cut their lineage with."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.plans.session import checkpoints


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names."""
    return (spark.conf.get("spark.checkpoint.dir", None) or checkpoints(spark)).rstrip("/")


def written(df: DataFrame, name: str, made: list[str] | None = None, compression: str = "snappy") -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and read from there: a lost executor costs no
    recomputation. The path is added to made, for ``removed``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if made is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.rests_in = path
    return out


def at_rest(df: DataFrame) -> bool:
    """Whether df is what ``written`` gave."""
    return hasattr(df, "rests_in")


def folder(df: DataFrame) -> str:
    return df.rests_in


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(df: DataFrame, made: list[str]) -> tuple[DataFrame, str]:
    """df with a number for each row, and that column's name. The numbers are given once and written: a scan that is
    run again over other splits, as when executors come or go, would give rows other numbers."""
    name = fresh(df, "row")
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered", made, "zstd"), name


FILES = 20_000  # files whose numbers are sent to all tasks, at most


def identified(df: DataFrame, made: list[str]) -> tuple[DataFrame, str]:
    """df with a number for each row that does not depend on how files are split, and that column's name: of a table that
    is read from files the file's place in the order of paths and the row's place in it, else as ``numbered``."""
    if "_metadata" not in df.columns:
        try:
            placed = df.select("*", F.col("_metadata.file_path").alias(path := fresh(df, "path")), F.col("_metadata.row_index").alias(at := fresh(df, "at")))
        except AnalysisException:
            placed = None
        if placed is not None:
            paths = sorted(r[0] for r in placed.select(path).distinct().limit(FILES + 1).collect())
            if 0 < len(paths) <= FILES:
                spark, name, number = df.sparkSession, fresh(df, "row"), fresh(df, "number")
                numbers = spark.createDataFrame(list(zip(paths, range(len(paths)), strict=True)), f"{path} string, {number} long")
                row = F.shiftleft(F.col(number), 40) + F.col(at)
                return placed.join(F.broadcast(numbers), path).select(*(F.col(f"`{c}`") for c in df.columns), row.alias(name)), name
    return numbered(df, made)


def removed(spark: SparkSession, made: list[str]) -> None:
    """Deletes tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while made:
        path = jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written meanwhile send no more than so many rows to a Python worker at once: for rows that hold lists."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
