"""The SQL gateway: tables as views, and single reading statements with a bounded number of rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MOST_ROWS = 500


def register(spark: SparkSession, tables: dict[str, str]) -> list[str]:
    """A view for each name over the Parquet files at its path."""
    for name, path in tables.items():
        spark.read.option("mergeSchema", "true").parquet(path).createOrReplaceTempView(name)
    return sorted(tables)


def ask(spark: SparkSession, statement: str, limit: int = MOST_ROWS) -> DataFrame:
    """The first rows of a SELECT, WITH or DESCRIBE statement, at most ``MOST_ROWS``; anything else is refused."""
    text = statement.strip().rstrip(";").strip()
    if not re.match(r"(?i)(select|with|describe)\b", text) or ";" in re.sub(r"'(?:[^'\\]|\\.)*'", "", text):
        raise ValueError("one SELECT, WITH or DESCRIBE statement is allowed")
    if re.match(r"(?i)with\b", text) and re.search(r"(?i)\b(insert|merge|update|delete)\b", re.sub(r"'(?:[^'\\]|\\.)*'", "", text)):
        raise ValueError("the statement must only read")
    return spark.sql(text).limit(max(1, min(int(limit), MOST_ROWS)))


def describe(spark: SparkSession, name: str) -> DataFrame:
    if not re.fullmatch(r"\w+", name):
        raise ValueError("not a table name")
    return spark.sql(f"describe table {name}")
