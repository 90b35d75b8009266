"""An extension: records that land as JSONL files are planned as they come, once each."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from termweave.operators.resolve import planned


def plan_landed(spark: SparkSession, folder: str, schema: str, out: str, state: str) -> StreamingQuery:
    """Plans all files that have come since the last call and ends; state remembers which they are."""
    rows = spark.readStream.schema(schema).json(folder)
    return planned(rows).writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
