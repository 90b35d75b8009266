"""The corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, secrets, packing.

Each stage works on all that its predecessor kept and is written as Parquet and read again. Rejected documents go; of
each group of near copies one document stays; documents that overlap a benchmark item go; secrets are masked in the
texts that stay; what is left is packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from termweave.llm import decontamination, neardup, packing, quality, secrets
from termweave.llm._spark import at_rest, folder, removed, table, written


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality.stage),
    ("near_dedup", neardup.stage),
    ("decontamination", decontamination.stage),
    ("secrets", secrets.stage),
    ("packing", pack),
]

#: SQL cannot express the classifier, so the stages are tested against brute force one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage whose result is a table of its own is not written again, and a table goes once the next is there."""
    docs, made = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        before = made
        docs = stage(spark, docs, sf_dir)
        made = [folder(docs)] if at_rest(docs) else []
        if not made:
            docs = written(docs, name, made)
        removed(spark, before)
    return docs
