"""Ontology files in OBO format: one stanza a row, parsed by Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stanzas(spark: SparkSession, path: str) -> DataFrame:
    """The [Term] stanzas (text) of a plain or gzipped file that are not obsolete."""
    rows = spark.read.option("lineSep", "\n\n").text(path).select(F.regexp_replace("value", "^\\n+|\\n+$", "").alias("text"))
    return rows.where(F.startswith("text", F.lit("[Term]")) & ~F.contains("text", F.lit("is_obsolete: true")))


def _lines(tag: str) -> Column:
    return F.transform(F.filter(F.split("text", "\n"), lambda x: F.startswith(x, F.lit(f"{tag}: "))), lambda x: F.substring(x, len(tag) + 3, 1 << 30))


def terms(spark: SparkSession, path: str) -> DataFrame:
    """id, name, definition, synonyms (text, scope), xrefs, is_a, part_of and properties of each term. Edges of general
    axioms (gci_) are left out, as they make cycles; a stanza without an id or a name has an empty one."""
    curie = lambda x: F.regexp_extract(x, r"^(\S+)", 1)
    plain = lambda a: F.transform(F.filter(a, lambda x: ~F.contains(x, F.lit("gci_"))), curie)
    part = F.transform(F.filter(_lines("relationship"), lambda x: F.startswith(x, F.lit("part_of ")) & ~F.contains(x, F.lit("gci_"))), lambda x: F.regexp_extract(x, r"^part_of (\S+)", 1))
    synonym = F.transform(_lines("synonym"), lambda x: F.struct(F.regexp_extract(x, r'^"((?:[^"\\]|\\.)*)"', 1).alias("text"), F.regexp_extract(x, r'" (EXACT|BROAD|NARROW|RELATED)', 1).alias("scope")))
    one = lambda tag: F.coalesce(F.get(_lines(tag), F.lit(0)), F.lit(""))
    pairs = F.transform(_lines("property_value"), lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("name"), F.regexp_replace(F.regexp_extract(x, r"^\S+ (.*)$", 1), r'^"|" xsd:\w+$|"$', "").alias("value")))
    return stanzas(spark, path).select(
        one("id").alias("id"), F.regexp_extract(one("id"), "^([^:]*):", 1).alias("prefix"), one("name").alias("name"), F.nullif(F.regexp_extract(one("def"), r'^"((?:[^"\\]|\\.)*)"', 1), F.lit("")).alias("definition"),
        synonym.alias("synonyms"), F.transform(_lines("xref"), curie).alias("xrefs"), plain(_lines("is_a")).alias("is_a"), part.alias("part_of"), pairs.alias("properties"),
    )


def names(made: DataFrame) -> DataFrame:
    """(id, name) in lower case."""
    return made.select("id", F.lower("name").alias("name"))
