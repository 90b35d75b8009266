"""Paths into nested records: reading, dropping and choosing fields by their dotted names.

In a name, DOT stands for a dot that belongs to a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K


def parts(path: str) -> list[str]:
    return [p.replace("DOT", ".") for p in path.split(".")]


def type_at(schema: K.StructType, path: str) -> K.DataType | None:
    """The type of what a path leads to, or None where it leads nowhere."""
    now: K.DataType | None = schema
    for p in parts(path):
        now = next((f.dataType for f in now.fields if f.name == p), None) if isinstance(now, K.StructType) else None
    return now


def field(df: DataFrame, path: str) -> Column:
    """What a path leads to; one that the schema does not have raises."""
    if type_at(df.schema, path) is None:
        raise ValueError(f"no field {path}")
    first, *rest = parts(path)
    out = F.col(f"`{first}`")
    for p in rest:
        out = out.getField(p)
    return out


def elided(df: DataFrame, paths: list[str]) -> DataFrame:
    """df without the fields that the paths lead to; a path that leads nowhere changes nothing."""
    for path in paths:
        if type_at(df.schema, path) is None:
            continue
        first, *rest = parts(path)
        quoted = ".".join(f"`{p}`" for p in rest)
        df = df.withColumn(first, F.col(f"`{first}`").dropFields(quoted)) if rest else df.drop(F.col(f"`{first}`"))
    return df


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """All columns but the named ones."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in set(names)))


def ignored(path: str, stops: list[str]) -> bool:
    """Whether a path is on the stop-list, by itself or below one that is."""
    return any(path == s or path.startswith(s + ".") for s in stops)


def relevant(df: DataFrame, considered: list[str], stops: list[str]) -> DataFrame:
    """The considered fields that are there and not ignored, named by the last part of their path; of two with one name
    the later counts."""
    chosen = {parts(p)[-1]: p for p in considered if not ignored(p, stops) and type_at(df.schema, p) is not None}
    return df.select(*(field(df, p).alias(name) for name, p in chosen.items()))


def own_terms(terms: DataFrame, prefix: str) -> DataFrame:
    """The terms whose id has the ontology's own prefix."""
    return terms.where(F.split_part("id", F.lit(":"), F.lit(1)) == prefix)
