"""Stages of a batch run: which of them run, what they need, and where each leaves its rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """run(spark, *inputs) makes the rows of ``name`` from the rows of ``needs``; ``check`` says what is wrong with them once
    they are written, None if nothing is."""

    name: str
    needs: tuple[str, ...]
    run: Callable[..., DataFrame]
    check: Callable[[DataFrame], str | None] | None = None


def chosen(stages: list[Stage], only: str | None = None, start: str | None = None, stop: str | None = None) -> list[Stage]:
    """The stages named by only, or those from start to stop."""
    names = [s.name for s in stages]
    for n in (only, start, stop):
        if n is not None and n not in names:
            raise ValueError(f"unknown stage {n}; there are {', '.join(names)}")
    if only:
        return [stages[names.index(only)]]
    made = stages[names.index(start) if start else 0 : names.index(stop) + 1 if stop else None]
    if not made:
        raise ValueError(f"{start} comes after {stop}")
    return made


def missing(stages: list[Stage], there: set[str]) -> list[str]:
    """What a stage needs that neither is there nor is made by a stage before it."""
    out, have = [], set(there)
    for s in stages:
        out += [n for n in s.needs if n not in have]
        have.add(s.name)
    return out


def holds(*columns: str, least: int = 1) -> Callable[[DataFrame], str | None]:
    """A check that rows have the columns, without nulls in them, and are so many at least."""

    def check(made: DataFrame) -> str | None:
        lack = [c for c in columns if c not in made.columns]
        if lack:
            return f"no column {', '.join(lack)}"
        row = made.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(columns))).first()
        if row["n"] < least:
            return f"{row['n']} rows, {least} at least were expected"
        empty = [c for i, c in enumerate(columns) if row[f"null_{i}"]]
        return f"nulls in {', '.join(empty)}" if empty else None

    return check


def run(spark: SparkSession, stages: list[Stage], folder: str, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Runs stages in order; each is written as Parquet to the folder and read from there by the next, so that a run can
    start again from any stage. A stage whose check fails ends the run."""
    made = dict(inputs)
    if lack := missing(stages, set(made)):
        raise ValueError(f"missing inputs: {', '.join(lack)}")
    for s in stages:
        s.run(spark, *(made[n] for n in s.needs)).write.mode("overwrite").parquet(f"{folder}/{s.name}")
        made[s.name] = spark.read.parquet(f"{folder}/{s.name}")
        if s.check and (wrong := s.check(made[s.name])):
            raise ValueError(f"stage {s.name}: {wrong}")
    return made
