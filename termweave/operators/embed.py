"""Vectors of texts: a model is loaded once in each Python worker and run over batches of texts.

A model is a ``Model``: a loader, which a worker calls once, of two functions. One cuts a text into tokens, the other gives
the vectors of a batch: for lists of tokens an array (texts, tokens, dimensions) and the mask of the tokens that are
there. Pooling is here: the mean over the tokens that are there, or the first token's vector. ``HASHED`` is a model that
needs no file: a token's vector counts its character trigrams, hashed, with signs.

Defined results: a null text, and one without tokens, has the vector of zeros and no tokens; repeated texts have equal
vectors; other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

BATCH = 32  # texts that a model sees at once
MOST_TOKENS = 512  # of a text, as transformer models take; None is all

Tokens = Callable[[str], list[str]]
Vectors = Callable[[list[list[str]]], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Model:
    """``load`` gives the functions; ``pooling`` is mean or first."""

    name: str
    dimensions: int
    load: Callable[[], tuple[Tokens, Vectors]]
    pooling: str = "mean"


def hashed(dimensions: int) -> tuple[Tokens, Vectors]:
    """Tokens are runs of ASCII letters and digits, lower-cased; the trigrams of #token# are hashed with md5: its first four
    hex digits choose the dimension, the parity of the fifth the sign."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    @cache
    def trigram(t: str) -> tuple[int, int]:
        h = hashlib.md5(t.encode()).hexdigest()
        return int(h[:4], 16) % dimensions, 1 - 2 * (int(h[4], 16) % 2)

    def vectors(batch: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        width = max(map(len, batch), default=0)
        out, mask = np.zeros((len(batch), width, dimensions)), np.zeros((len(batch), width), bool)
        for i, tokens in enumerate(batch):
            mask[i, : len(tokens)] = True
            for j, token in enumerate(tokens):
                marked = f"#{token}#"
                for k in range(len(token)):
                    at, sign = trigram(marked[k : k + 3])
                    out[i, j, at] += sign
        return out, mask

    return lambda text: re.findall("[a-z0-9]+", text.translate(lower)), vectors


HASHED = Model("hashed", 16, lambda: hashed(16))


def pooled(vectors: np.ndarray, mask: np.ndarray, pooling: str) -> np.ndarray:
    """One vector for each text, zeros where no token is there."""
    if pooling == "first":
        return np.where(mask[:, :1], vectors[:, 0], 0.0) if vectors.shape[1] else np.zeros((len(vectors), vectors.shape[2]))
    n = np.maximum(mask.sum(1, keepdims=True), 1)
    return (vectors * mask[:, :, None]).sum(1) / n


def embed(texts: DataFrame, column: str, model: Model = HASHED, batch: int = BATCH, most_tokens: int | None = MOST_TOKENS) -> DataFrame:
    """texts with n_tokens and embedding. Texts of one length stand together in a batch of the model, as padding costs as
    much as text does; a batch never holds more than an Arrow batch's rows."""
    if model.pooling not in ("mean", "first"):
        raise ValueError(f"pooling {model.pooling!r}: mean or first")
    taken = {"n_tokens", "embedding"} & {c.lower() for c in texts.columns}
    if taken:
        raise ValueError(f"columns {', '.join(sorted(taken))} are there already")
    at = texts.columns.index(column)
    shape = StructType([*texts.schema, StructField("n_tokens", IntegerType()), StructField("embedding", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, vectors = model.load()  # once for all batches of a task
        for rows in batches:
            tokens = [cut(t or "")[:most_tokens] for t in rows.column(at).to_pylist()]
            out = np.zeros((len(tokens), model.dimensions))
            order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                out[some] = pooled(*vectors([tokens[i] for i in some]), model.pooling)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), model.dimensions).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([len(t) for t in tokens], pa.int32()), lists], shape.names)

    return texts.mapInArrow(run, shape)


def answered(asked: DataFrame, model: Model = HASHED) -> DataFrame:
    """asked (record_id, bucket, place, ontology, query_text, as ``retrieve.requests`` gives them) with their embedding; a
    text that is asked for often is embedded once."""
    once = embed(asked.select("query_text").where("query_text is not null").distinct(), "query_text", model).drop("n_tokens")
    return asked.join(once, "query_text").select(*asked.columns, "embedding")
