"""Operator 1, token counts: pieces are counted once per distinct pre-token, joined to per-document pre-token
frequencies and summed; no document's ids are ever materialised.

A pre-token is a run of spaces with the word behind it, a word that follows a line break, a line break, or the signs
behind a word. The vocabulary has no piece in which a space mark follows another character or one of these signs a
letter, and none with a line break, so merges never cross these cuts and the sum over pre-tokens is the count of the
whole text. ``check_cuts`` proves that for a model.

Plan: documents -> (pre-token, which rows of this slice have it, how often), one row per slice and distinct pre-token
-> all rows of a pre-token in one place -> its pieces, counted there once and joined to those rows -> explode -> sum by
row. What is shuffled is the index, once, and not the text; a frequent pre-token has one row per slice, and adaptive
execution may split a partition that grows too large. Rows are sorted there, so that each pre-token is counted once (and
once more for a part of its rows that was split off).

Defined results: null or empty text has 0 bytes and 0 tokens; each row of the input gives one row, so that repeated
rows and null ids come back as often as they went in; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm._spark import identified, table

SLICE = 16 << 20  # bytes of text whose pre-tokens are indexed together
MARK = "▁"  # the model's sign for a space
BARE, MORE, WHOLE = "\x01", "\x02", "\x03"  # before a word without a space; for a further space; before a text in hex
SIGNS = ",.!?;:#$%&*"  # cut off behind a letter
ROWS = 1 << 15  # rows of a slice at most, so that a row and a count share 32 bits


@cache
def processor(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    check_cuts(model)
    return model


def check_cuts(model) -> None:
    """Raises if a piece of the model could stretch over a cut between pre-tokens."""
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        if any(b == "\n" or b == MARK != a or (b in SIGNS and category(a)[0] == "L") for a, b in pairwise(f"{MARK}{piece}")):
            raise ValueError(f"piece {piece!r} crosses a cut between pre-tokens")


def marked(texts: pa.Array) -> pa.Array:
    """The texts with single spaces exactly at the cuts between their pre-tokens."""
    texts = pc.replace_substring(texts, MARK, " ")
    odd = pc.or_(pc.match_substring_regex(texts, "  |^ "), pc.match_substring_regex(texts, f"[{BARE}{MORE}{WHOLE}\\x00]"))
    plain = pc.replace_substring(pc.replace_substring_regex(texts, f"(\\pL)([{SIGNS}])", f"\\1 {BARE}\\2"), "\n", f" \n {BARE}")
    if not pc.any(odd).as_py():
        return plain
    where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    rest = []
    for i in where.tolist():
        t = texts[i].as_py()
        if any(c in t for c in (BARE, MORE, WHOLE, "\x00")):
            rest.append(WHOLE + t.encode().hex())
        else:
            rest.append(re.sub(" ( +)", lambda m: " " + MORE * len(m[1]), " " + t)[1:].replace("\n", f" \n {BARE}"))
    return pc.replace_with_mask(plain, odd, pa.array(rest, plain.type))


def pieces(model, tokens: list[str]) -> list[int]:
    """The number of pieces of each marked pre-token."""
    asked, fixed, known = [], [], {"": 1, "\n": 1, BARE: 0}
    for t in tokens:
        if t in known:
            asked.append("")
            fixed.append(known[t])
        elif t[0] == WHOLE:
            asked.append(bytes.fromhex(t[1:]).decode())
            fixed.append(0)
        elif t[0] == BARE:  # behind a line break, of which the two first pieces are
            asked.append("\n" + t[1:])
            fixed.append(-2)
        else:
            asked.append(t.replace(MORE, MARK))
            fixed.append(0)
    return [len(ids) + n for ids, n in zip(model.encode(asked, num_threads=1), fixed, strict=True)]


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to (base, pretoken, posts): for each slice its distinct pre-tokens with the rows that have them, a
    post being (row - base) << 16 | count - 1 and a count above 65,536 several posts. A slice is of rows of one file."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        rows, a = batch.column(0).to_numpy(), 0
        while a < batch.num_rows:
            b = min(a + ROWS, max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SLICE, "right"))))
            base = int(rows[a])
            b = a + int(np.append(np.flatnonzero((rows[a:b] < base) | (rows[a:b] >= base + ROWS)), b - a)[0])
            part = batch.slice(a, b - a)
            a = b
            part = part.filter(pc.greater(pc.fill_null(pc.binary_length(part.column(1)), 0), 0))
            if not part.num_rows:
                continue
            found = pc.split_pattern(marked(part.column(1).cast(pa.large_string())), " ")
            code = found.flatten().dictionary_encode()
            row = np.repeat(part.column(0).to_numpy() - base, np.diff(found.offsets.to_numpy()))
            pair = np.sort((code.indices.to_numpy().astype(np.int64) << 16) | row)
            at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            count, pair = np.diff(np.append(at, len(pair))), pair[at]
            if len(count) and count.max() > 65536:
                parts = -(-count // 65536)
                pair, rest = np.repeat(pair, parts), np.repeat(count - 65536 * (parts - 1), parts)
                rest[np.concatenate(([False], pair[1:] == pair[:-1]))] = 65536
                count = rest
            off = np.searchsorted(pair >> 16, np.arange(len(code.dictionary) + 1)).astype(np.int32)
            posts = ((pair & 0xFFFF) << 16 | (count - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(off) - 1, base)), code.dictionary.cast(pa.string()), pa.ListArray.from_arrays(off, pa.array(posts))], ["base", "pretoken", "posts"])


def token_counts(docs: DataFrame, model_path: str, over: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > over) of every row, as sentencepiece counts whole texts."""
    made: list[str] = []
    rows, row = identified(docs, made)
    rows = rows.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    index = rows.select("row", "text").mapInArrow(frequencies, "base long, pretoken string, posts array<int>")

    @F.pandas_udf("int")
    def count(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, last = processor(model_path), {}
        for some in tokens:  # in order: a pre-token's rows follow one another, over the end of a batch as well
            code, found = pd.factorize(some)
            new = [t for t in found if t not in last]
            known = last | dict(zip(new, pieces(model, new), strict=True))
            yield pd.Series(np.array([known[t] for t in found], np.int32)[code])
            last = {some.iloc[-1]: known[some.iloc[-1]]} if len(some) else last

    located = index.hint("rebalance", "pretoken").sortWithinPartitions("pretoken").withColumn("pieces", count("pretoken"))
    shares = located.select("base", "pieces", F.explode("posts").alias("post"))
    row = (F.col("base") + F.shiftright("post", 16)).alias("row")
    sums = shares.groupBy(row).agg(F.sum(F.col("pieces") * (F.col("post").bitwiseAND(0xFFFF).cast("long") + 1)).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return rows.select("row", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")).join(sums, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > over).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
