"""Operator 12, fill-in-middle transformation: each text is cut at two unit ends and its parts are put in another order.

Units (lines, or code points) are found with arithmetic on words of eight bytes: the UTF-8 bytes of a run of texts are read
as uint64, the bytes that end a unit are marked in all words at once without a carry between bytes, marks are counted for
each word, and the end of unit k of a text is found by a search in the running counts and a select inside the one word that
holds it. Nothing is cut into lists of lines, and no step looks at single bytes in Python.

Cuts and order come from a hash of a seed and the id, so a run that is repeated, or a task that is run again, gives the
same output. There is no shuffle. ``restored`` puts a text together again from output and form.

Defined results: a null text counts as empty, an empty text is plain with no units; a null id is hashed as the empty text;
rows that are equal give equal rows; a text that holds a sentinel stays plain; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from termweave.llm._spark import table
from termweave.llm._text import U, chunks

SEED = 7
RATE = 100  # per cent of the texts that are transformed
SPM = 50  # per cent of those that begin with the suffix
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ONES, LOW, HIGH = U(0x0101010101010101), U(0x7F7F7F7F7F7F7F7F), U(0x8080808080808080)


def words_of(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian uint64, with a word of zeros behind them."""
    out = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    out[: len(data)] = data
    return out.view("<u8")


def line_ends(w: np.ndarray) -> np.ndarray:
    """0x80 in each byte that is a line feed: a byte of x is zero where neither its low bits carry into bit 7 nor it is set."""
    x = w ^ (ONES * U(10))
    return ~(((x & LOW) + LOW) | x | LOW)


def char_starts(w: np.ndarray) -> np.ndarray:
    """0x80 in each byte that begins a code point, all but 10xxxxxx."""
    return (~w | (w << U(1))) & HIGH


class Marks:
    """Marked bytes of a run of texts: how many lie before a place, and where the k-th is."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.concatenate(([0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks in the bytes before each place."""
        word, inside = at >> 3, (at & 7).astype(U)
        below = (U(1) << (inside * U(8))) - U(1)
        return self.upto[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of mark k, counted from 1: the word whose running count reaches k, and in it the first byte whose
        running count (one product) does."""
        word = np.searchsorted(self.upto, k, "left") - 1
        left = (k - self.upto[word]).astype(U)
        running = (self.marks[word] >> U(7)) * ONES  # at most 8 a byte
        reached = ((running | HIGH) - left * ONES) & HIGH
        return word * 8 + 8 - np.bitwise_count(reached)


def cuts(data: np.ndarray, off: np.ndarray, draws: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Of each text the number of its units, the two places where it is cut, and the code points of the first two parts."""
    w = words_of(data)
    starts, ends = off[:-1], off[1:]
    chars = Marks(char_starts(w))
    if unit == "line":
        marks = Marks(line_ends(w))
        before = marks.rank(starts)
        full = marks.rank(ends) - before
        open_end = (ends > starts) & (data[np.maximum(ends, 1) - 1] != 10) if len(data) else np.zeros(len(starts), bool)
        n = full + open_end
    else:
        marks, before = chars, chars.rank(starts)
        full = n = chars.rank(ends) - before
    ordered = np.sort(draws[:, :2] % (n[:, None] + 1), axis=1)
    places = []
    for j in range(2):
        k = ordered[:, j]
        if unit == "line":
            at = np.where(k > full, ends, starts)
            some = (k > 0) & (k <= full)
            at[some] = marks.select(before[some] + k[some]) + 1
        else:  # a code point ends where the next one begins
            at = np.where(k == n, ends, starts)
            some = (k > 0) & (k < n)
            at[some] = marks.select(before[some] + k[some] + 1)
        places.append(at)
    a, b = places
    c = [chars.rank(x) for x in (starts, a, b)]
    return n, a, b, c[1] - c[0], c[2] - c[1]


def holds(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts hold a sentinel: three bytes that stand in one text."""
    out = np.zeros(len(off) - 1, bool)
    if len(data) < 3:
        return out
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]) & np.isin(data[1:-1], [PREFIX[1], SUFFIX[1], MIDDLE[1]]))
    doc = np.searchsorted(off, at, "right") - 1
    out[doc[at + 3 <= off[doc + 1]]] = True
    return out


def transform(docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every row."""
    if unit not in ("line", "char"):
        raise ValueError(f"unit {unit!r}: line or char")
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("name"))
    shape = StructType([source.schema[0], StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in chunks(batches):
            digests = b"".join(hashlib.sha256(b"%d:%s" % (seed, i.encode())).digest()[:16] for i in batch.column(2).to_pylist())
            draws = np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)
            n, a, b, first, second = cuts(data, off, draws, unit)
            plain = (np.diff(off) == 0) | holds(data, off) | (draws[:, 2] % 100 >= rate)
            turned = draws[:, 3] % 100 < spm
            raw, out = data.tobytes(), []
            for s, e, i, j, p, t in zip(off[:-1].tolist(), off[1:].tolist(), a.tolist(), b.tolist(), plain.tolist(), turned.tolist(), strict=True):
                out.append(raw[s:e] if p else b"".join((SUFFIX, raw[j:e], PREFIX, raw[s:i], MIDDLE, raw[i:j]) if t else (PREFIX, raw[s:i], SUFFIX, raw[j:e], MIDDLE, raw[i:j])))
            form = np.where(plain, "plain", np.where(turned, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(form), pa.array(first, mask=plain), pa.array(second, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                shape.names,
            )

    return source.mapInArrow(run, shape)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No part holds a sentinel, so the three sentinels cut it into its parts."""
    part = F.split(output, "<[PSM]>", -1)
    psm, spm = ([F.get(part, F.lit(i)) for i in order] for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", F.concat(*psm)).when(form == "spm", F.concat(*spm)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents
), u as (
  select doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units, list_transform(range(4), lambda i: ('0x' || h[8 * i + 1 : 8 * i + 8])::bigint) as d from t
), c as (
  select *, len(units)::bigint as n, least(d[1] % (len(units) + 1), d[2] % (len(units) + 1)) as a, greatest(d[1] % (len(units) + 1), d[2] % (len(units) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or d[3] % 100 >= 100 then 'plain' when d[4] % 100 < 50 then 'spm' else 'psm' end as form
  from u
), p as (
  select *, array_to_string(units[1 : a], '') as prefix, array_to_string(units[a + 1 : b], '') as middle, array_to_string(units[b + 1 :], '') as suffix from c
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then text else prefix || middle || suffix end) as restored_sha256
from p
"""
