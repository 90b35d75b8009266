"""Operator 3, secret scans with multipart credential linking.

Strong findings stand by themselves: assignments to secret names (assign), access key ids (access) and long hex runs
(hex). Weak candidates - account names (account), random-looking strings (opaque) and endpoints (endpoint) - are
reported only where complementary parts co-occur: within ``reach`` characters of one another in one scope, a scope
being a stretch of text without blank lines. An account needs a secret near, an opaque string an identifier, an
endpoint both.

Candidates are rows (document, scope, role, start, end). The interval join is a sweep: within a scope ordered by start,
the largest end before and the smallest start behind of each role are running window values, so each candidate meets
its nearest partner on either side and no pairs are made.

Defined results: a null text counts as empty and has no spans; every row of the input gives a row, repeated rows and
null ids included; spans that start together are ordered by kind as listed in ``KINDS``; other columns are ignored;
an empty table gives an empty result. Texts are scanned once; rows are numbered in the table that this pass writes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.window import Window

from termweave.llm._spark import removed, table, written

REACH = 240
MASK = "[SECRET]"
KINDS = ["assign", "access", "hex", "account", "opaque", "endpoint"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # all of a run of [0-9a-f]+ that is long enough
ACCOUNT = re.compile(r"""(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.I | re.A)
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:@/?#%&=+-]{4,}|[a-z0-9][a-z0-9.-]*\.amazonaws\.com", re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])", re.A)
SCOPE = re.compile(r"\n[ \t\r]*\n")
#: Every finding has one of these; texts without are not looked at again.
MAYBE = "[:=]|AKIA|[0-9a-f]{32}"
#: The role of each kind in a credential.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "opaque": "secret", "endpoint": "endpoint"}


class Span(NamedTuple):
    start: int
    rank: int
    end: int
    kind: str


def strong(text: str) -> list[Span]:
    """The findings that stand by themselves, in order."""
    out = [Span(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [Span(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [Span(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out)


def random_looking(s: str) -> bool:
    """Letters and digits mixed, with at least 3.5 bits a character."""
    n = len(s)
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and -sum(k / n * math.log2(k / n) for k in Counter(s).values()) >= 3.5


def weak(text: str, taken: list[Span]) -> list[Span]:
    """Candidates that need a partner; none overlaps a strong finding or a candidate of an earlier kind."""
    out: list[Span] = []
    held = sorted((s.start, s.end) for s in taken)
    for rank, kind, found in ((3, "account", ACCOUNT.finditer(text)), (5, "endpoint", ENDPOINT.finditer(text)), (4, "opaque", OPAQUE.finditer(text))):
        new, i, far = [], 0, -1
        for m in found:  # both run by start: a sweep
            while i < len(held) and held[i][0] < m.end():
                far = max(far, held[i][1])
                i += 1
            if far <= m.start() and (kind != "opaque" or random_looking(m[0])):
                new.append(Span(m.start(), rank, m.end(), kind))
        out += new
        held = sorted([*held, *((s.start, s.end) for s in new)])
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


PART = StructType().add("start", "long").add("rank", "integer").add("end", "long").add("kind", "string").add("scope", "integer")
FOUND = ["n_assign", "n_access", "n_hex", "base_sha256", "parts"]
_PART = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("scope", pa.int32())])


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a text in column 0 to these with counts, the digest of the strong spans, and all parts, which only texts
    have where something is found."""
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        texts = pc.fill_null(batch.column(0), "")
        n = batch.num_rows
        counts, digest, parts = [[0] * n, [0] * n, [0] * n], [nothing] * n, [[]] * n
        maybe = pc.match_substring_regex(texts, MAYBE).to_numpy(zero_copy_only=False)
        for i in maybe.nonzero()[0].tolist():
            text = texts[i].as_py()
            base = strong(text)
            found = sorted(base + weak(text, base))
            if base:
                for s in base:
                    counts[s.rank][i] += 1
                digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
            cuts, scope, rows = [m.start() for m in SCOPE.finditer(text)] if found else [], 0, []
            for s in found:
                while scope < len(cuts) and cuts[scope] < s.start:
                    scope += 1
                rows.append({"start": s.start, "rank": s.rank, "end": s.end, "kind": s.kind, "scope": scope})
            parts[i] = rows
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array(parts, pa.list_(_PART))], [*batch.schema.names, *FOUND])


def linked(parts: DataFrame, reach: int) -> DataFrame:
    """(row, start, rank, end, kind) of the strong parts and of the weak ones with their complements near."""
    rows = parts.select("row", F.inline("parts"))
    role = F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), F.col("kind"))
    by = Window.partitionBy("row", "scope").orderBy("start", "rank", "end")
    before, behind = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)

    def near(name):
        of = F.col("role") == name
        return F.coalesce(F.col("start") - F.max(F.when(of, F.col("end"))).over(before) <= reach, F.lit(False)) | F.coalesce(F.min(F.when(of, F.col("start"))).over(behind) - F.col("end") <= reach, F.lit(False))

    seen = rows.withColumn("role", role).withColumns({"by_identifier": near("identifier"), "by_secret": near("secret")})
    told = F.when(F.col("rank") <= 2, True).when(F.col("kind") == "account", F.col("by_secret")).when(F.col("kind") == "opaque", F.col("by_identifier")).otherwise(F.col("by_identifier") & F.col("by_secret"))
    return seen.where(told).select("row", "start", "rank", "end", "kind")


def scan(docs: DataFrame, kept: list[Column], text_col: str, reach: int, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """(row, kept columns, counts, digest, parts) of every row of docs, and (row, spans) of those with findings."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), *kept)
    shape = StructType(list(rows.schema.fields)).add("n_assign", "long").add("n_access", "long").add("n_hex", "long").add("base_sha256", "string").add("parts", ArrayType(PART))
    whole = "whole" in rows.columns
    found = rows.mapInArrow(scanned, shape).drop("text").withColumn("row", F.monotonically_increasing_id())
    found = written(found, "secrets", made, "zstd" if whole else "snappy")
    spans = linked(found.where(F.size("parts") > 0), reach).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans"))
    return found, spans


def find_secrets(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined) of every row of docs."""
    made: list[str] = []
    found, spans = scan(docs, [F.col(f"`{id_col}`").alias("doc_id")], text_col, reach, made)
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    out = found.join(spans, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(text, F.lit("")).alias("spans"))
    out = written(out, "spans")
    removed(docs.sparkSession, made)
    return out


def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, spans, further columns) to (masked text, further columns)."""
    for batch in batches:
        out = []
        for t, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at, kept = 0, []
            for s in found:
                if s["start"] >= at:
                    kept += [t[at : s["start"]], MASK]
                at = max(at, s["end"])
            out.append("".join([*kept, t[at:]]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])


def redact(docs: DataFrame, reach: int = REACH, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with every reported span replaced by ``MASK``; other columns and untouched texts stay as they are, but for
    ``length_col``, which holds the code points of a text that has a mask."""
    made: list[str] = []
    found, spans = scan(docs, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")], text_col, reach, made)
    hit = found.where(F.size("parts") > 0).join(spans, "row", "left").select(F.col(f"whole.`{text_col}`").alias("text"), "spans", "whole")
    shape = StructType().add("text", "string").add(found.schema["whole"])
    cut = hit.where("spans is not null").select("text", "spans", "whole").mapInArrow(masked, shape)
    length = lambda text: F.when(F.contains(text, F.lit(MASK)), F.char_length(text).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"whole.`{length_col}`"))
    columns = lambda text: [(text if c == text_col else length(text) if c == length_col else F.col(f"whole.`{c}`")).alias(c) for c in docs.columns]
    old = F.col(f"whole.`{text_col}`")
    out = found.where(F.size("parts") == 0).select(*columns(old)).unionByName(hit.where("spans is null").select(*columns(old))).unionByName(cut.select(*columns(F.col("text"))))
    out = written(out, "masked", compression="zstd")
    removed(docs.sparkSession, made)
    return out


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets masked and n_chars brought up to date where a text has changed."""
    return redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)
