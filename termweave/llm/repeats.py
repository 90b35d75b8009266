"""Operator 9, suffix-array dedup by longest previous factors.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere, in the same text or another. That
asks of each suffix only whether its longest previous or next factor reaches ``LENGTH``, so suffixes are ordered by
their first ``LENGTH`` bytes, as hashes: equal ones stand together, by position, and the previous and the next smaller
position in that order are a suffix's earlier and later match. ``keep_first`` removes what has an earlier match and
keeps first occurrences; otherwise what has a match on either side goes.

Passages are found the same way in words: a word is repeated if a string of ``WORDS`` words that covers it also starts
elsewhere, so that a shared passage shows whose bytes are too few to go. Words and bytes are suffixes of one kind.

Not all suffixes are ordered. Winnowing picks anchors so that every string of the length holds one, the same one
wherever the string stands; only suffixes whose first ``LENGTH`` bytes (``WORDS`` words) hold an anchor that occurs twice
take part. They are dealt to shards by their hash, each distinct one of a pack of texts once, so that no string, however
common, is a hot group; a shard answers with two bits for each. Equal texts are one class, of which one member takes part.

Defined results: a null text counts as empty; texts shorter than ``LENGTH`` keep all; every row of the input gives a
row, repeated rows and null ids included (repeated long rows remove one another; of equal rows the one that comes first
in the input is the first); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm._spark import identified, table, written
from termweave.llm._spark import removed as deleted
from termweave.llm._text import BYTES, Sums, U, chunks, word_hashes

LENGTH = 400
WORDS = 50
SALTS = 16  # tasks that the copies of one text are dealt to
PACK = 2 << 20  # bytes of text in a pack, about
SHARD = 2_000_000  # hashes in a shard, about
NONE = hashlib.sha256(b"").digest()
MOST = U(0xFFFFFFFFFFFFFFFF)


def sliding(op, x: np.ndarray, w: int, fill) -> np.ndarray:
    """op (np.minimum or np.maximum) over every w values of x, from running values within blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, fill, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(-1, w)
    ahead = op.accumulate(grid, axis=1).ravel()
    behind = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(values: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the picked grams of half the length: those that are least among length - gram + 1."""
    gram = length // 2
    w, n = length - gram + 1, len(values) - gram + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.arange(n)
    h = Sums(values).spans(at, at + gram)
    inside = np.ones(len(values) + gram, bool)
    for e in off[1:].tolist():
        inside[max(0, e - gram + 1) : e] = False  # grams that leave their text
    inside = inside[:n]
    h[~inside] = MOST
    least = sliding(np.minimum, h, w, MOST)
    best = sliding(np.maximum, np.concatenate([np.zeros(w - 1, U), least, np.zeros(w - 1, U)]), w, U(0))
    picked = np.flatnonzero((h == best[:n]) & inside)
    return picked, h[picked]


def units(data: np.ndarray, off: np.ndarray, lengths: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Values, offsets of the texts, and length of the strings: in bytes, and in words."""
    h, first = word_hashes(data, off)
    return [(BYTES[data], off, lengths[0]), (h, first, lengths[1])]


def described(lengths: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, doc_id, text) to (row, doc_id, n_bytes, n_words, digest, grams); grams: the hashes of the anchors."""
        for batch, data, off in chunks(batches, text=2):
            grams, size = [np.zeros(0, U)] * batch.num_rows, []
            for values, start, length in units(data, off, lengths):
                at, h = anchors(values, start, length)
                first, n = np.searchsorted(at, start), np.diff(start)
                grams = [np.concatenate([g, h[first[i] : first[i + 1]]]) if n[i] >= length else g for i, g in enumerate(grams)]
                size.append(n)
            raw = data.tobytes()
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(n, pa.int64()) for n in size), pa.array(digests, pa.binary()), pa.array([g.view(np.int64) for g in grams], pa.list_(pa.int64()))],
                ["row", "doc_id", "n_bytes", "n_words", "digest", "grams"],
            )

    return run


def taking_part(values: np.ndarray, off: np.ndarray, length: int, hot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """From where to where suffixes take part: those whose string holds an anchor that repeats."""
    at, h = anchors(values, off, length)
    first = np.searchsorted(at, off)
    lows, highs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, grams in enumerate(hot):
        a, b = first[i], first[i + 1]
        mine = at[a:b][np.isin(h[a:b], grams)]
        low, high = np.maximum(mine - (length - length // 2), off[i]), np.minimum(mine, off[i + 1] - length)
        ok = high >= low
        low, high = low[ok], high[ok]
        if len(low):  # both ascend: runs that touch are one
            new = np.concatenate(([True], low[1:] > high[:-1] + 1))
            lows.append(low[new])
            highs.append(high[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)] + 1)
    return np.concatenate(lows), np.concatenate(highs)


def packed(lengths: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, text, grams that repeat) to packs: their texts, and from where to where suffixes take part in each."""
        for batch, data, off in chunks(batches, limit=PACK):
            hot = [np.array(g, np.int64).view(U) for g in batch.column(2).to_pylist()]
            runs = [taking_part(*unit, hot) for unit in units(data, off, lengths)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(0, 1), pa.array([batch.column(0).to_pylist()]), pa.array([data.tobytes()], pa.binary()), pa.array([off]), *(pa.array([[r[k] for r in runs]], pa.list_(pa.list_(pa.int64()))) for k in (0, 1)), pa.array([int(sum((high - low).sum() for low, high in runs))], pa.int64())],
                ["pack", "rows", "data", "offsets", "low", "high", "n"],
            )

    return run


def suffixes(data: bytes, off: list[int], lows: list[list[int]], highs: list[list[int]], lengths: tuple[int, int]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For bytes and for words the positions of the suffixes that take part, and the offsets of the texts; hashes of the
    suffixes' first strings, those of words behind those of bytes."""
    out, hashes = [], []
    for (values, start, length), low, high in zip(units(np.frombuffer(data, np.uint8), np.array(off), lengths), lows, highs, strict=True):
        low, size = np.array(low, np.int64), np.array(high, np.int64) - np.array(low, np.int64)
        stop = np.cumsum(size)
        at = np.repeat(low - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
        out.append((at, start))
        hashes.append(Sums(values).spans(at, at + length))
    return out, np.concatenate(hashes)


def shards_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(1, 1 << bits, dtype=U) << U(64 - bits)) if bits else np.zeros(0, np.int64)


def dealt(lengths: tuple[int, int], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pack, data, offsets, low, high) to (shard, pack, keys): each distinct hash of a pack once, sorted."""
        for batch in batches:
            for pack, *held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.sort(suffixes(*held, lengths)[1])
                keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
                for s, part in enumerate(np.split(keys, shards_of(keys, bits))):
                    if len(part):
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([pack], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["shard", "pack", "keys"])

    return run


def matched(group: pa.Table) -> pa.Table:
    """For each block of a shard two bits for each of its hashes: it stands in an earlier pack, it stands in a later."""
    order = np.argsort(group.column("pack").to_numpy(), kind="stable")
    group = group.take(pa.array(order))
    parts = [np.frombuffer(k, U) for k in group.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    by = np.argsort(keys, kind="stable")  # equal hashes by pack: the suffix order
    same = keys[by][1:] == keys[by][:-1]
    earlier, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[by[1:]], later[by[:-1]] = same, same
    cut = np.cumsum([len(p) for p in parts])[:-1]
    bits = [[np.packbits(x).tobytes() for x in np.split(v, cut)] for v in (earlier, later)]
    return pa.table({"shard": group.column("shard"), "pack": group.column("pack"), "earlier": pa.array(bits[0], pa.binary()), "later": pa.array(bits[1], pa.binary())})


def covered(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n units the strings that start at ``at`` cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def stretches(gone: np.ndarray) -> tuple[int, int]:
    """How many maximal runs there are, and how long the longest is."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
    return len(edge) // 2, int((edge[1::2] - edge[::2]).max(initial=0))


def removed(lengths: tuple[int, int], bits: int, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(data, offsets, rows, low, high, answers) to (row, n_removed, n_spans, kept, repeated_words, longest_repeat):
        what goes from each text, and its words in strings that repeat."""
        for batch in batches:
            for data, off, rows, low, high, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places, h = suffixes(data, off, low, high, lengths)
                order = np.argsort(h, kind="stable")
                keys = h[order]
                start = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
                own = np.cumsum(start) - 1
                found = keys[start]
                cut = np.concatenate(([0], shards_of(found, bits), [len(found)]))
                earlier, later = np.zeros(len(found), bool), np.zeros(len(found), bool)
                for a in answers:
                    span = slice(cut[a["shard"]], cut[a["shard"] + 1])
                    n = span.stop - span.start
                    for flags, name in ((earlier, "earlier"), (later, "later")):
                        flags[span] = np.unpackbits(np.frombuffer(a[name], np.uint8), count=n).astype(bool)
                goes = np.zeros(len(h), bool)
                if keep_first:
                    goes[order] = earlier[own] | ~start
                else:
                    goes[order] = (earlier | later | (np.bincount(own, minlength=len(found)) > 1))[own]
                (at, _), (words, first) = places
                gone, twice = covered(at[goes[: len(at)]], lengths[0], len(data)), covered(words[goes[len(at) :]], lengths[1], int(first[-1]))
                raw, out = np.frombuffer(data, np.uint8), []
                for i, row in enumerate(rows):
                    mine, said = gone[off[i] : off[i + 1]], twice[first[i] : first[i + 1]]
                    if mine.any() or said.any():
                        kept = raw[off[i] : off[i + 1]][~mine].tobytes() if mine.any() else None
                        out.append((row, int(mine.sum()), stretches(mine)[0], kept, int(said.sum()), stretches(said)[1]))
                cols = list(zip(*out, strict=True)) if out else [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["row", "n_removed", "n_spans", "kept", "repeated_words", "longest_repeat"])

    return run


def find_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_bytes, n_words, digest, n_removed, n_spans, kept (bytes; null where all stays), repeated_words (how
    many words are in strings of ``words`` words that repeat) and longest_repeat (the longest stretch of these) of every
    row of docs."""
    made: list[str] = []
    out = written(repeats(docs, made, (length, words), keep_first, id_col, text_col), "repeats", compression="zstd")
    deleted(docs.sparkSession, made)
    return out


def repeats(docs: DataFrame, made: list[str], lengths: tuple[int, int] = (LENGTH, WORDS), keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows, row = identified(docs, made)
    rows = rows.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema[1].dataType.simpleString()
    known = written(rows.mapInArrow(described(lengths), f"row long, doc_id {kind}, n_bytes long, n_words long, digest binary, grams array<long>"), "described", made)
    classes = known.where((F.col("n_bytes") >= lengths[0]) | (F.col("n_words") >= lengths[1])).groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    grams = known.join(classes.select("row"), "row").select("row", F.explode("grams").alias("gram"))
    # written, so that the join shuffles both sides by itself and may split a gram that very many texts hold
    twice = written(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "twice", made)
    hot = grams.join(twice, "gram").groupBy("row").agg(F.collect_set("gram").alias("grams"))
    there = rows.select("row", "text").join(hot, "row")
    if keep_first:  # packs in the order of the input
        there = there.repartitionByRange("row").sortWithinPartitions("row")
    ranges = "array<array<long>>"
    packs = there.mapInArrow(packed(lengths), f"pack long, rows array<long>, data binary, offsets array<long>, low {ranges}, high {ranges}, n long")
    packs = written(packs, "packs", made)
    bits = max(0, int((packs.agg(F.sum("n")).first()[0] or 0) // SHARD).bit_length())
    keys = packs.where("n > 0").select("pack", "data", "offsets", "low", "high").mapInArrow(dealt(lengths, bits), "shard long, pack long, keys binary")
    answers = keys.groupBy("shard").applyInArrow(matched, "shard long, pack long, earlier binary, later binary")
    answers = answers.groupBy("pack").agg(F.collect_list(F.struct("shard", "earlier", "later")).alias("answers"))
    found = "row long, n_removed long, n_spans long, kept binary, repeated_words long, longest_repeat long"
    parts = packs.join(answers, "pack").select("data", "offsets", "rows", "low", "high", "answers").mapInArrow(removed(lengths, bits, keep_first), found)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    copies = classes.where("copies > 1").select("digest", F.col("row").alias("first"), salt.alias("salt"))
    alone = known.select("row", "doc_id", "n_bytes", "n_words", "digest", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    both = alone.join(parts, "row", "left").join(copies, ["digest", "salt"], "left")
    copied = F.col("first").isNotNull() & ((F.col("row") != F.col("first")) if keep_first else F.lit(True))
    whole, said = copied & (F.col("n_bytes") >= lengths[0]), copied & (F.col("n_words") >= lengths[1])
    nothing = F.lit(0).cast("long")
    return both.select(
        "row", "doc_id", "n_bytes", "n_words", "digest",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", nothing)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", nothing)).alias("n_spans"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(said, F.col("n_words")).otherwise(F.coalesce("repeated_words", nothing)).alias("repeated_words"),
        F.when(said, F.col("n_words")).otherwise(F.coalesce("longest_repeat", nothing)).alias("longest_repeat"),
    )


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made: list[str] = []
    rows = repeats(table(spark, sf_dir, "documents"), made)
    digest = F.coalesce(F.sha2("kept", 256), F.lower(F.hex("digest")))
    out = written(rows.select("doc_id", "n_bytes", "n_removed", "n_spans", digest.alias("kept_sha256"), "repeated_words", "longest_repeat"), "repeats")
    deleted(spark, made)
    return out
