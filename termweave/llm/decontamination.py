"""Operator 7, benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

A mask picks some of a window's words; windows of documents and benchmark items that agree on the picked words of a
mask have the same hash, whatever stands at the ignored positions. Test and training hashes are joined; each hit
fixes how the item lies over the document, and the hit is verified where they overlap: some stretch of ``WINDOW``
words (or the whole item, if it is shorter) must agree in at least ``PERCENT`` per cent of its places.

The masks leave no accepted overlap out. For stretches of n words of which ``wrong`` may differ, positions are dealt to
wrong + 2 groups in turn, and there is a mask for each choice of ``wrong`` groups that it ignores: whatever differs,
some mask ignores all of it. Items shorter than the window have masks of their own length.

Words are runs of letters and digits, lower-cased. Documents are hashed and probed in one pass without a shuffle: the
benchmark's seeds are broadcast, in blocks of at most ``BLOCK`` seeds each (their number is counted first). Only hits
are shuffled, each with the stretch of document word hashes under the item.

Defined results: null and empty texts have no words and no hits; items of fewer than ``LEAST`` words are no evidence
and are never reported; a passage that an item holds twice is looked for at both places; each row of the input is judged by itself, so
repeated rows and null ids come back as often as they are contaminated; other columns are ignored; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm._spark import identified, removed, table, written

WINDOW = 13
PERCENT = 80
LEAST = 5
BLOCK = 400_000


def masks_of(n: int, percent: int) -> list[str]:
    """Masks of n words, one of which at least ignores all differences of an overlap that is accepted."""
    wrong = n * (100 - percent) // 100
    groups = range(wrong + 2)
    return ["".join("0" if k % len(groups) in gone else "1" for k in range(n)) for gone in combinations(groups, wrong)]


def word_hashes(text: str) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, masks: list[str], window: int | None = None) -> DataFrame:
    """rows (with array ``words``) by position i and seed h; with ``window``, of items: each has the masks of its length,
    or of the window if it is longer."""
    placed = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("i")).where("i is not null")

    def seed(m: int, mask: str) -> Column:
        picked = [F.get("words", F.col("i") + k) for k, c in enumerate(mask) if c == "1"]
        fits = F.col("i") + len(mask) <= F.size("words")
        return F.when(fits if window is None else fits & (F.least(F.size("words"), F.lit(window)) == len(mask)), F.xxhash64(F.lit(m), *picked))

    return placed.select("*", F.explode(F.array(*(seed(m, mask) for m, mask in enumerate(masks)))).alias("h")).where("h is not null")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, doc_word (where the item would begin, from 0), matched and compared words of the best stretch:
    a row for each document row and benchmark item that overlap."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return leaks(rows, benchmark, window, percent, least).drop("row")


def leaks(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """find_leaks over rows (row, doc_id, text), with the row in front."""
    spark = rows.sparkSession
    items = benchmark.select("item_id", word_hashes("text").alias("words")).where(F.size("words") >= least)
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(window))).distinct().collect())  # a window has so many at most
    masks = [m for n in lengths for m in masks_of(n, percent)]
    tests = seeds(items, masks, window).select("item_id", "h", F.col("i").alias("place"), F.size("words").alias("item_words")) if masks else None
    n = tests.count() if masks else 0
    if n == 0:
        return spark.createDataFrame([], f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, doc_word int, matched int, compared int")
    blocks = -(-n // BLOCK)
    if blocks > 1:  # read once for each block: the rows' numbers are written
        rows = written(rows, "rows", compression="zstd")
    placed = seeds(rows.select("row", "doc_id", word_hashes("text").alias("words")).where(F.size("words") >= least), masks)
    hits = None
    for b in range(blocks):
        own = tests if blocks == 1 else tests.where(F.pmod("h", F.lit(blocks)) == b)
        at = F.col("i") - F.col("place")
        # the item's words stand over the document's words from at on, of which those inside the document are kept
        hit = placed.join(F.broadcast(own), "h").select("row", "doc_id", "item_id", at.alias("doc_word"), F.slice("words", F.greatest(at, F.lit(0)) + 1, F.col("item_words") + F.least(at, F.lit(0))).alias("under"))
        hits = hit if hits is None else hits.unionAll(hit)
    lain = hits.groupBy("row", "doc_id", "item_id", "doc_word").agg(F.first("under").alias("under"))
    both = lain.join(items.select("item_id", "words"), "item_id")
    from_item = F.greatest(-F.col("doc_word"), F.lit(0))
    same = F.zip_with("under", F.slice("words", from_item + 1, F.size("under")), lambda a, b: F.when(a == b, 1).otherwise(0))
    compared = F.least(F.lit(window), F.size("words"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    stretches = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("compared") + 1), lambda i: total(F.slice("same", i, F.col("compared"))))
    judged = both.select("row", "doc_id", "item_id", "doc_word", same.alias("same"), compared.alias("compared")).where("size(same) >= compared")
    verified = judged.select("row", "doc_id", "item_id", "doc_word", "compared", F.array_max(stretches).alias("matched")).where(F.col("matched") * 100 >= F.col("compared") * percent)
    best = F.max(F.struct("matched", (-F.col("doc_word")).alias("first"), "compared")).alias("best")
    return verified.groupBy("row", "doc_id", "item_id").agg(best).select("row", "doc_id", "item_id", (-F.col("best.first")).alias("doc_word"), "best.matched", "best.compared")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that overlap no benchmark item."""
    made: list[str] = []
    rows, row = identified(docs, made)
    leaking = leaks(rows.select(F.col(row).alias("row"), "doc_id", "text"), table(spark, sf_dir, "benchmark")).select(F.col("row").alias(row)).distinct()
    out = written(rows.join(leaking, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)), "clean", compression="zstd")
    removed(spark, made)
    return out
