"""Linking records: star joins along direct keys and link tables, prioritised match rules, enrichment, selection.

IN and list-membership joins are written as explode, equi-join and distinct, so that none becomes a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termweave.plans.session import checkpoints

MOST_LENGTHS = 100  # of keys that others may begin with


def star_join(primary: DataFrame, key: str, related: dict[str, tuple[DataFrame, str, DataFrame | None]]) -> DataFrame:
    """primary with one array column per related source (its rows as structs, in link order, duplicates kept, dangling
    links dropped, null where there is none).

    A source is (rows, its key, links): links (key, pos, target) lead from the primary key to the source's key, or
    None where the source's key is the primary key itself.
    """
    out = primary
    for name, (rows, own, links) in related.items():
        item = F.struct(*rows.columns)
        if links is None:
            found = rows.select(F.col(own).alias("_key"), F.lit(0).alias("_pos"), item.alias("_item"))
        else:
            found = links.select(F.col("key").alias("_key"), F.col("pos").alias("_pos"), F.col("target").alias("_target")).join(rows.select(F.col(own).alias("_target"), item.alias("_item")), "_target").drop("_target")
        lists = found.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_item"))), lambda x: x["_item"]).alias(name))
        out = out.join(lists, out[key] == lists["_key"], "left").drop("_key")
    return out


def beginnings(keys: DataFrame, known: DataFrame) -> DataFrame:
    """keys (id, key) with each key replaced by those of its beginnings that have the length of some known key."""
    lengths = [r[0] for r in known.select(F.char_length("key")).distinct().where("char_length(key) > 0").limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"keys of more than {MOST_LENGTHS} lengths")
    own = F.filter(F.array(*(F.lit(n) for n in sorted(lengths))).cast("array<int>"), lambda n: n <= F.char_length("key"))
    return keys.select("id", F.explode(own).alias("_n"), "key").select("id", F.substr("key", F.lit(1), F.col("_n")).alias("key"))


def match_rules(left: DataFrame, right: DataFrame, rules: list[tuple]) -> DataFrame:
    """(left_id, right_id, matched_by) for every pair that a rule matches, named by the first rule in the list.

    A rule is (name, left keys, right keys), each an array of keys of the row with column ``id``; rows match if they
    share a key. Null keys match nothing. A rule with a fourth item, true, matches if a right key begins with a left one
    (accessions without and with their version): right keys are exploded into their beginnings of the lengths that left
    keys have, so that this is an equi-join as well.
    """
    pairs = None
    for order, (name, l, r, *prefix) in enumerate(rules):  # noqa: E741
        a = left.select("id", F.explode(F.array_distinct(l)).alias("key")).where("key is not null")
        b = right.select("id", F.explode(F.array_distinct(r)).alias("key")).where("key is not null")
        if any(prefix):
            b = beginnings(b, a)
        a, b = a.withColumnRenamed("id", "left_id"), b.withColumnRenamed("id", "right_id")
        found = a.join(b, "key").select("left_id", "right_id", F.lit(order).alias("rule_order"), F.lit(name).alias("matched_by")).distinct()
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.groupBy("left_id", "right_id").agg(F.min_by("matched_by", "rule_order").alias("matched_by"))


def first_rule(matches: DataFrame, rules: list[str]) -> DataFrame:
    """Of each left row only the matches of the best rule that found any."""
    order = F.array_position(F.array(*map(F.lit, rules)), F.col("matched_by"))
    return matches.withColumn("_r", F.dense_rank().over(Window.partitionBy("left_id").orderBy(order))).where("_r = 1").drop("_r")


def ruled_lists(left: DataFrame, right: DataFrame, rules: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """What ``first_rule`` finds, without a row for each pair: found (left_id, rule, keys) tells by which rule (its place in
    the list) and which of its keys a left row matches, lists (rule, keys, rows) the right rows of these as structs,
    ordered by id. Left rows with the same keys share a list. Rules are as in ``match_rules``, without beginnings; keys are
    compared as texts. Joined to anything last, lists are never shuffled once for each left row."""
    key_of = lambda side: F.inline(F.array(*(F.struct(F.lit(i).alias("rule"), r[side].cast("array<string>").alias("own")) for i, r in enumerate(rules))))
    l, r = (x.select("id", key_of(i)).select("id", "rule", F.explode(F.array_distinct("own")).alias("key")).where("key is not null") for i, x in ((1, left), (2, right)))  # noqa: E741
    hits = l.join(r.select("rule", "key").distinct(), ["rule", "key"], "left_semi").groupBy(F.col("id").alias("left_id")).agg(F.array_sort(F.collect_set(F.struct("rule", "key"))).alias("hits"))
    best = F.col("hits")[0]["rule"]
    found = hits.select("left_id", best.alias("rule"), F.transform(F.filter("hits", lambda h: h["rule"] == best), lambda h: h["key"]).alias("keys"))
    asked = found.select("rule", "keys").distinct().select("rule", "keys", F.explode("keys").alias("key"))
    met = asked.join(r, ["rule", "key"]).select("rule", "keys", "id").distinct()
    rows = met.join(right.select("id", F.struct(*right.columns).alias("row")), "id", "left")
    packed = F.collect_list(F.when(F.col("row").isNotNull(), F.struct("id", "row")))
    return found, rows.groupBy("rule", "keys").agg(F.transform(F.array_sort(packed), lambda x: x["row"]).alias("rows"))


def outer_pairs(left: DataFrame, right: DataFrame, matches: DataFrame, how: str = "full") -> DataFrame:
    """All pairs with both unmatched sides (full) or the left one (left): left_id, right_id, matched_by."""
    a = left.select(F.col("id").alias("left_id")).join(matches, "left_id", "left")
    if how == "left":
        return a
    rest = right.select(F.col("id").alias("right_id")).join(matches.select("right_id").distinct(), "right_id", "left_anti")
    return a.unionByName(rest, allowMissingColumns=True)


def having_any_key(df: DataFrame, keys: list[str], wanted: DataFrame, name: str) -> DataFrame:
    """Rows of which any key column is among the wanted values; each row once, repeated rows as often as they stand.

    A semi-join for each key, of the rows that no earlier key has found: rows are not numbered."""
    values = wanted.select(F.col(name).alias("_key")).where("_key is not null").distinct()
    out, rest = None, df
    for k in keys:
        found = rest.join(values, F.col(k) == F.col("_key"), "left_semi")
        out = found if out is None else out.unionByName(found)
        rest = rest.join(values, F.col(k) == F.col("_key"), "left_anti")
    return out


def grouped_lists(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, rows): the rows of each key as structs, in order."""
    ranked = F.struct(*order, F.struct(*df.columns).alias("_item"))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["_item"]).alias("rows"))


def enriched(rows: DataFrame, id_col: str, keys: Column, related: DataFrame, own: str, order: list[str], name: str) -> DataFrame:
    """rows with an array column ``name`` of the related rows that an array of keys leads to: in the order of the keys,
    whole rows that are equal only once, where they stand first. Null keys lead nowhere; no key gives an empty list."""
    asked = rows.select(F.col(id_col).alias("_id"), F.posexplode(keys).alias("_pos", "_key")).where("_key is not null")
    item = F.struct(*related.columns)
    ranked = related.select(F.col(own).alias("_key"), F.struct(*order).alias("_order"), item.alias("_item"))
    met = asked.join(ranked, "_key")
    once = met.groupBy("_id", F.to_json("_item").alias("_text")).agg(F.min(F.struct("_pos", "_order")).alias("_at"), F.first("_item").alias("_item"))
    lists = once.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text", "_item"))), lambda x: x["_item"]).alias(name))
    none = F.array().cast(lists.schema[name].dataType)
    return rows.join(lists, rows[id_col] == lists["_id"], "left").drop("_id").withColumn(name, F.coalesce(name, none))


def first_related(rows: DataFrame, key: str, related: DataFrame, own: str, order: list[str], most: int, name: str) -> DataFrame:
    """rows with the first ``most`` related rows of their key as an array, null where there is none."""
    by = Window.partitionBy(own).orderBy(*order)
    kept = related.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most)
    lists = kept.groupBy(F.col(own).alias("_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*related.columns).alias("_item")))), lambda x: x["_item"]).alias(name))
    return rows.join(lists, rows[key] == lists["_key"], "left").drop("_key")


def looked_up(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The first row, in order, of which some key column is the value."""
    return df.where(F.coalesce(F.array_contains(F.array(*keys), value), F.lit(False))).orderBy(order).limit(1)


def reachable(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame, name: str) -> dict[str, DataFrame]:
    """The tables cut down to the rows whose key column is among the keys: one semi-join each, before anything is joined."""
    wanted = keys.select(F.col(name).alias("_key")).where("_key is not null").distinct()
    return {t: df.join(wanted, df[own] == wanted["_key"], "left_semi") for t, (df, own) in tables.items()}


def surrogate(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """df with a dense number from 1 in order. Rows are numbered within ranges of the order, and ranges by how many rows
    lie before them, so no task holds all rows; equal rows have their numbers in any order, and may lie in several ranges.
    Where rows come to lie is checkpointed: a range shuffle that is planned twice samples its bounds twice."""
    checkpoints(df.sparkSession)
    by = [*order, "_tie"]
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_low"))  # a row for each partition
    before = counts.select("_part", "_low", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") - F.col("_low") + F.col("_before") + 1).drop("_part", "_at", "_low", "_before")


def with_metadata(proposals: DataFrame, records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """proposals with their record's metadata as a struct; ``found`` is false, and the struct null, without a record."""
    own = records.select(F.col(key), F.struct(*fields).alias("metadata"))
    return proposals.join(own, key, "left").withColumn("found", F.col("metadata").isNotNull())


def matched_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: matched (keys of both), left_only and right_only."""
    one, two = left.select(key, F.lit(1).alias("l")).distinct(), right.select(key, F.lit(1).alias("r")).distinct()
    return one.join(two, key, "full_outer").agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def inverted(mapping: DataFrame, key: str, values: str, order: str) -> DataFrame:
    """(value, key) of a table with an array of values for each key; a value of several keys goes to the last in order."""
    rows = mapping.select(F.col(key), F.col(order).alias("_order"), F.explode(values).alias("value"))
    return rows.groupBy("value").agg(F.max_by(key, F.struct("_order", key)).alias(key))


def united(mapping: DataFrame, new: DataFrame, key: str, values: str) -> DataFrame:
    """mapping with the values of new added as sets, keys that were not there included."""
    both = mapping.select(key, values).unionByName(new.select(key, values))
    return both.select(key, F.explode_outer(values).alias("_v")).groupBy(key).agg(F.array_sort(F.collect_set("_v")).alias(values))


def mapping_frame(mapping: DataFrame, key: str, values: str, explode: bool = False) -> DataFrame:
    """The mapping sorted by key, a row for each key or, exploded, for each value (null for a key without values)."""
    out = mapping.select(key, F.explode_outer(values).alias(values)) if explode else mapping.select(key, values)
    return out.orderBy(key, values) if explode else out.orderBy(key)


def xref(df: DataFrame, term: str, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """df with ``value`` of the term's row in mapping, 'NA' where it has none."""
    one = mapping.groupBy(F.col(key).alias("_key")).agg(F.max(value).alias(value))
    return df.join(one, df[term] == one["_key"], "left").drop("_key").withColumn(value, F.coalesce(F.col(value), F.lit("NA")))


def require_known(df: DataFrame, key: str, known: DataFrame, known_key: str, shown: int = 5) -> DataFrame:
    """df, after a check that all its keys are known: else a ValueError names how many are not and the first of them."""
    missing = missing_keys(df, key, known, known_key)
    first = [r[0] for r in missing.orderBy(key).limit(shown).collect()]
    if first:
        raise ValueError(f"{missing.count()} keys of {key} are not known, such as {', '.join(map(str, first))}")
    return df


def unique_by(df: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """One row per distinct tuple of fields, the first in order; a missing field counts as an empty text."""
    keys = [F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) for f in fields]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def slice_of(df: DataFrame, order: list[str], skip: int, most: int) -> DataFrame:
    """So many rows in order behind the first ``skip``."""
    return df.orderBy(*order).offset(skip).limit(most)


def first_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in order, with the number of its rows as n_rows."""
    by = Window.partitionBy(key)
    ranked = df.withColumns({"n_rows": F.count("*").over(by), "_n": F.row_number().over(by.orderBy(*order))})
    return ranked.where("_n = 1").drop("_n")


def keyless(df: DataFrame, key: str) -> int:
    """How many rows ``last_wins`` drops."""
    return df.where(F.col(key).isNull()).count()


def last_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    """Of rows with one key the last; rows without a key are dropped (``keyless`` counts them)."""
    row = F.struct(*df.columns)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, position).alias("_row")).select("_row.*")


def distinct_rows(df: DataFrame, digest: Column, keep: str) -> DataFrame:
    """Of rows with one digest the one with the smallest ``keep``."""
    row = F.struct(*df.columns)
    return df.groupBy(digest.alias("_digest")).agg(F.min_by(row, keep).alias("_row")).select("_row.*")


def missing_keys(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """The distinct keys of df that are not known."""
    return df.select(key).distinct().join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti")
