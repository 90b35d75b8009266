"""Operator 11, Merkle dataset manifest: a hash tree over the rows of a table, by sibling-shift self-joins.

Rows become leaves; within a group they are placed by a range shuffle, and their index is their place in a partition plus
the rows of the group in earlier partitions. Every level of the tree is one table of nodes (group, index, digest). An
equijoin of the table with itself on computed sibling indices (index XOR 1 for a binary tree, the other slots of the run
otherwise) gives each node its run's others; rows in slot zero emit the parents. Proofs come down the same levels: a node's
proof is its own siblings and then its parent's proof, so that each level is joined once with the one above and the work is
that of two tables, not of a table for each level. Each level is written, and a lost executor costs one level at most.

The roots of the groups are the leaves of a second tree, built by the same functions. No step gathers a group: keys are
(group, index), each once; the one window runs over the partitions in which a group lies.

Defined results: a null field is ``-``, an empty one ``0:``; rows without a group form a group of their own, before all
others; rows without an id come first in their group, rows of one id in the order of their digests; repeated rows are
leaves each; a lone row is its group's root; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termweave.llm._spark import removed, table, written

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ARITY = 2
TAMPERED = 7  # rows whose crc32(id as text) it divides
LEVELS = 5  # levels of proofs that one job takes, at most


def field(c: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its length in UTF-8 bytes, a colon, and it."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    """The digest of parts one behind the other, as hex text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def laid(df: DataFrame, group: list[str], order: list[str], made: list[str]) -> tuple[DataFrame, DataFrame]:
    """df shuffled by range of ``order`` (nulls first) within ``group``, written where the rows come to lie; and its runs: for
    each partition and group in it the rows of the group before this partition, and the rows of the group in all. Rows
    that are equal in all of these columns are told apart by where they were read, so that a third of all rows may be equal."""
    by = [*group, *order, "tie"]
    placed = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    placed = written(placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "placed", made, "zstd")
    w = Window.partitionBy(*(group or [F.lit(0)]))
    runs = placed.groupBy("part", *group).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, written(runs.select("part", *group, "low", before.alias("before"), F.sum("n").over(w).alias("size")), "runs", made)


def ranked(placed: DataFrame, runs: DataFrame, group: list[str]) -> DataFrame:
    """placed with what its runs have, and with ``idx``, each row's place (from 0) in its group. A run is known by its
    partition too, so a group with most of the rows is no hot key."""
    runs = runs.withColumnsRenamed({c: f"{c}_" for c in ["part", *group]})
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"{g}_")) for g in group), F.col("part") == F.col("part_"))
    return placed.join(runs, same).withColumn("idx", F.col("at") - F.col("low") + F.col("before")).drop("part", "at", "low", "before", "part_", *(f"{g}_" for g in group))


def sizes(n: int, arity: int) -> list[int]:
    """Nodes of each level above n leaves, down to one."""
    out = []
    while n > 1:
        n = -(-n // arity)
        out.append(n)
    return out


def climb(leaves: DataFrame, arity: int, made: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """From leaves (grp, idx, size, digest) the levels (grp, idx, size, digest, others, up) and the roots (grp, height, digest).
    ``others`` are the digests of the run's other slots (null where there is none) and ``up`` is the parent's digest, in
    slot zero only."""
    nodes, levels = written(leaves.select("grp", "idx", "size", "digest"), "merkle", made, "zstd"), []
    most = nodes.agg(F.max("size")).first()[0] or 0
    tops = [nodes.where("size = 1").select("grp", F.lit(0).alias("height"), "digest")]
    for k in range(len(sizes(most, arity))):
        level, slot = nodes.where("size > 1"), F.col("idx") % arity
        if arity == 2:
            level = level.withColumn("other1", F.col("idx").bitwiseXOR(F.lit(1).cast("long")))
        else:
            for i in range(1, arity):
                level = level.withColumn(f"other{i}", F.col("idx") - slot + (slot + i) % arity)
        for i in range(1, arity):
            far = nodes.select(F.col("grp").alias("grp_"), F.col("idx").alias("idx_"), F.col("digest").alias(f"digest{i}"))
            level = level.join(far, (F.col("grp") == F.col("grp_")) & (F.col(f"other{i}") == F.col("idx_")), "left").drop("grp_", "idx_", f"other{i}")
        others = [F.col(f"digest{i}") for i in range(1, arity)]
        up = F.when(slot == 0, digest(F.col("digest"), *(F.coalesce(o, F.lit("")) for o in others)))
        # slot i + j of the run (modulo arity) stands at place j of the others: for slot zero these are slots 1, 2, ... in order
        levels.append(written(level.select("grp", "idx", "size", "digest", F.array(*(F.unhex(o) for o in others)).alias("others"), up.alias("up")), "merkle", made, "zstd"))
        parents = levels[-1].where("up is not null")
        nodes = parents.select("grp", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("size") / arity).alias("size"), F.col("up").alias("digest"))
        tops.append(parents.where(F.col("size") <= arity).select("grp", F.lit(k + 1).alias("height"), F.col("up").alias("digest")))
    return levels, reduce(DataFrame.unionByName, tops)


def step(arity: int) -> Column:
    """A level's step of a proof: the slot, in one byte, and the siblings left to right, 32 bytes each."""
    slot = (F.col("idx") % arity).cast("int")
    turned = F.concat(F.slice("others", F.lit(arity) - slot, slot), F.slice("others", F.lit(1), F.lit(arity - 1) - slot))  # slots 0, 1, ... without one's own
    return F.concat(F.unhex(F.lpad(F.hex(slot), 2, "0")), F.aggregate(F.filter(turned, lambda o: o.isNotNull()), F.unhex(F.lit("")), lambda a, o: F.concat(a, o)))


def descend(levels: list[DataFrame], tops: DataFrame, arity: int, made: list[str]) -> DataFrame:
    """Proofs of the leaves: (grp, idx, top, steps), given those of the roots (grp, height, top, steps)."""
    start = lambda k: tops.where(F.col("height") == k).select("grp", F.lit(0).cast("long").alias("idx"), "top", "steps")
    above = start(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].select("grp", "idx", F.floor(F.col("idx") / arity).alias("over"), step(arity).alias("step"))
        far = above.select(F.col("grp").alias("grp_"), F.col("idx").alias("idx_"), "top", "steps")
        joined = own.join(far, (F.col("grp") == F.col("grp_")) & (F.col("over") == F.col("idx_")))
        above = joined.select("grp", "idx", "top", F.concat(F.array("step"), "steps").alias("steps")).unionByName(start(k))
        if k and k % LEVELS == 0:
            above = written(above, "proofs", made, "zstd")
    return above


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest and the steps of its proof give."""

    def over(acc: Column, s: Column) -> Column:
        before = F.conv(F.hex(F.substring(s, 1, 1)), 16, 10).cast("int") * 64
        others = F.lower(F.hex(s))
        return digest(F.substr(others, F.lit(3), before), acc, F.substr(others, before + 3))

    return F.aggregate(steps, leaf, over)


def siblings(steps: Column) -> Column:
    """All siblings of a proof as hex text, level by level, left to right."""
    return F.concat_ws("", F.transform(steps, lambda s: F.lower(F.substr(F.hex(s), F.lit(3)))))


def manifest(rows: DataFrame, group: str, order: str, leaf: Column, others: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """``order``, the columns ``others``, leaf, subroot, root (hex text) and steps (the proof) of every row; arity from 2 to 16."""
    made: list[str] = []
    out = written(_manifest(rows, group, order, leaf, made, others or {}, arity), "manifest", compression="zstd")
    removed(rows.sparkSession, made)
    return out


def _manifest(rows: DataFrame, group: str, order: str, leaf: Column, made: list[str], others: dict[str, Column], arity: int = ARITY) -> DataFrame:
    if not 2 <= arity <= 16:
        raise ValueError("arity must be from 2 to 16")
    kept = F.struct(F.lit(0).alias("_"), *(v.alias(k) for k, v in others.items())).alias("kept")
    leaves = written(rows.select(F.col(f"`{order}`").alias("id"), F.col(f"`{group}`").alias("name"), leaf.alias("digest"), kept), "leaves", made, "zstd")
    placed, runs = laid(leaves, ["name"], ["id", "digest"], made)
    names = ranked(*laid(runs.select("name").distinct(), [], ["name"], made), [])
    names = names.select(F.col("name").alias("name_"), F.col("idx").alias("grp"))
    runs = written(runs.join(names, F.col("name").eqNullSafe(F.col("name_"))).drop("name_"), "runs", made)
    placed = ranked(placed, runs, ["name"])
    levels, subroots = climb(placed, arity, made)
    subroots = written(subroots, "subroots", made)
    count = F.lit(subroots.count()).cast("long")
    tree, roots = climb(subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), count.alias("size"), "digest"), arity, made)
    top = roots.first()
    proofs = descend(tree, roots.select("grp", "height", F.lit(True).alias("top"), F.array().cast("array<binary>").alias("steps")), arity, made)
    proofs = proofs.select(F.col("idx").alias("grp"), "steps")
    tops = written(subroots.join(proofs, "grp").select("grp", "height", F.unhex("digest").alias("top"), "steps"), "proofs", made, "zstd")
    out = placed.select("grp", "idx", "id", "digest", "kept").join(descend(levels, tops, arity, made), ["grp", "idx"])
    return out.select(F.col("id").alias(order), *(F.col(f"kept.`{k}`").alias(k) for k in others), F.col("digest").alias("leaf"), F.lower(F.hex("top")).alias("subroot"), F.lit(top.digest if top else "").alias("root"), "steps")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = digest(*(field(F.col(c)) for c in FIELDS))
    wrong = digest(*(field(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in FIELDS))
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % TAMPERED == 0
    made: list[str] = []
    out = _manifest(docs, "lang", "doc_id", leaf, made, {"tampered": F.when(hit, wrong)})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("steps"))
    out = out.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("steps"))).alias("proof_sha256"), folded.alias("folded_root"))
    out = written(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest", compression="zstd")
    removed(spark, made)
    return out


OP11_SQL = r"""
with recursive f as (
  select doc_id, lang, source, n_chars, text,
    list_reduce([4294967295::bigint] || list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint),
      lambda c, b: list_reduce([xor(c, b)] || range(8), lambda d, i: xor(d >> 1, (d & 1) * 3988292384))) as crc
  from documents
), leaves as (
  select doc_id, lang, xor(crc, 4294967295) % 7 = 0 as hit,
    sha256(p || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || q) as leaf,
    sha256(p || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || q) as changed
  from (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as p, coalesce(strlen(text) || ':' || text, '-') as q from f)
), numbered as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx from leaves
), level as (
  select lang, 0 as k, list(leaf order by idx) as nodes from numbered group by lang
  union all
  select lang, k + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) from level where len(nodes) > 1
), tops as (
  select lang, nodes[1] as subroot, k as height, row_number() over (order by lang nulls first) - 1 as place from level where len(nodes) = 1
), upper_level as (
  select 0 as k, list(subroot order by place) as nodes from tops
  union all
  select k + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) from upper_level where len(nodes) > 1
), steps as (
  select n.doc_id, n.idx, n.lang, l.k, (n.idx >> l.k) % 2 as slot, l.nodes[xor(n.idx >> l.k, 1) + 1] as sib from numbered n join level l on n.lang is not distinct from l.lang where len(l.nodes) > 1
  union all
  select n.doc_id, n.idx, n.lang, t.height + u.k, (t.place >> u.k) % 2, u.nodes[xor(t.place >> u.k, 1) + 1] from numbered n join tops t on n.lang is not distinct from t.lang, upper_level u where len(u.nodes) > 1
), walk as (
  select lang, idx, 0 as k, case when hit then changed else leaf end as cur from numbered
  union all
  select w.lang, w.idx, w.k + 1, sha256(case when s.slot = 1 then coalesce(s.sib, '') || w.cur else w.cur || coalesce(s.sib, '') end)
  from walk w join steps s on w.lang is not distinct from s.lang and w.idx = s.idx and w.k = s.k
), proof as (
  select lang, idx, sha256(string_agg(coalesce(sib, ''), '' order by k)) as proof_sha256 from steps group by all
), root as (
  select nodes[1] as root from upper_level where len(nodes) = 1
)
select n.doc_id, n.leaf, t.subroot, r.root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, w.cur as folded_root, w.cur = r.root as verified
from numbered n join tops t on n.lang is not distinct from t.lang left join proof p on n.lang is not distinct from p.lang and n.idx = p.idx
join (select lang, idx, arg_max(cur, k) as cur from walk group by all) w on n.lang is not distinct from w.lang and n.idx = w.idx, root r
"""
