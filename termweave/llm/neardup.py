"""Operator 5, near-duplicates by a chosen-path set similarity join over minwise tokens.

A document's set holds the hashes of its word shingles, and its signature the smallest hash in each of ``WIDTH`` parts
of the hash range (an empty part takes that of the first full one in an order of its own). Independent trees branch
documents by tokens of the signature that each node chooses; documents of a node share the chosen tokens. Nodes of few
pairs are compared exhaustively, the others branch again. What looks alike by signature is confirmed on full sets.

Three things keep the work linear where many documents are alike. Equal sets are one class with one representative.
Then the members of each node are compared in blocks of about ``BLOCK`` by signature, and of what looks alike only the
likeliest pairs that span it are confirmed on full sets; as the blocks differ from tree to tree, a crowd of near copies
becomes few components. Only pairs of different components are compared further: a task gets two blocks with their full
sets, compares them by products of incidence matrices, and gives the links that join what is not yet joined, so that no
table holds a row for each pair.

Recall: a pair of similarity 0.8 shares both tokens of a root with probability 0.64, so ``TREES`` = 14 roots miss it
with probability 6e-7; a node that branches, by two more tokens in each of 5 children, loses a pair with probability 0.006.

Rows are told apart by a row number, so that rows without an id are compared like others and different texts under one
id are documents of their own.

Defined results: null and empty texts have empty sets and are linked with nothing; a component has the smallest id of
its rows, or none; repeated rows are copies of one another; an empty table gives an empty result; other columns are
ignored; very long texts are sets like others, compared in a block with no more than ``BLOCK`` members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm._spark import identified, removed, small_batches, table, written
from termweave.llm._text import U, chunks, counted, distinct, mix, word_hashes
from termweave.llm.components import components

WIDTH = 128
TREES = 14
BRANCHES = 5
DEPTH = 3  # levels of branching before a node is compared in blocks all the same
BLOCK = 192
BATCH = 8  # pairs of blocks that a worker holds at once
SALTS = 16  # tasks that the copies of one text are dealt to
COLUMNS = 8192  # hashes in one product of incidence matrices
FEW = 4096  # a node with no more pairs of different components than so many for each member does not branch
PERCENT = 80
_seeds = np.random.default_rng(20240501)
ROOTS = np.stack([_seeds.choice(WIDTH, 2, replace=False) for _ in range(64)])
#: For each part of the hash range the order in which it looks for a full one.
LENDERS = np.argsort(_seeds.random((WIDTH, WIDTH)), axis=1)
_C = mix(np.arange(11, 27, dtype=U) * U(0xA24BAED4963EE407)) | U(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    h, first = word_hashes(data, off)
    n = len(h) - k + 1
    if n > 0:
        s = h[:n] * _C[0]
        for j in range(1, k):
            s += h[j : j + n] * _C[j]
        s = mix(s + U(k))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(distinct(s[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * _C[: b - a]).sum() + U(b - a)], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    edges = np.searchsorted(s, np.arange(WIDTH, dtype=U) << U(57))
    full = np.append(edges[1:], len(s)) > edges
    if not full.all():
        edges = np.where(full, edges, edges[LENDERS[np.arange(WIDTH), full[LENDERS].argmax(1)]])
    return (s[edges] >> U(25)).astype(np.uint32)


def signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, doc_id, text) to (row, doc_id, n, digest, signature, sketch); the sketch has a byte of each token."""
        for batch, data, off in chunks(batches, text=2):
            sets = shingle_sets(data, off, k)
            made = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([x.tobytes() if x is not None else None for x in made], pa.binary()),
                    pa.array([x.astype(np.uint8).tobytes() if x is not None else None for x in made], pa.binary()),
                ],
                ["row", "doc_id", "n", "digest", "signature", "sketch"],
            )

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, WIDTH)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, signature) to (key, rep): the root's child in each tree."""
    for batch in batches:
        if batch.num_rows:
            sig, n = _signatures(batch.column(1)).astype(U), batch.num_rows
            keys = np.stack([mix(mix(sig[:, i] + (sig[:, j] << U(32))) + U(t)) for t, (i, j) in enumerate(ROOTS[:TREES])], 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(n), TREES)))], ["key", "rep"])


def branched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rep, signature) to (key, rep) in the children of the node, which chooses the tokens."""
    for batch in batches:
        if batch.num_rows:
            sig, n = _signatures(batch.column(2)), batch.num_rows
            key = batch.column(0).to_numpy().view(U)
            picked = [mix(key + U(7919 * (b + 1))) for b in range(BRANCHES)]
            token = lambda p: sig[np.arange(n), (p % U(WIDTH)).astype(int)].astype(U)
            child = np.stack([mix(p + token(p) + (token(p >> U(20)) << U(32))) for p in picked], 1)
            yield pa.RecordBatch.from_arrays([pa.array(child.ravel().view(np.int64)), batch.column(1).take(pa.array(np.repeat(np.arange(n), BRANCHES)))], ["key", "rep"])


def alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may have the similarity: sizes allow it exactly, signatures within five deviations or so."""
    small, large = np.minimum(n, m), np.maximum(n, m)
    bound = np.where(small >= 256, percent / 100 - 0.2, np.where(small >= 48, percent / 100 - 0.4, -1))
    return (100 * small >= percent * large) & ((a == b).mean(-1) >= bound)


def spanning(score: np.ndarray) -> list[tuple[int, int]]:
    """The edges of a largest spanning forest of a node's members; a negative score is no edge."""
    m = len(score)
    best, parent, out, rest = np.full(m, -1), np.zeros(m, int), [], np.ones(m, bool)
    for _ in range(m):
        i = int(np.where(rest, best, -2).argmax())
        if best[i] >= 0:
            out.append((int(parent[i]), i))
        rest[i] = False
        better = score[i] > best
        best[better], parent[better] = score[i][better], i
    return out


def forests(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks (reps, ns, sketches) to the likeliest pairs (u, v) that span what looks alike in each."""
        for batch in batches:
            reps, n, sig = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), _sketches(batch.column(2).flatten())
            off = np.concatenate(([0], np.cumsum(batch.column(0).value_lengths().to_numpy()))).astype(np.int64)
            two = off[:-1][np.diff(off) == 2]
            two = two[alike(sig[two], sig[two + 1], n[two], n[two + 1], percent)]
            us, vs = [two], [two + 1]
            for i in np.flatnonzero(np.diff(off) > 2):
                at = np.arange(off[i], off[i + 1])
                same = (sig[at][:, None] == sig[at][None, :]).sum(-1)
                ok = alike(sig[at][:, None], sig[at][None, :], n[at][:, None], n[at][None, :], percent)
                edges = np.array(spanning(np.where(ok, same, -1)), np.int64).reshape(-1, 2) + off[i]
                us.append(edges[:, 0])
                vs.append(edges[:, 1])
            pairs = np.stack([reps[np.concatenate(us)], reps[np.concatenate(vs)]])
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(0)), pa.array(pairs.max(0))], ["u", "v"])

    return run


def shared(a: list[np.ndarray], b: list[np.ndarray], alone: bool) -> np.ndarray:
    """How many hashes each set of a shares with each of b (alone: a and b are the same sets), by products of incidence
    matrices over the hashes that can be shared."""
    x, y = np.concatenate(a), np.concatenate(b)
    if alone:
        known, times = counted(x)
        known = known[times > 1]
    else:
        known = np.intersect1d(distinct(x), distinct(y), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(known):
        return out
    places = []
    for values, sets in ((x, a), (y, b)):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        hit = known[at] == values
        places.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]))
    for c in range(0, len(known), COLUMNS):
        sides = []
        for (of, at), sets in zip(places, (a, b), strict=True):
            here = (at >= c) & (at < c + COLUMNS)
            side = np.zeros((len(sets), min(COLUMNS, len(known) - c)), np.float32)
            side[of[here], at[here] - c] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def linking(percent: int, sides: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks, or pairs of blocks, with lists (reps, comps, sets), to links (u, v) between different components: every
        pair is compared on full sets, and of the links found those that join what is not yet joined stay."""
        for batch in batches:
            us, vs = [], []
            for row in batch.to_pylist():
                held = [[np.frombuffer(s, U) for s in row[f"{x}_sets"]] for x in sides]
                label = [np.array(row[f"{x}_comps"]) for x in sides]
                reps = [row[f"{x}_reps"] for x in sides]
                a, b, la, lb = held[0], held[-1], label[0], label[-1].copy()
                both = shared(a, b, len(sides) == 1)
                n, m = (np.array([len(s) for s in z], np.float64) for z in (a, b))
                x, y = np.nonzero((100 * both >= percent * (n[:, None] + m[None, :] - both)) & (la[:, None] != lb[None, :]))
                while len(x):
                    i, j = x[0], y[0]
                    us.append(reps[0][i])
                    vs.append(reps[-1][j])
                    old, new = lb[j], la[i]
                    la, lb = np.where(la == old, new, la), np.where(lb == old, new, lb)
                    open_ = la[x] != lb[y]
                    x, y = x[open_], y[open_]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(u, v, set of u, set of v) to the pairs that have the similarity."""
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                i = np.searchsorted(b, a)
                both = int((b[np.minimum(i, len(b) - 1)] == a).sum())
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


class Join:
    """One run of the operator over a table of documents, whose rows have numbers that every scan gives them alike."""

    def __init__(self, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str):
        self.k, self.percent, self.made = k, percent, []
        self.placed, self.number = identified(docs, self.made)
        self.rows = self.placed.select(F.col(self.number).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        self.signed = written(self.rows.mapInArrow(signed(k), "row long, doc_id long, n long, digest binary, signature binary, sketch binary"), "signed", self.made)
        # a class is represented by its first row
        classes = self.signed.where("digest is not null").groupBy("digest").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
        self.reps = written(classes, "classes", self.made)

    def crowded(self, rows: DataFrame) -> DataFrame:
        """The rows (key, rep) of nodes with more than one member, with their number."""
        nodes = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        return rows.join(nodes, "key")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        a, b = self.sets.select(F.col("rep").alias("u"), F.col("shingles").alias("a")), self.sets.select(F.col("rep").alias("v"), F.col("shingles").alias("b"))
        return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(confirmed(self.percent), "u long, v long")

    def linked(self) -> DataFrame:
        """(rep, component) of the representatives that are linked with another."""
        k = self.k
        members = written(self.crowded(self.reps.select("rep", "signature").mapInArrow(roots, "key long, rep long")), "nodes", self.made)
        # first the likeliest pairs alone, as many as span what looks alike in a block of a node
        blocks = members.join(self.reps.select("rep", "n", "sketch"), "rep").groupBy("key", F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("m") / BLOCK)).alias("block"))
        likely = blocks.agg(*(F.collect_list(c).alias(n) for c, n in (("rep", "reps"), ("n", "ns"), ("sketch", "sketches")))).where(F.size("reps") > 1)
        pairs = written(likely.select("reps", "ns", "sketches").mapInArrow(forests(self.percent), "u long, v long").distinct(), "likely", self.made)
        # the sets of those that look like another, or were not compared with all of a node, from their whole texts
        near = pairs.select(F.explode(F.array("u", "v")).alias("row")).unionAll(members.where(F.col("m") > BLOCK).select("rep")).distinct()

        def sets(batches):
            for batch, data, off in chunks(batches, text=1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(data, off, k)], pa.binary())], ["rep", "shingles"])

        # by sorting at every size, as for a corpus whose near copies are too many to send to all tasks
        texts = self.rows.select("row", "text").join(near.hint("merge"), "row", "left_semi")
        self.sets = written(texts.select("row", "text").mapInArrow(sets, "rep long, shingles binary"), "sets", self.made)
        links = written(self.confirm(pairs), "links", self.made)
        comps = written(components(links, self.made).withColumnRenamed("node", "rep"), "components", self.made)
        # then all pairs of different components that share a node
        more = written(self.mixed_links(members.join(self.sets.select("rep"), "rep", "left_semi"), comps), "links", self.made)
        return comps if more.isEmpty() else written(self.joined(comps, more), "components", self.made)

    def mixed_links(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """Links between different components that share a node of the trees."""
        found, percent = [], self.percent
        for level in range(DEPTH + 1):
            placed = members.select("key", "rep").join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
            shares = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
            big = F.when(F.col("c") >= BLOCK, F.col("c")).otherwise(0)
            nodes = shares.groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.count("*").alias("parts"), F.sum(big).alias("in_big")).where("parts > 1")
            large = ((F.col("m") * F.col("m") - F.col("squares")) / 2 > FEW * F.col("m")).alias("large")
            mixed = placed.join(nodes.select("key", "m", "in_big", large), "key").join(shares.where(F.col("c") >= BLOCK), ["key", "component"], "left")
            mixed = written(mixed, "mixed", self.made)
            deep = level < DEPTH and mixed.where("large").limit(1).count() > 0
            now = (mixed.where("not large") if deep else mixed).join(self.sets, "rep")
            # a component with many members here has blocks of its own, which need no comparison with one another
            part = lambda n: F.pmod(F.xxhash64("rep"), F.ceil(n / BLOCK))
            block = F.when(F.col("c").isNotNull(), F.xxhash64("component", part(F.col("c")))).otherwise(part(F.col("m") - F.col("in_big"))).alias("block")
            lists = lambda x: [F.collect_list(c).alias(f"{x}_{n}") for c, n in (("rep", "reps"), ("component", "comps"), ("shingles", "sets"))]
            blocks = lambda df, x: df.groupBy("key", block).agg(F.min("component").alias(f"{x}_low"), F.max("component").alias(f"{x}_high"), *lists(x)).withColumnRenamed("block", f"{x}_block")
            alone = blocks(now, "a").where("a_low <> a_high")
            many = now.where((F.col("m") > BLOCK) | (F.col("in_big") > 0))
            across = blocks(many, "a").join(blocks(many, "b"), "key").where("a_block < b_block and not (a_low = a_high and b_low = b_high and a_low = b_low)")
            names = lambda sides: [f"{x}_{c}" for x in sides for c in ("reps", "comps", "sets")]
            with small_batches(now.sparkSession, BATCH):
                for df, sides in ((alone, "a"), (across, "ab")):
                    found.append(written(df.select(*names(sides)).mapInArrow(linking(percent, sides), "u long, v long"), "found", self.made))
            if not deep:
                break
            children = mixed.where("large").select("key", "rep").join(self.reps.select("rep", "signature"), "rep").select("key", "rep", "signature").mapInArrow(branched, "key long, rep long")
            members = written(self.crowded(children), "nodes", self.made)
        links = found[0]
        for f in found[1:]:
            links = links.unionAll(f)
        return links

    def joined(self, comps: DataFrame, more: DataFrame) -> DataFrame:
        """comps with the links ``more`` taken in."""
        # links between components join these; what was no component yet is one by itself
        ends = more.select("u", "v", F.explode(F.array("u", "v")).alias("rep")).join(comps, "rep", "left")
        joined = ends.groupBy("u", "v").agg(F.min(F.coalesce("component", "rep")).alias("a"), F.max(F.coalesce("component", "rep")).alias("b"))
        over = components(joined.select(F.col("a").alias("u"), F.col("b").alias("v")), self.made).select(F.col("node").alias("component"), F.col("component").alias("above"))
        lone = more.select(F.explode(F.array("u", "v")).alias("rep")).distinct().join(comps.select("rep"), "rep", "left_anti").select("rep", F.col("rep").alias("component"))
        return comps.unionByName(lone).join(over, "component", "left").select("rep", F.coalesce("above", "component").alias("component"))

    def members(self) -> DataFrame:
        """row, doc_id, n, component (a row number; null for an empty set) and the component's smallest id of every row."""
        linked, ids = self.linked(), self.reps.select("rep", "id")
        least = linked.join(ids, "rep").groupBy("component").agg(F.min("id").alias("least"))
        linked = linked.join(least, "component").select("rep", "component", "least")
        of = self.reps.select("digest", "rep", "id", "copies").join(linked, "rep", "left").select("digest", "rep", "copies", F.coalesce("component", "rep").alias("component"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("least"))
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        own = of.select(F.col("rep").alias("row"), F.struct("component", "least").alias("own"))
        copied = of.where("copies > 1").select("digest", F.struct("component", "least").alias("copied"), salt)
        rows = self.signed.select("row", "doc_id", "n", "digest", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
        rows = rows.join(own, "row", "left").join(copied, ["digest", "salt"], "left").withColumn("found", F.coalesce("own", "copied"))
        least = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("found.least"))
        return rows.select("row", "doc_id", "n", F.col("found.component").alias("component"), least.alias("least"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every row of docs."""
    join = Join(docs, shingle, percent, id_col, text_col)
    rows = join.members()
    out = written(rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("least")).alias("kept")), "near")
    removed(docs.sparkSession, join.made)
    return out


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of docs: the one with the smallest id, of repeated rows the first; empty texts stay."""
    join = Join(docs, 5, PERCENT, "doc_id", "text")
    group = F.coalesce("component", "row")
    first = join.members().groupBy(group.alias("group")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    kept = written(first.select(F.col("first.row").alias(join.number)), "kept")
    if not any("/numbered-" in path for path in join.made):
        removed(spark, join.made)
    return join.placed.join(kept.hint("merge"), join.number, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
