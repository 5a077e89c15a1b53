"""Merkle manifest of a dataset, with a membership proof for every row found by pointer jumping.

A row's leaf is the SHA-256 of its fields. The leaves of a key (such as the language) stand in order, and every ``FAN``
consecutive nodes of a level make one node of the next, until one is left, the key's subroot; the subroots make the root
in the same way. Every node but the root holds a segment, its siblings to the left and right, and a pointer to its parent.
In each round a node takes over the segment and the pointer of the node it points to, so the distance to the ancestor
doubles and a leaf has its whole proof after about log2(height) rounds.

No node meets more than 64 askers at a time: consecutive nodes that point to one ancestor ask as a block, the answer goes
to the block, so the ancestors near the root, which all rows share, are no hot keys. Places in a key are numbers within
range partitions plus the rows of the partitions before, so a key may hold any share of the rows. Only digests are shuffled.

Defined cases: a null field counts as ``-`` in the leaf; null ids come first, equal ids in the order of their leaves;
repeated rows are leaves each; null keys form a key of their own before all others; a lone leaf is its key's subroot and a
lone subroot the root; an empty table has no root and gives no row; only the named columns are read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revgrain.llm.common import BROADCAST_ROWS, written

#: Nodes that make one node of the next level: 2 to the power of this.
FAN_BITS = 3
#: Nodes of a level that ask for an ancestor together: 2 to the power of this.
BLOCK_BITS = 6
#: The tree of subroots; trees of keys are named '' (null) or '=' and the key.
TOP = "+"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Manifest(NamedTuple):
    """``proofs``: (id, tree, leaf, other, segment); ``subroots``: (tree, subroot); ``root``: the dataset's digest, None without rows."""

    proofs: DataFrame
    subroots: DataFrame
    root: str | None


def field(value: Column) -> Column:
    """A field as it enters a leaf: its length in UTF-8 bytes, a colon and the value, or ``-``."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def ranked(rows: DataFrame, within: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, from 0 in the order of ``order`` inside each value of ``within``, and ``n``, the rows of that value."""
    full = [within, *order]
    parts = rows.repartitionByRange(*full).sortWithinPartitions(*full)
    local = written(parts.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "merkle-ranges")
    runs = written(local.groupBy("part", within).agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("size")), "merkle-runs")
    by = Window.partitionBy(within)
    before = F.sum("size").over(by.orderBy("part")) - F.col("size")
    shift = runs.select("part", within, (before - F.col("first")).alias("shift"), F.sum("size").over(by).alias("n"))
    if runs.count() <= BROADCAST_ROWS:  # a row for each partition and each value that begins in it
        shift = F.broadcast(shift)
    return local.join(shift, ["part", within]).withColumn("idx", F.col("nth") + F.col("shift")).drop("part", "nth", "shift")


def _joined(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda m: m["hash"]), "")


def _grow(leaves: DataFrame, level: int = 0) -> tuple[list[DataFrame], DataFrame | None]:
    """From (tree, idx, n, hash, key, doc): every node below its tree's root with its first segment, and the roots (tree, level, hash)."""
    nodes, roots, current = [], None, leaves
    while True:
        tops = current.filter("n = 1").select("tree", F.lit(level).alias("level"), "hash")
        roots = tops if roots is None else roots.unionByName(tops)
        member = F.struct("idx", "hash", "key", "doc")
        run = F.shiftright("idx", FAN_BITS).alias("run")
        runs = written(current.filter("n > 1").groupBy("tree", "n", run).agg(F.array_sort(F.collect_list(member)).alias("members")), "merkle-level")
        if runs.isEmpty():
            return nodes, roots
        n = F.shiftright(F.col("n") + (2**FAN_BITS - 1), FAN_BITS)
        level += 1
        up = F.struct("tree", F.lit(level).alias("level"), F.col("run").alias("idx"))
        each = runs.select("*", n.alias("above"), up.alias("up"), F.posexplode("members").alias("k", "m"))
        left, right = F.slice("members", F.lit(1), F.col("k")), F.slice("members", F.col("k") + 2, F.size("members"))
        segment = F.struct(F.unhex(_joined(left)).alias("left"), F.unhex(_joined(right)).alias("right"))
        nodes.append(each.select("m.key", "m.doc", F.array(segment).alias("segment"), "up", (F.col("above") == 1).alias("last")))
        key = F.struct("tree", F.lit(level).alias("level"), F.col("run").alias("idx"))
        current = runs.select("tree", F.col("run").alias("idx"), n.alias("n"), F.sha2(_joined(F.col("members")), 256).alias("hash"), key.alias("key"), F.lit(None).cast(leaves.schema["doc"].dataType).alias("doc"))


def _jump(nodes: DataFrame) -> DataFrame:
    """Nodes (key, doc, segment, up) with the segment grown until it ends at the root, where ``up`` is null."""
    while True:
        nodes = written(nodes, "merkle-jump")
        below = nodes.filter("up is not null")
        if below.isEmpty():
            return nodes
        block = F.struct("key.tree", "key.level", F.shiftright("key.idx", BLOCK_BITS).alias("block"))
        below = below.withColumn("block", block)
        above = nodes.filter("doc is null").select(F.col("key").alias("up"), F.col("segment").alias("more"), F.col("up").alias("further"))
        answers = below.select("up", "block").distinct().join(above, "up")
        grown = below.join(answers, ["up", "block"]).select("key", "doc", F.concat("segment", "more").alias("segment"), F.col("further").alias("up"))
        nodes = grown.unionByName(nodes.filter("up is null"))


def manifest(rows: DataFrame, id_col: str = "doc_id", key_col: str = "lang", fields: list[str] = FIELDS, other: Column | None = None) -> Manifest:
    """Leaves, proofs, subroots and root of ``rows``. ``other``: a second leaf to carry along, such as that of a changed row."""
    other = F.lit(None).cast("string") if other is None else other
    tree = F.coalesce(F.concat(F.lit("="), F.col(key_col).cast("string")), F.lit(""))
    flat = rows.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf([F.col(f) for f in fields]).alias("hash"), F.unhex(other).alias("other"))
    flat = ranked(flat, "tree", ["id", "hash"])
    doc = F.struct("id", F.unhex("hash").alias("leaf"), "other")
    leaves = flat.select("tree", "idx", "n", "hash", F.struct("tree", F.lit(0).alias("level"), "idx").alias("key"), doc.alias("doc"))
    nodes, roots = _grow(leaves)
    subroots = written(roots, "merkle-subroots")
    trees = subroots.count()
    empty = F.array().cast("array<struct<left:binary,right:binary>>")
    alone = leaves.filter("n = 1").select("key", "doc", empty.alias("segment"), F.col("key").alias("up"), F.lit(True).alias("last"))
    below = alone
    for some in nodes:
        below = below.unionByName(some)
    if trees > 1:
        order = ranked(subroots.withColumn("top", F.lit(TOP)), "top", ["tree"])
        key = F.struct("tree", "level", F.lit(0).cast("long").alias("idx"))
        heads = order.select(F.lit(TOP).alias("tree"), "idx", "n", "hash", key.alias("key"), F.lit(None).cast(leaves.schema["doc"].dataType).alias("doc"))
        nodes, tops = _grow(heads)
        below = below.withColumn("last", F.lit(False))
        for some in nodes:
            below = below.unionByName(some)
        root = tops.first()["hash"]
    else:
        root = subroots.first()["hash"] if trees else None
    reached = _jump(below.select("key", "doc", "segment", F.when(~F.col("last"), F.col("up")).alias("up")))
    proofs = reached.filter("doc is not null").select("doc.id", "key.tree", "doc.leaf", "doc.other", "segment")
    return Manifest(proofs, subroots.select("tree", F.col("hash").alias("subroot")), root)


def digest(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def siblings(segment: Column) -> Column:
    """All siblings of a proof as digits, level by level, left to right."""
    return F.array_join(F.transform(segment, lambda s: F.concat(digest(s["left"]), digest(s["right"]))), "")


def fold(start: Column, segment: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(segment, start, lambda at, s: F.sha2(F.concat(digest(s["left"]), at, digest(s["right"])), 256))


def with_subroots(made: Manifest) -> DataFrame:
    """The proofs with the subroot of each row's key."""
    few = made.subroots.count() <= BROADCAST_ROWS
    return made.proofs.join(F.broadcast(made.subroots) if few else made.subroots, "tree")
