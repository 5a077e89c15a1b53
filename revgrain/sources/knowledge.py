"""Knowledge collections and versioned conversations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revgrain.operators import ordering


def new_knowledge(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items whose (collection, item_id) is not stored yet, each once."""
    return items.dropDuplicates(["collection", "item_id"]).join(stored, ["collection", "item_id"], "left_anti")


def append_knowledge(items: DataFrame, stored: DataFrame, path: str) -> None:
    new_knowledge(items, stored).write.mode("append").partitionBy("collection").parquet(path)


def versioned_upsert(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply one update per key under optimistic locking.

    current: user_id, conv_id, title, version. updates: user_id, conv_id, title, version, op (save or delete). Version 0
    inserts and needs a free key; any other version must equal the stored one. Each key gives one row with its outcome:
    kept, inserted, updated, deleted or conflict, and the state it then has (version null once it is gone).
    """
    keys = ["user_id", "conv_id"]
    old = current.select(*keys, F.col("title").alias("old_title"), F.col("version").alias("old_version"))
    new = updates.select(*keys, F.col("title").alias("new_title"), F.col("version").alias("new_version"), "op")
    both = old.join(new, keys, "full_outer")
    same = F.coalesce(F.col("old_version") == F.col("new_version"), F.lit(False))
    outcome = (
        F.when(F.col("op").isNull(), "kept")
        .when((F.col("op") == "delete") & same, "deleted")
        .when(F.col("op") == "delete", "conflict")
        .when((F.col("new_version") == 0) & F.col("old_version").isNull(), "inserted")
        .when((F.col("new_version") != 0) & same, "updated")
        .otherwise("conflict")
    )
    both = both.withColumn("outcome", outcome)
    taken = F.col("outcome").isin("inserted", "updated")
    return both.select(
        *keys, "outcome", F.when(taken, F.col("new_title")).when(F.col("outcome") != "deleted", F.col("old_title")).alias("title"),
        F.when(F.col("outcome") == "inserted", 1).when(F.col("outcome") == "updated", F.col("old_version") + 1)
        .when(F.col("outcome") != "deleted", F.col("old_version")).alias("version"),
    )


KEYS = ["user_id", "conv_id"]


def _next(op: str | None, version: int | None, now: int) -> tuple[str, int]:
    """Outcome of one update on a key of version ``now`` (0: there is none), and the version after it."""
    if op == "delete":
        return ("deleted", 0) if version == now and now else ("conflict", now)
    if version == now:
        return ("updated", now + 1) if now else ("inserted", 1)
    return "conflict", now


def _moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the updates of a key in one part do to any version: rows (key, part, before, after), a first one with -1 for the key itself.

    An update moves one version and leaves all others alone, so a run of updates is a map of the versions it names. ``at`` holds
    the versions from which each present version is reached, ``moved`` those that no longer stand for themselves.
    """
    key, part, at, moved = None, None, {}, set()

    def out() -> pa.RecordBatch:
        pairs = [(-1, -1)] + [(before, after) for after, some in at.items() for before in some if before != after]
        columns = [[key[0]] * len(pairs), [key[1]] * len(pairs), [part] * len(pairs), [p[0] for p in pairs], [p[1] for p in pairs]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*KEYS, "part", "before", "after"])

    for batch in batches:
        for user, conv, pid, op, version in zip(*[batch[c].to_pylist() for c in (*KEYS, "_pid", "op", "version")]):
            if (user, conv) != key or pid != part:
                if key is not None:
                    yield out()
                key, part, at, moved = (user, conv), pid, {}, set()
            if version is None or version < 0:
                continue
            outcome, after = _next(op, version, version)
            if outcome == "conflict":
                continue
            some = at.pop(version, [])
            if version not in moved:
                moved.add(version)
                some.append(version)
            there = at.setdefault(after, [])
            if len(there) < len(some):
                at[after], some = some, there
            at[after].extend(some)
    if key is not None:
        yield out()


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The version with which each part of a key begins: parts in order, the stored version first (part -1), a part's own row before its moves."""
    key, now, after_part = None, 0, None
    for batch in batches:
        rows = []
        for user, conv, part, before, after in zip(*[batch[c].to_pylist() for c in (*KEYS, "part", "before", "after")]):
            if (user, conv) != key:
                key, now, after_part = (user, conv), 0, None
            if part == -1:
                now = after
            elif before == -1:
                now = now if after_part is None else after_part
                rows.append((user, conv, part, now))
                after_part = now
            elif before == now:
                after_part = after
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*KEYS, "_pid", "version"])


def apply_updates(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Any number of updates per key, one after the other in the order of ``seq``, under the rules of ``versioned_upsert``.

    updates: user_id, conv_id (long), seq (unique for a key), title, version, op. One row for each update: keys, seq, outcome, title (of updates
    that took effect) and the key's version behind it, null once it is gone. Updates are cut into ranges of (key, seq), so a busy key is spread
    over many tasks: each range tells what it does to any version, these maps give the version each range
    begins with, and the ranges run side by side from there.
    """
    rows = ordering.ranged(updates.select(*KEYS, "seq", "title", F.col("version").cast("long").alias("version"), "op"), [*KEYS, "seq"])
    long = ", ".join(f"{k} long" for k in KEYS)
    moves = rows.sortWithinPartitions(*KEYS, "seq").select(*KEYS, F.col("_pid").cast("long").alias("_pid"), "op", "version").mapInArrow(_moves, f"{long}, part long, before long, after long")
    stored = current.select(*KEYS, F.lit(-1).cast("long").alias("part"), F.lit(-1).cast("long").alias("before"), F.col("version").cast("long").alias("after"))
    known = moves.unionByName(stored).repartition(*KEYS).sortWithinPartitions(*KEYS, "part", "before")
    starts = known.mapInArrow(_starts, f"{long}, _pid long, version long")
    first = starts.select(*KEYS, F.col("_pid").cast("int").alias("_pid"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("title"), "version", F.lit(None).cast("string").alias("op"))
    dealt = first.withColumn("_begins", F.lit(True)).unionByName(rows.withColumn("_begins", F.lit(False))).repartition(*KEYS, "_pid").sortWithinPartitions(*KEYS, "_pid", F.desc("_begins"), "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = 0
        for batch in batches:
            at, outcomes, versions = [], [], []
            for i, (begins, op, version) in enumerate(zip(*[batch[c].to_pylist() for c in ("_begins", "op", "version")])):
                if begins:
                    now = version
                    continue
                outcome, now = _next(op, version, now) if version is not None else ("conflict", now)
                at.append(i)
                outcomes.append(outcome)
                versions.append(now or None)
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([some[c] for c in (*KEYS, "seq", "title")] + [pa.array(outcomes, pa.string()), pa.array(versions, pa.int64())], names=[*KEYS, "seq", "title", "outcome", "version"])

    kinds = dealt.select("seq", "title").schema.simpleString().removeprefix("struct<").removesuffix(">")
    done = dealt.mapInArrow(run, f"{long}, {kinds}, outcome string, version long")
    return done.withColumn("title", F.when(F.col("outcome").isin("inserted", "updated"), F.col("title")))


def state_after(current: DataFrame, applied: DataFrame) -> DataFrame:
    """The rows of ``current`` after ``apply_updates``: keys, title, version."""
    took = F.col("outcome").isin("inserted", "updated", "deleted")
    last = applied.where(took).groupBy(*KEYS).agg(F.max_by(F.struct("title", "version"), "seq").alias("last"))
    both = current.select(*KEYS, "title", F.col("version").cast("long").alias("version")).join(last, KEYS, "full_outer")
    pick = lambda c: F.when(F.col("last").isNotNull(), F.col(f"last.{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*KEYS, pick("title"), pick("version")).where(F.col("version").isNotNull())
