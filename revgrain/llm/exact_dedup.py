"""Exact duplicates through an extendible-hash index that lies in shared files.

Every text gets a 64-bit key. The directory starts with one bucket and doubles while a bucket holds more than
``capacity`` distinct keys: an overfull bucket is split by one more leading bit, the others keep their depth. The entries
are written as files in directory order, so each owner task holds a range of (bucket, key) and combines its entries by key.
A key with one entry is settled by the index alone. For a key with several, the owners fetch the texts and compare them byte by byte:
equal ones form a link of the key's chain, texts of equal key but different bytes become separate links. Keeper and group size
are those of the link. Copies meet in the partial aggregation of every task first, so a group that holds a third of all rows sends one row a
task, and links of hot keys go to all tasks, so its entries are answered where they lie.

Defined cases: a null text counts as empty and all empty texts form one group; null ids come after all others when the
keeper is chosen; repeated rows are members of their group like others; an empty table gives an empty result; only the id
and the text column are read, others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revgrain.llm.common import BROADCAST_ROWS, HOT_SHARE, looked_up, text_of, written
from revgrain.session import cut_lineage

WHITE_SPACE = r"[\x20\x09-\x0D]+"
CAPACITY = 4096


def normalised(text: Column) -> Column:
    """The text without blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns."""
    return F.regexp_replace(text, WHITE_SPACE, "")


def prefix(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """Directory of distinct ``key`` rows: (slot, bucket, local_depth, n_keys) for each slot of the final depth.

    Doubling goes on while a bucket is overfull. All keys differ, so it ends.
    """
    total = keys.count()
    fine = max(4, math.ceil(math.log2(max(total, 1) / capacity)) + 4) if total > capacity else 4
    while True:
        slots = cut_lineage(keys.groupBy(prefix(F.col("key"), fine).alias("slot")).agg(F.count(F.lit(1)).alias("n")))
        fullest = slots.agg(F.max("n")).first()[0] or 0
        if fullest <= capacity:
            break
        fine += 4
    depth, settled, left = 0, None, slots
    while True:
        bucket = F.shiftrightunsigned(F.col("slot"), fine - depth)
        sized = left.withColumn("bucket", bucket)
        sums = sized.groupBy("bucket").agg(F.sum("n").alias("n_keys"))
        sized = cut_lineage(sized.join(sums, "bucket"))
        fits = sized.filter(F.col("n_keys") <= capacity).withColumn("local_depth", F.lit(depth))
        settled = fits if settled is None else settled.unionByName(fits)
        left = sized.filter(F.col("n_keys") > capacity).select("slot", "n")
        if left.isEmpty():
            return settled.select("slot", "bucket", "local_depth", "n_keys"), fine
        depth += 1


def key_of(plain: Column) -> Column:
    """The key of a normalised text, as even over 64 bits as the directory needs it."""
    return F.xxhash64(plain)


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=key_of) -> DataFrame:
    """One index entry for each row: (id, key, digest, n_points), without the text."""
    text = text_of(text_col)
    plain = docs.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("n_points"), normalised(text).alias("plain"))
    return plain.select("id", key(F.col("plain")).alias("key"), F.sha2("plain", 256).alias("digest"), "n_points")


def write_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key=key_of) -> DataFrame:
    """The index files: entries with their bucket, in directory order, a key range for each owner task."""
    flat = written(entries(docs, id_col, text_col, key), "dedup-entries")
    slots, depth = directory(flat.select("key").distinct(), capacity)
    if 2**depth <= BROADCAST_ROWS:  # the directory has at most 2**depth rows
        slots = F.broadcast(slots)
    placed = flat.withColumn("slot", prefix(F.col("key"), depth)).join(slots, "slot")
    columns = ["bucket", "local_depth", "key", "id", "digest", "n_points"]
    return written(placed.select(*columns).repartitionByRange("bucket", "key", "id").sortWithinPartitions("bucket", "key", "id"), "dedup-index")


def shared_keys(index: DataFrame) -> DataFrame:
    """The keys that several entries of the index have: (key, many). Each owner combines its range before the shuffle."""
    return index.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")


def chains(docs: DataFrame, shared: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=key_of) -> DataFrame:
    """The chain links of the ``shared`` keys: (link, keep_id, many), one row for each different text, equal bytes grouped.

    Texts of other keys are left out, by a broadcast for the few hot keys and by a join for the rest. Of a link the row with
    the most code points stays, then the one with the smallest id. ``link`` is (key, digest), by which entries find it.
    """
    text = text_of(text_col)
    rows = docs.select(normalised(text).alias("plain"), F.length(text).alias("n_points"), F.col(id_col).alias("id"))
    rows = rows.select("*", key(F.col("plain")).alias("key"))
    total = docs.count()
    hot = F.broadcast(shared.filter(F.col("many") * HOT_SHARE > total).select("key"))
    cold = shared.filter(F.col("many") * HOT_SHARE <= total).select("key")
    fetched = rows.join(hot, "key", "left_semi").unionByName(rows.join(hot, "key", "left_anti").join(cold, "key", "left_semi"))
    order = F.struct((-F.col("n_points")).alias("points"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    groups = fetched.groupBy("key", "plain").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("many"))
    return groups.select(F.struct("key", F.sha2("plain", 256).alias("digest")).alias("link"), F.col("best.id").alias("keep_id"), "many")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key=key_of) -> DataFrame:
    """For each row: (id, keep_id, group_size, kept, digest, bucket)."""
    index = write_index(docs, id_col, text_col, capacity, key)
    shared = written(shared_keys(index), "dedup-shared")
    links = written(chains(docs, shared, id_col, text_col, key), "dedup-links")
    linked = index.select("id", "bucket", F.struct("key", "digest").alias("link"))
    # Without a link there is no other entry of the key, so the row is a group of its own.
    found = looked_up(linked, links.withColumnRenamed("many", "group_size").withColumn("many", F.col("group_size")), "link")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id")
    rows = found.select("id", keep_id, F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "link.digest", "bucket")
    return rows.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "bucket")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, whole, one for each different text, by the same grouping and order as ``chains``."""
    text = text_of(text_col)
    order = F.struct((-F.length(text)).alias("points"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), normalised(text).alias("plain"), order.alias("place"))
    groups = rows.groupBy(F.xxhash64("plain").alias("key"), "plain").agg(F.min_by("row", "place").alias("row"))
    return groups.select("row.*")
