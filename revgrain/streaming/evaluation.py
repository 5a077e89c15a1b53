"""Searching lines as they arrive, judging records once, and versioned conversation updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from revgrain.operators import ranking
from revgrain.sources.knowledge import KEYS, apply_updates, state_after, versioned_upsert
from revgrain.streaming.buckets import BUCKETS, Buckets
from revgrain.streaming.runner import drain


def search_stream(lines: DataFrame, queries: dict[str, list[str]], k: int, folder: str) -> DataFrame:
    """``search_topk`` over a stream of lines: the best line per file is kept as state, the ranking follows at the end."""
    best = ranking.best_hits(ranking.search_hits(lines, queries))
    return ranking.rank_hits(ranking.best_hits(drain(best, folder, "update")), k)


def judge_stream(records: DataFrame, judge: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Judge each record once across restarts: a batch skips what earlier batches have judged.

    The ids judged so far lie in hash buckets beside the results; a batch reads those of its own ids.
    """
    out, kind = f"{folder}/out", records.schema["sample_id"].dataType.simpleString()
    judged = Buckets(records.sparkSession, f"{folder}/judged", f"sample_id {kind}", ["sample_id"])

    def each(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(["sample_id"])
        if batch_id:
            known = judged.appended(judged.touched(fresh), batch_id - 1)
            fresh = fresh.join(known.withColumnRenamed("sample_id", "known"), F.col("sample_id").eqNullSafe(F.col("known")), "left_anti")
        judge(fresh).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        judged.write(fresh.select("sample_id"), batch_id)

    return drain(records, folder, each=each)


def upsert_stream(updates: DataFrame, current: DataFrame, folder: str) -> DataFrame:
    """``versioned_upsert`` per micro-batch. Each batch writes a new state folder; the last one is the table.

    A row kept in the last batch may have been written by an earlier one; ``outcome`` tells what the last batch did to it.
    """
    out = f"{folder}/out"
    spark = updates.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            state = current
        else:
            state = spark.read.parquet(f"{out}/batch={batch_id - 1}").where(F.col("version").isNotNull())
        result = versioned_upsert(state.select("user_id", "conv_id", "title", "version"), batch)
        result.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drain(updates, folder, each=each)
    every = spark.read.parquet(out)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == last).drop("batch")


def update_stream(updates: DataFrame, current: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """``apply_updates`` per micro-batch, any number of updates a key: the outcome of every update, and the state behind the last batch.

    The state lies in hash buckets; a batch reads and rewrites those of its keys. Updates of a key must arrive in the order of ``seq`` from
    batch to batch.
    """
    out, spark = f"{folder}/out", updates.sparkSession
    state = Buckets(spark, f"{folder}/state", "user_id long, conv_id long, title string, version long", KEYS)
    if not state.exists():
        state.write(current.select(*KEYS, "title", F.col("version").cast("long").alias("version")), -1, list(range(BUCKETS)))

    def each(batch: DataFrame, batch_id: int) -> None:
        ids = state.touched(batch)
        old = state.latest(ids, batch_id)
        apply_updates(old, batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        state.write(state_after(old, spark.read.parquet(f"{out}/batch={batch_id}")), batch_id, ids)

    applied = drain(updates, folder, each=each).drop("batch")
    return applied, state.latest(list(range(BUCKETS)), 2**31 - 1)
