"""Running a stream over what is there now, with results that survive a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, one file or a folder of files, as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # A plain path must be a folder to a stream; a glob may name either.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{table}}}.parquet")


def drain(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Process all available input and return what was written.

    Every micro-batch overwrites its own folder, so a batch that is repeated after a failure leaves no second copy.
    """
    out = f"{folder}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(each or write)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(out + "/batch=*") if each is None else spark.read.parquet(out + "/*")


def latest_per_key(updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last state of each key among the updates a stream wrote."""
    others = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*others), version).alias("_s")).select(*keys, "_s.*")
