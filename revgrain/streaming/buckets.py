"""Tables that a stream keeps in hash buckets below one folder, ``batch=n/bucket=k``: a batch reads and writes the buckets it touches alone.

A batch that is repeated after a failure overwrites its own folder and reads earlier ones only, so it gives the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64


class Buckets:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows, ``BUCKETS`` numbers at most."""
        return [r[0] for r in rows.select(self._bucket()).distinct().collect()]

    def write(self, rows: DataFrame, batch: int, ids: list[int] | None = None) -> None:
        """Rows as those of batch ``batch``. ``ids``: all buckets they replace, those left without rows among them."""
        rows = rows.withColumn("there", F.lit(True)).withColumn("bucket", self._bucket())
        if ids is not None:
            marks = self.spark.createDataFrame([(k,) for k in ids], "bucket int").withColumn("there", F.lit(False))
            rows = rows.unionByName(marks, allowMissingColumns=True)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")

    def exists(self) -> bool:
        try:
            return bool(self.spark.read.parquet(self.path).columns)
        except AnalysisException:
            return False

    def _all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, there boolean, batch int, bucket int").parquet(self.path)

    def appended(self, ids: list[int], upto: int) -> DataFrame:
        """Rows of these buckets from all batches up to ``upto``."""
        return self._all().where(F.col("bucket").isin(ids) & (F.col("batch") <= upto)).drop("there", "batch", "bucket")

    def latest(self, ids: list[int], before: int) -> DataFrame:
        """Rows of these buckets as the last batch before ``before`` that touched each has left them."""
        rows = self._all().where(F.col("bucket").isin(ids) & (F.col("batch") < before))
        last = rows.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # BUCKETS rows at most
        wanted = reduce(lambda a, b: a | b, [(F.col("bucket") == r.bucket) & (F.col("batch") == r.batch) for r in last], F.lit(False))
        return rows.where(wanted & F.col("there")).drop("there", "batch", "bucket")
