"""Stored review runs: writing, point lookup and listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 64
SUMMARY = ["run_id", "repo_url", "base_ref", "head_ref", "created_at", "risk_level", "issue_count", "duration_ms"]
RUN_SCHEMA = (
    "run_id string, repo_url string, base_ref string, head_ref string, created_at string, plan struct<risk_level:string>, "
    "issues array<string>, duration_ms double"
)


def _bucket(run_id):
    return F.pmod(F.xxhash64(run_id), F.lit(BUCKETS)).cast("int")


def write_runs(rows: DataFrame, path: str) -> None:
    """Rows with a run_id, in a fixed number of folders by hash: a lookup reads one folder, and no folder per run arises.

    Rows are spread by run and place, not by folder, so a run that holds most of the rows is written by many tasks.
    """
    rows = rows.withColumn("bucket", _bucket(F.col("run_id")))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The rows of one run; none if it does not exist. Prunes to one folder, then to matching row groups."""
    bucket = spark.range(1).select(_bucket(F.lit(run_id)).alias("b")).first()["b"]
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("run_id") == run_id)).drop("bucket")


def write_run_documents(runs: DataFrame, path: str) -> None:
    """One JSON document per run and line. runs: the columns of ``RUN_SCHEMA``."""
    runs.write.mode("overwrite").json(path)


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """Summary of every readable run document; unreadable ones are skipped and a missing risk level is 'unknown'.

    The caller orders the listing by run id, newest name first.
    """
    docs = (
        spark.read.schema(RUN_SCHEMA + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
        .option("recursiveFileLookup", "true").json(path)
    )
    good = docs.where(F.col("_bad").isNull() & F.col("run_id").isNotNull())
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("repo_url", "base_ref", "head_ref", "created_at")]
    return good.select(
        "run_id", *text, F.coalesce("plan.risk_level", F.lit("unknown")).alias("risk_level"),
        F.coalesce(F.size("issues"), F.lit(0)).alias("issue_count"), F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"),
    )


def run_documents(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """JSON records of each run: one head record with its counts, then one record per issue.

    Records instead of one nested text per run: a run may hold any number of issues.
    """
    counts = issues.groupBy("run_id").agg(F.count("*").alias("issue_count"))
    head = runs.join(counts, "run_id", "left").withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))
    columns = [c for c in head.columns if c != "run_id"]
    head = head.select("run_id", F.lit("run").alias("record"), F.to_json(F.struct("run_id", *columns)).alias("document"))
    fields = [c for c in issues.columns if c != "run_id"]
    body = issues.select("run_id", F.lit("issue").alias("record"), F.to_json(F.struct("run_id", *fields)).alias("document"))
    return head.unionByName(body)
