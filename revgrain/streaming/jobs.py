"""Job event streams: latest status, number of active jobs, event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revgrain.operators import ordering
from revgrain.streaming.buckets import Buckets
from revgrain.streaming.runner import drain, latest_per_key

MAX_ACTIVE = 50
ACTIVE = ["queued", "running"]


def _status(event):
    return (
        F.when(event == "queued", "queued").when(event == "result", "completed").when(event == "error", "failed")
        .when(event != "end", "running")
    )


def job_status(events: DataFrame) -> DataFrame:
    """Status, result and error of each job by its latest events. ``end`` closes the list and changes no status.

    The same frame on a stream keeps one small state row per job; with no event time in the source there is no
    watermark, so a job's row stays until the stream ends.
    """
    status = _status(F.col("event"))
    at = F.when(status.isNotNull(), F.col("seq"))

    def last(event: str):
        return F.max_by(F.when(F.col("event") == event, F.col("data")), F.when(F.col("event") == event, F.col("seq")))

    return events.groupBy("job_id").agg(
        F.max_by(status, at).alias("status"), last("result").alias("result"), last("error").alias("error"),
        F.bool_or(F.col("event") == "end").alias("ended"), F.max("seq").alias("last_seq"), F.count("*").alias("events"),
    )


def job_status_stream(events: DataFrame, folder: str) -> DataFrame:
    """``job_status`` as a stream in update mode, drained into the current state of every job."""
    return latest_per_key(drain(job_status(events), folder, "update"), ["job_id"], "events")


def active_jobs(events: DataFrame) -> DataFrame:
    """Number of queued or running jobs after each event, and whether it reaches the limit.

    events: job_id, clock, seq, event; (clock, seq) is the order. A job counts from the event that makes it active to
    the one that ends it; progress events leave it as it is.
    """
    rows = events.withColumn("active", F.col("event").isin(ACTIVE + ["plan", "phase"]).cast("int"))
    rows = ordering.previous_value(rows, ["job_id"], ["clock", "seq"], "active", "was")
    rows = rows.withColumn("delta", F.col("active") - F.coalesce("was", F.lit(0)))
    total = ordering.running_sum(rows, ["clock", "seq"], "delta", "active_jobs")
    return total.select("job_id", "seq", "event", "active_jobs", (F.col("active_jobs") >= MAX_ACTIVE).alias("at_limit"))


def active_job_count(statuses: DataFrame) -> DataFrame:
    """Active jobs in a status table, as a stream keeps it."""
    return statuses.agg(F.count_if(F.col("status").isin(ACTIVE)).alias("active_jobs")).withColumn("at_limit", F.col("active_jobs") >= MAX_ACTIVE)


def job_event_log(events: DataFrame) -> DataFrame:
    """Events of each job up to and including its first ``end``; jobs that have not ended are left out.

    Rows in the order of ``seq``: a job's log is read sorted, never gathered into one value.
    """
    ends = events.where("event = 'end'").groupBy("job_id").agg(F.min("seq").alias("end_seq"))
    return events.join(ends, "job_id").where("seq <= end_seq").drop("end_seq")


LOG_SCHEMA = "job_id string, seq bigint, event string, data double"


def job_event_log_stream(events: DataFrame, folder: str) -> DataFrame:
    """``job_event_log`` as the events arrive: a job's log is given out whole in the batch that holds its first ``end``.

    Events of open jobs wait in hash buckets below ``folder``, appended batch by batch; a batch with an ``end`` reads the buckets of the jobs it
    closes. Nothing of a job is gathered in a task's memory. Events of a job that come in later batches are dropped, as they stand behind its end; they
    must arrive in the order of ``seq`` from batch to batch, within a batch in any order.
    """
    spark, out = events.sparkSession, f"{folder}/out"
    held = Buckets(spark, f"{folder}/held", LOG_SCHEMA, ["job_id"])
    ended = Buckets(spark, f"{folder}/ended", "job_id string, end_seq bigint", ["job_id"])

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select("job_id", "seq", "event", "data")
        if batch_id:
            batch = batch.join(ended.appended(held.touched(batch), batch_id - 1), "job_id", "left_anti")
        held.write(batch, batch_id)
        mine = spark.read.schema(f"{LOG_SCHEMA}, there boolean, bucket int").parquet(f"{held.path}/batch={batch_id}")
        ended.write(mine.where("event = 'end'").groupBy("job_id").agg(F.min("seq").alias("end_seq")), batch_id)
        closed = spark.read.schema("job_id string, end_seq bigint, there boolean, bucket int").parquet(f"{ended.path}/batch={batch_id}").select("job_id", "end_seq")
        log = held.appended(ended.touched(closed), batch_id).join(closed, "job_id").where("seq <= end_seq").drop("end_seq")
        log.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return drain(events, folder, each=each).select("job_id", "seq", "event", "data")
