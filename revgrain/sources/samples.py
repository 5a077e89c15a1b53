"""Evaluation samples and results: loading, resuming, freezing, enriching, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revgrain.functions.patterns import strings
from revgrain.operators import aggs

SAMPLE_SCHEMA = (
    "id string, mode string, scenario string, question string, project string, follow_up_group string, follow_up_order int, "
    "input struct<change_summary:string,file_types:array<string>,diff_size:struct<files:int,added_lines:int,deleted_lines:int>,"
    "risk_signals:array<string>,ast_summary:string,static_findings_count:int>, "
    "ground_truth struct<analyzers:array<string>,risk_level:string,reason_codes:array<string>,question_type:string,"
    "expected_keywords:array<string>,expected_tools:array<string>>"
)


def load_samples(spark: SparkSession, paths: dict[str, str], mode: str = "review", version: str = "latest") -> DataFrame:
    """Samples of a mode from JSON lines. ``paths`` maps a version to its folder.

    An unknown version falls back to v1, and v1 has no agent samples. Review samples are those whose mode is not
    investigation.
    """
    chosen = paths.get(version, paths["v1"])
    rows = spark.read.schema(SAMPLE_SCHEMA).json(chosen)
    if mode == "all":
        return rows
    agent = F.coalesce("mode", F.lit("")) == "investigation"
    if mode == "agent" and chosen == paths["v1"]:
        return rows.limit(0)
    return rows.where(agent if mode == "agent" else ~agent)


def external_samples(samples: DataFrame, project: str | None = None) -> DataFrame:
    """Samples of a project with their answer keywords: given ones, else target symbols that the summary names."""
    rows = samples.where(F.col("project") == project) if project else samples
    given = [F.when(F.size(c) > 0, F.col(c)) for c in ("expected_answer_keywords", "expected_keywords")]
    summary = F.lower(F.coalesce("expected_answer_summary", F.lit("")))
    named = F.filter(F.coalesce("target_symbols", strings([])), lambda s: F.contains(summary, F.lower(s)))
    return rows.withColumn("answer_keywords", F.coalesce(*given, named))


def pending(samples: DataFrame, done: DataFrame) -> DataFrame:
    """Samples still to run: single ones without a result, and all members of a group unless every member has one."""
    marked = samples.join(done.select("sample_id").distinct().withColumn("_done", F.lit(True)), "sample_id", "left")
    marked = marked.withColumn("_done", F.coalesce("_done", F.lit(False)))
    grouped = F.coalesce("follow_up_group", F.lit("")) != ""
    open_groups = marked.where(grouped & ~F.col("_done")).select("follow_up_group").distinct()
    singles = marked.where(~grouped & ~F.col("_done"))
    members = marked.where(grouped).join(open_groups, "follow_up_group", "left_semi")
    return singles.unionByName(members).drop("_done")


def frozen_rows(records: DataFrame, samples: DataFrame, baseline_id: str) -> DataFrame:
    """Records in the shape of a frozen baseline. samples: sample_id, repo_url, commit_sha, project."""
    if not baseline_id.startswith("external_glm_v"):
        raise ValueError("baseline_id must look like external_glm_vN")
    gone = F.lower("answer").contains("llm 不可用")
    joined = records.join(samples, "sample_id")
    return joined.select(
        F.lit(baseline_id).alias("baseline_id"), "sample_id",
        F.struct(F.col("repo_url").alias("url"), "commit_sha", "project").alias("repository"), "question", "question_type",
        F.when(~gone, F.col("answer")).alias("raw_llm_response"), F.col("answer").alias("final_answer"),
        F.when(gone, "llm_unavailable_or_request_failed").alias("fallback_reason"),
        F.coalesce("step_count", F.lit(0)).alias("steps_used"), "labels", F.lit(False).alias("ground_truth_ambiguous"),
    )


def freeze_baseline(records: DataFrame, samples: DataFrame, baseline_id: str, folder: str) -> str:
    """Write a baseline once; an existing one is never overwritten."""
    target = f"{folder}/{baseline_id}"
    frozen_rows(records, samples, baseline_id).write.mode("errorifexists").partitionBy("baseline_id").parquet(target)
    return target


def enrich_baseline(frozen: DataFrame, truth: DataFrame) -> DataFrame:
    """Frozen records with the expected summary and keywords of their sample, and whether one was found."""
    extra = truth.select(
        "sample_id", F.coalesce("expected_answer_summary", F.lit("")).alias("expected_answer_summary"),
        F.coalesce("expected_answer_keywords", strings([])).alias("expected_answer_keywords"), F.lit(True).alias("_found"),
    )
    return frozen.join(extra, "sample_id", "left").withColumn("enriched", F.coalesce("_found", F.lit(False))).drop("_found")


def write_dataset(samples: DataFrame, folder: str, version: str = "v2") -> DataFrame:
    """Write samples as JSON lines with a manifest of counts beside them; returns the manifest rows."""
    samples.write.mode("overwrite").json(f"{folder}/eval_dataset_{version}")
    stored = samples.sparkSession.read.schema(samples.schema).json(f"{folder}/eval_dataset_{version}")
    dims = {"mode": F.col("mode"), "risk_level": F.col("ground_truth.risk_level"), "question_type": F.col("ground_truth.question_type")}
    manifest = aggs.coverage_report(stored, dims).withColumn("dataset_version", F.lit(version))
    manifest.write.mode("overwrite").json(f"{folder}/eval_dataset_{version}_meta")
    return manifest


def step_count(steps: Column | str) -> Column:
    """Steps that reached a tool."""
    steps = F.col(steps) if isinstance(steps, str) else steps
    return F.coalesce(F.size(F.filter(steps, lambda s: s["tool"] != "(blocked)")), F.lit(0))


def error_records(samples: DataFrame, message: str = "error") -> DataFrame:
    """Zero-filled records for samples whose run failed. samples: sample_id, question, question_type, follow_up_group, error."""
    e = F.col(message)
    return samples.select(
        "sample_id", "question", F.coalesce("question_type", F.lit("")).alias("question_type"), F.lit(False).alias("is_follow_up"),
        "follow_up_group", F.concat(F.lit("(执行错误: "), e, F.lit(")")).alias("answer"), F.lit(0).alias("step_count"),
        F.array(F.concat(F.lit("error: "), e)).alias("trace"), F.lit(0.0).alias("duration_ms"), F.lit(False).alias("budget_exhausted"),
    )
