"""Linter reports in JSON to findings, each with its evidence row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revgrain.functions import review

_PLACE = "struct<row:int>"
RUFF_SCHEMA = f"array<struct<filename:string,code:string,message:string,location:{_PLACE},end_location:{_PLACE}>>"
BANDIT_SCHEMA = (
    "struct<results:array<struct<filename:string,test_id:string,issue_severity:string,issue_text:string,line_number:int>>>"
)


def _finished(rows: DataFrame, tool: str, link: str) -> DataFrame:
    snippet = F.concat("rule_id", F.lit(": "), "message")
    return rows.select(
        "run_id", F.lit(tool).alias("tool"), "rule_id", "message", "severity", "file", "start_line", "end_line",
        snippet.alias("snippet"), F.format_string(link, F.lower("rule_id")).alias("reference"), F.lit(1.0).alias("confidence"),
        F.concat(F.lit("ev_"), F.substring(F.md5(F.concat_ws("|", "run_id", F.lit(tool), "pos", "file", "rule_id", "message")), 1, 16)).alias("evidence_id"),
    )


def read_ruff_reports(reports: DataFrame, column: str = "ruff") -> DataFrame:
    """(run_id, JSON array) to one row per item. An unreadable report gives no rows; see ``unreadable_reports``."""
    items = reports.select("run_id", F.posexplode(F.from_json(column, RUFF_SCHEMA)).alias("pos", "i"))
    return _finished(items.select(
        "run_id", "pos", F.coalesce("i.code", F.lit("")).alias("rule_id"), F.coalesce("i.message", F.lit("")).alias("message"),
        F.lit("info").alias("severity"), F.coalesce("i.filename", F.lit("")).alias("file"),
        F.coalesce("i.location.row", F.lit(0)).alias("start_line"), F.coalesce("i.end_location.row", F.lit(0)).alias("end_line"),
    ), "ruff", "https://docs.astral.sh/ruff/rules/%s/")


def read_bandit_reports(reports: DataFrame, column: str = "bandit") -> DataFrame:
    items = reports.select("run_id", F.posexplode(F.from_json(column, BANDIT_SCHEMA)["results"]).alias("pos", "i"))
    return _finished(items.select(
        "run_id", "pos", review.bandit_rule("i.test_id").alias("rule_id"), F.coalesce("i.issue_text", F.lit("")).alias("message"),
        review.bandit_severity("i.issue_severity").alias("severity"), F.coalesce("i.filename", F.lit("")).alias("file"),
        F.coalesce("i.line_number", F.lit(0)).alias("start_line"), F.lit(0).alias("end_line"),
    ), "bandit", "https://bandit.readthedocs.io/en/latest/plugins/%s.html")


def unreadable_reports(reports: DataFrame, column: str) -> DataFrame:
    """Non-empty reports that do not parse, as diagnostics."""
    bad = (F.trim(column) != "") & F.try_parse_json(column).isNull()
    return reports.where(bad).select("run_id", F.lit("REPORT_UNREADABLE").alias("code"), F.substring(column, 1, 200).alias("message"))
