"""Reports as ordered lines, and metric tables.

A report is a set of rows (run_id, section, item, part, line): sorted by these they read as one document. Lines stay
rows because a run may have any number of issues; ``write_reports`` sorts and writes them without collecting a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revgrain.functions import review

COLUMNS = ["run_id", "section", "item", "part", "line"]


def _line(df: DataFrame, section: int, item: Column, part: Column, line: Column) -> DataFrame:
    return df.select(
        "run_id", F.lit(section).alias("section"), item.cast("string").alias("item"), part.cast("bigint").alias("part"), line.alias("line")
    )


def report_lines(runs: DataFrame, changes: DataFrame, trace: DataFrame, issues: DataFrame, evidence: DataFrame) -> DataFrame:
    """Markdown report of each run.

    runs: run_id, base, head, duration_ms, risk_level, analyzers, reason_codes. changes: run_id, path, change_type,
    added, deleted. trace: run_id, seq, step, status, duration_ms. issues: run_id, issue_id, severity, title, file, line,
    source, reason. evidence: run_id, issue_id, ev_id, snippet.
    """
    none, zero, one = F.lit(""), F.lit(0), F.lit(1)
    rank = (9 - review.severity_rank("severity")).cast("string")
    key = F.concat(rank, F.lit("|"), "issue_id")
    head = F.concat(
        F.lit("# Code Review Report\n\n**Base:** `"), "base", F.lit("` → **Head:** `"), "head", F.lit("`\n**Duration:** "),
        F.format_string("%.1fs", F.bround(F.col("duration_ms") / 1000, 1)), F.lit("\n**Risk Level:** "), "risk_level",
    )
    counted = runs.select("run_id").join(changes.groupBy("run_id").agg(F.count("*").alias("n")), "run_id", "left")
    counted = counted.join(issues.groupBy("run_id").agg(F.count("*").alias("m")), "run_id", "left").na.fill(0)
    files = F.concat(F.lit("| | "), "change_type", F.lit(" | `"), "path", F.lit("` | "), F.col("added").cast("string"), F.lit(" | "), F.col("deleted").cast("string"), F.lit(" |"))
    step = F.concat(F.lit("| "), "step", F.lit(" | "), review.status_label("status"), F.lit(" | "), review.latency_label("duration_ms"), F.lit(" |"))
    issue = F.concat(
        F.lit("### ["), F.upper("severity"), F.lit("] "), "title", F.lit("\n\n- **File:** `"), "file", F.lit(":"), F.col("line").cast("string"),
        F.lit("`\n- **Source:** "), "source", F.lit("\n- **Reason:** "), "reason",
    )
    plan = F.concat(
        F.lit("## 4. Plan Details\n\n- **Analyzers:** "), F.array_join("analyzers", ", "), F.lit("\n- **Reason Codes:** "),
        F.when(F.size("reason_codes") > 0, F.array_join("reason_codes", ", ")).otherwise("none"), F.lit("\n- **Risk Level:** "), "risk_level",
    )
    reasons = runs.select("run_id", F.posexplode("reason_codes").alias("pos", "code"))
    ranked = issues.select("run_id", "issue_id", key.alias("_key"))
    proofs = evidence.join(ranked, ["run_id", "issue_id"])
    out = [
        _line(runs, 0, none, zero, head),
        _line(counted, 1, none, zero, F.lit("## 1. Change Summary\n\n| # | Type | File | +Added | -Deleted |\n|---|---|---|---|---|")),
        _line(changes, 1, F.col("path"), one, files),
        _line(counted.where("n = 0"), 1, none, one, F.lit("| | | (no changes) | 0 | 0 |")),
        _line(counted, 2, none, F.lit(-1), F.concat(F.lit("\n**Total:** "), F.col("n").cast("string"), F.lit(" files changed.\n"))),
        _line(counted, 2, none, zero, F.lit("## 2. Execution Trace\n\n| Step | Status | Duration |\n|---|---|---|")),
        _line(trace, 2, F.lit("a"), F.col("seq"), step),
        _line(reasons, 2, F.lit("b"), F.col("pos"), F.concat(F.lit("| _"), "code", F.lit("_ | — | — |"))),
        _line(counted, 3, none, zero, F.concat(F.lit("## 3. Issues ("), F.col("m").cast("string"), F.lit(")\n"))),
        _line(counted.where("m = 0"), 3, none, one, F.lit("No issues found.\n")),
        _line(issues, 3, key, zero, issue),
        _line(proofs, 3, F.concat("_key", F.lit("|"), "ev_id"), one, F.concat(F.lit("- `"), "ev_id", F.lit("`: "), "snippet")),
        _line(runs, 4, none, zero, plan),
    ]
    lines = out[0]
    for part in out[1:]:
        lines = lines.unionByName(part)
    return lines


def write_reports(lines: DataFrame, path: str) -> None:
    """Text of all reports in order: range-partitioned by run and place, so even one huge run spreads over tasks."""
    ordered = lines.repartitionByRange(*COLUMNS[:4]).sortWithinPartitions(*COLUMNS[:4])
    ordered.select("run_id", "line").write.mode("overwrite").partitionBy("run_id").text(path)


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.bround(c * 100, digits))


def metric_table(metrics: DataFrame, labels: dict[str, str], as_percent: list[str], digits: int = 1) -> DataFrame:
    """One-row metric frame to Markdown table lines: (line_no, line)."""
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("line_no"),
            F.concat(F.lit(f"| {label} | "), percent(F.col(c), digits) if c in as_percent else F.col(c).cast("string"), F.lit(" |")).alias("line"))
        for i, (c, label) in enumerate(labels.items())
    ])
    return metrics.select(F.inline(rows))


def grouped_table(metrics: DataFrame, key: str, columns: list[str], as_percent: list[str], digits: int = 2) -> DataFrame:
    """Grouped metrics to Markdown table lines: (key, line)."""
    cells = [percent(F.col(c), digits) if c in as_percent else F.col(c).cast("string") for c in columns]
    return metrics.select(F.col(key), F.concat(F.lit("| "), F.concat_ws(" | ", F.col(key), *cells), F.lit(" |")).alias("line"))


def comparison_lines(compared: DataFrame, first: str = "LLM", second: str = "baseline") -> DataFrame:
    """Per sample: both F1 values and the better side."""
    better = F.when(F.col("winner") == "a", first + "+").when(F.col("winner") == "b", second + "+").otherwise("=")
    return compared.select("sample_id", F.format_string(f"{first}=%.4f  {second}=%.4f  %s", "f1_a", "f1_b", better).alias("line"))
