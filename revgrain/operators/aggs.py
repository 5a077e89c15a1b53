"""Aggregations: findings to issues, plans, and evaluation metrics.

Rates are exact quotients; rounding belongs to the reports. The one exception is the issue F1, which is defined on
rounded precision and recall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revgrain import fixed
from revgrain.functions import paths, review
from revgrain.functions.patterns import UNICODE, contains_any, strings

ISSUE_KEYS = ["run_id", "file", "rule_id", "line"]


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(empty))


def _keyed(findings: DataFrame) -> DataFrame:
    """Findings without a place share the key ('', rule, 0)."""
    return findings.withColumn("file", F.coalesce("file", F.lit(""))).withColumn(
        "line", F.coalesce(F.col("start_line"), F.lit(0))
    )


def aggregate_findings(findings: DataFrame) -> DataFrame:
    """One issue per (file, rule, line) of a run; ``seq`` is the order in which findings came.

    Equal messages collapse before the shuffle, so a place that is reported again and again stays one small group.
    """
    per_message = _keyed(findings).groupBy(*ISSUE_KEYS, "message").agg(
        F.min(F.struct("seq", "tool")).alias("first"),
        F.max(review.severity_rank("severity", 0)).alias("rank"), F.count("*").alias("n"),
    )
    groups = per_message.groupBy(*ISSUE_KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first.seq", "message"))), lambda x: x["message"]).alias("messages"),
        F.min("first")["tool"].alias("tool"), F.max("rank").alias("rank"), F.sum("n").alias("finding_count"),
    )
    title = F.concat(F.lit("["), "rule_id", F.lit("] "), F.substring(F.get("messages", 0), 1, 80))
    return groups.select(
        *ISSUE_KEYS, F.lit("static").alias("type"), review.severity_name(F.col("rank")).alias("severity"), "rank",
        title.alias("title"), F.array_join("messages", "; ").alias("reason"), F.array("tool").alias("source"), "finding_count",
    )


def issue_evidence(findings: DataFrame) -> DataFrame:
    """The evidence ids of each issue, one row per link, in the order they first came."""
    links = _keyed(findings)
    return links.groupBy(*ISSUE_KEYS, "evidence_id").agg(F.min("seq").alias("seq"))


def rank_issues(issues: DataFrame) -> DataFrame:
    return issues.orderBy(F.desc(review.severity_rank("severity")), "file", "rule_id", "line")


def union_findings(static: DataFrame, semantic: DataFrame) -> DataFrame:
    return static.unionByName(semantic, allowMissingColumns=True)


def change_totals(changes: DataFrame) -> DataFrame:
    """Lines added and deleted and number of changed Python files per change set."""
    py = review.is_changed_python("path", "change_type")
    return changes.groupBy("run_id").agg(
        F.sum(F.when(py, F.col("added")).otherwise(0)).alias("added"),
        F.sum(F.when(py, F.col("deleted")).otherwise(0)).alias("deleted"),
        F.count_if(py).alias("python_files"),
    )


def build_plans(changes: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Analyzers, reason codes and risk level of each change set.

    With ``contents`` (run_id, path, text) signals come from the changed Python files' texts; without, from the paths
    of all files. One aggregation of small flags per change set; texts never leave the task that reads them.
    """
    py = review.is_changed_python("path", "change_type")
    lines = F.sum(F.when(py, F.col("added") + F.col("deleted")).otherwise(0))
    rows = changes
    if contents is not None:
        flags = contents.select("run_id", "path", review.content_signals("path", "text").alias("found"))
        rows = rows.join(flags, ["run_id", "path"], "left")
        found = F.coalesce("found", review.content_signals("path", F.lit("")))
        tests = {s: py & F.array_contains(found, s) for s in fixed.RISK_KEYWORDS}
    else:
        low = F.lower("path")
        tests = {s: contains_any(low, words) for s, words in fixed.RISK_KEYWORDS.items()}
    has = {s: F.bool_or(F.coalesce(test, F.lit(False))).alias(f"_{s}") for s, test in tests.items()}
    manifest = paths.base_name("path").isin(fixed.PLAN_MANIFESTS)
    per = rows.groupBy("run_id").agg(
        F.count_if(py).alias("py"), lines.alias("lines"), F.bool_or(manifest).alias("manifest"),
        F.count("*").alias("files"), *has.values(),
    )
    names = sorted(list(fixed.RISK_KEYWORDS) + ["large_diff"])
    large = (F.col("lines") > 500) if contents is None else F.lit(False)
    found = F.array_compact(F.array(*[F.when(large if n == "large_diff" else F.col(f"_{n}"), F.lit(n)) for n in names]))
    per = per.withColumn("signals", F.when(F.col("py") > 0, found).otherwise(strings([])))
    any_py, risky = F.col("py") > 0, F.size("signals") > 0
    few = F.col("py") <= 50
    deps = any_py & F.col("manifest")
    analyzers = F.array_compact(F.array(
        F.lit("git"), F.when(any_py & few, F.lit("python_ast")), F.when(any_py, F.lit("ruff")),
        F.when(any_py & (risky | (F.col("lines") > 100)), F.lit("bandit")), F.when(deps, F.lit("dependency")),
    ))
    skipped = F.array_compact(F.array(F.when(any_py & ~few, F.lit("python_ast_skipped_large_diff"))))
    calm = F.array_compact(F.array(F.when(any_py & ~risky & (F.col("lines") <= 100), F.lit("bandit_skipped_low_risk"))))
    tail = F.array_compact(F.array(F.when(deps, F.lit("dependency_change")), F.when(~any_py, F.lit("no_python_changes"))))
    return per.select(
        "run_id", analyzers.alias("analyzers"), F.concat(skipped, "signals", calm, tail).alias("reason_codes"),
        review.risk_level(F.size("signals")).alias("risk_level"),
    )


# --- plan evaluation -----------------------------------------------------------------------


def _set_scores(predicted: Column, truth: Column) -> tuple[Column, Column, Column]:
    predicted, truth = F.array_distinct(predicted), F.array_distinct(truth)
    common = F.size(F.array_intersect(predicted, truth)).cast("double")
    p = F.when(F.size(predicted) > 0, common / F.size(predicted)).otherwise(0.0)
    r = F.when(F.size(truth) > 0, common / F.size(truth)).otherwise(1.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return p, r, f1


def plan_scores(pairs: DataFrame) -> DataFrame:
    """Per sample: precision, recall and F1 of the analyzers and of the reason codes, risk hit, high-risk hit."""
    ap, ar, af = _set_scores(F.col("analyzers"), F.col("true_analyzers"))
    rp, rr, rf = _set_scores(F.col("reason_codes"), F.col("true_reason_codes"))
    high = F.arrays_overlap("true_reason_codes", strings(fixed.HIGH_RISK_REASONS)) | (F.col("true_risk_level") == "high")
    return pairs.select(
        "sample_id", ap.alias("analyzer_precision"), ar.alias("analyzer_recall"), af.alias("analyzer_f1"),
        rp.alias("reason_precision"), rr.alias("reason_recall"), rf.alias("reason_f1"),
        (F.col("risk_level") == F.col("true_risk_level")).alias("risk_ok"), F.coalesce(high, F.lit(False)).alias("high_risk"),
        F.array_contains("analyzers", "bandit").alias("has_bandit"),
    )


def planner_metrics(scores: DataFrame) -> DataFrame:
    names = ["analyzer_precision", "analyzer_recall", "analyzer_f1", "reason_precision", "reason_recall", "reason_f1"]
    hits, total = F.count_if(F.col("high_risk") & F.col("has_bandit")), F.count_if("high_risk")
    return scores.agg(
        F.count("*").alias("total_samples"), *[F.avg(n).alias(n) for n in names],
        F.avg(F.col("risk_ok").cast("int")).alias("risk_level_accuracy"), ratio(hits, total, 1.0).alias("high_risk_recall"),
    )


def keyword_micro_metrics(pairs: DataFrame) -> DataFrame:
    """Keyword counts summed over all samples, then precision, recall, F1; and accuracy of the question type."""
    sets = pairs.select(
        F.size(F.array_intersect("keywords", "expected_keywords")).alias("tp"),
        F.size(F.array_except("keywords", "expected_keywords")).alias("fp"),
        F.size(F.array_except("expected_keywords", "keywords")).alias("fn"),
        ((F.coalesce("expected_type", F.lit("")) == "") | (F.col("question_type") == F.col("expected_type"))).alias("type_ok"),
    )
    sums = sets.agg(
        F.count("*").alias("total"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.count_if("type_ok").alias("type_ok"),
    )
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    return sums.select(
        "total", ratio(F.col("type_ok"), F.col("total")).alias("question_type_accuracy"), p.alias("keyword_precision"),
        r.alias("keyword_recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("keyword_f1"),
    )


def planner_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per sample: both analyzer F1 values and the better side. a and b: sample_id, analyzer_f1."""
    joined = a.select("sample_id", F.col("analyzer_f1").alias("f1_a")).join(
        b.select("sample_id", F.col("analyzer_f1").alias("f1_b")), "sample_id"
    )
    winner = F.when(F.col("f1_a") > F.col("f1_b"), "a").when(F.col("f1_b") > F.col("f1_a"), "b").otherwise("tie")
    return joined.withColumn("winner", winner)


def planner_compare_summary(compared: DataFrame, calls: DataFrame) -> DataFrame:
    """Mean F1 of both sides, their difference, wins, and mean latency and errors of the model calls."""
    f = compared.agg(
        F.count("*").alias("samples"), F.avg("f1_a").alias("mean_a"), F.avg("f1_b").alias("mean_b"),
        F.count_if(F.col("winner") == "a").alias("wins_a"), F.count_if(F.col("winner") == "b").alias("wins_b"),
    ).withColumn("delta", F.col("mean_a") - F.col("mean_b"))
    return f.withColumn("mean_latency_ms", calls.agg(F.avg("latency_ms")).scalar()).withColumn(
        "errors", calls.agg(F.count("error")).scalar()
    )


# --- answer evaluation -----------------------------------------------------------------------


def completion(answer: Column, expected_keywords: Column, file_hit: Column) -> Column:
    """All expected keywords occur in the answer and an expected file was found; no keywords is no completion."""
    low = paths.norm_path(F.lower(F.coalesce(answer, F.lit(""))))
    all_in = F.forall(expected_keywords, lambda k: F.contains(low, F.lower(k)))
    return F.coalesce((F.size(expected_keywords) > 0) & all_in, F.lit(False)) & file_hit


def rates(flags: DataFrame, names: list[str]) -> DataFrame:
    """Share of true flags per column, in one pass."""
    return flags.agg(F.count("*").alias("total"), *[F.avg(F.coalesce(F.col(n), F.lit(False)).cast("int")).alias(f"{n}_rate") for n in names])


def avg_steps_by_type(records: DataFrame) -> DataFrame:
    """Mean steps of first investigations by question type, and over all (null type)."""
    first = records.where(~F.coalesce("is_follow_up", F.lit(False))).withColumn("question_type", F.coalesce("question_type", F.lit("unknown")))
    return first.rollup("question_type").agg(F.avg("step_count").alias("avg_steps"), F.count("*").alias("records")).withColumn(
        "question_type", F.coalesce("question_type", F.lit("(all)"))
    )


def budget_flags(records: DataFrame) -> DataFrame:
    """Whether and on what budget a record ran out: first from its steps, then its final state, then its trace."""
    stops = F.create_map(*[F.lit(x) for pair in fixed.BUDGET_STOPS.items() for x in pair])

    def known(reason: Column) -> Column:
        return F.when(reason.isin(fixed.BUDGET_TYPES), reason)

    def stop_type(decision: Column, reason: Column) -> Column:
        given = F.when(F.coalesce(reason, F.lit("")) != "", reason)
        return known(F.coalesce(given, F.try_element_at(stops, decision)))

    ends = ["BUDGET", *fixed.BUDGET_STOPS]
    hit = F.get(F.filter("steps", lambda s: F.coalesce(s["decision"].isin(ends), F.lit(False)) | (F.coalesce(s["status"], F.lit("")) == "budget_exhausted")), 0)
    by_step = F.when(hit["decision"].isin(ends), stop_type(hit["decision"], hit["budget_reason"])).otherwise(
        F.coalesce(F.when(hit["action"] != "", hit["action"]), F.lit("unknown"))
    )
    state = F.col("final_state")
    by_state = stop_type(state["status"], F.coalesce(state["budget_type"], state["budget_reason"]))
    pattern = r"budget_exhausted:\s*(steps|files|tokens)"
    phase = UNICODE + r"budget: (\w+) exhausted"
    line = F.get(F.filter("trace", lambda t: t.rlike(pattern) | t.rlike(phase)), 0)
    by_trace = F.coalesce(F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(line, phase, 1), F.lit("")))
    step_hit, state_hit = hit.isNotNull(), F.coalesce(state["status"].isin(ends), F.lit(False))
    return records.withColumn("budget_exceeded", step_hit | state_hit | line.isNotNull()).withColumn(
        "budget_type", F.when(step_hit, by_step).when(state_hit, by_state).otherwise(by_trace)
    )


def budget_overrun(flagged: DataFrame) -> DataFrame:
    """Records over budget by type, each with its share of all records."""
    counts = flagged.groupBy(F.col("budget_exceeded"), F.coalesce("budget_type", F.lit("unknown")).alias("budget_type")).count()
    total = flagged.agg(F.count("*")).scalar()
    return counts.where("budget_exceeded").select(
        "budget_type", F.col("count").alias("records"), (F.col("count") / total).alias("share")
    )


def phase_flags(records: DataFrame) -> DataFrame:
    """Which of the phases MAIN, GAP and RETOOL ran out of budget."""
    out = records
    for phase in fixed.PHASES:
        step = F.exists("steps", lambda s: (s["status"] == "budget_exhausted") & (s["action"] == phase))
        line = F.exists("trace", lambda t: F.regexp_extract(t, UNICODE + r"budget: (\w+) exhausted", 1) == phase)
        out = out.withColumn(phase.lower() + "_out", F.coalesce(step, F.lit(False)) | F.coalesce(line, F.lit(False)))
    return out


def phase_exhaustion(flagged: DataFrame) -> DataFrame:
    names = [p.lower() + "_out" for p in fixed.PHASES]
    any_out = F.greatest(*[F.col(n).cast("int") for n in names])
    return flagged.agg(F.avg(any_out).alias("any_rate"), *[F.avg(F.col(n).cast("int")).alias(n + "_rate") for n in names])


def semantic_rates(judgments: DataFrame) -> DataFrame:
    """Verdict shares over the judgments that worked, with a denominator of at least one."""
    valid = F.col("judge_error_type").isNull()
    counts = judgments.agg(F.count_if(valid).alias("n"), *[
        F.count_if(valid & (F.col("verdict") == v)).alias(v) for v in fixed.VERDICTS
    ])
    n = F.greatest(F.lit(1), F.col("n")).cast("double")
    return counts.select(
        F.col("n").alias("judged"), *[(F.col(v) / n).alias(f"{v}_rate") for v in fixed.VERDICTS],
        ((F.col("correct") + F.col("partially_correct")) / n).alias("any_correct_rate"),
    )


def rule_judge_mismatch(records: DataFrame) -> DataFrame:
    """Records (completed, verdict, judge_error_type) the rule fails and a working judge accepts."""
    odd = ~F.col("completed") & F.col("judge_error_type").isNull() & F.col("verdict").isin("correct", "partially_correct")
    return records.agg(F.count_if(odd).alias("mismatches"), F.count("*").alias("records"))


def step_status_distribution(steps: DataFrame) -> DataFrame:
    """Count and share of each step status."""
    counts = steps.groupBy(F.coalesce("status", F.lit("")).alias("status")).agg(F.count("*").alias("steps"))
    total = counts.agg(F.greatest(F.lit(1), F.sum("steps"))).scalar()
    return counts.select("status", "steps", (F.col("steps") / total).alias("share"))


def fallback_recovery(records: DataFrame) -> DataFrame:
    """Records with a fallback and evidence, divided by fallback trace lines (two different units, by definition)."""
    lines = F.size(F.filter(F.coalesce("trace", F.array().cast("array<string>")), lambda t: t.contains("fallback:")))
    per = records.select(lines.alias("n"), F.col("has_evidence").alias("ok"))
    sums = per.agg(F.sum("n").alias("fallback_lines"), F.count_if((F.col("n") > 0) & F.col("ok")).alias("recovered"))
    return sums.withColumn("fallback_recovery_rate", ratio(F.col("recovered"), F.col("fallback_lines")))


def claim_coverage(claims: DataFrame) -> DataFrame:
    """Covered share per query that has claims, from (query_id, claim_index, covered)."""
    return claims.groupBy("query_id").agg(
        F.count("*").alias("required"), F.count_if("covered").alias("covered")
    ).withColumn("coverage", F.col("covered") / F.col("required"))


# --- follow-ups --------------------------------------------------------------------------------


def chain_baseline(records: DataFrame) -> DataFrame:
    """Later members of a follow-up chain beside the step count of the first.

    The first member is found by aggregation, which combines before the shuffle, so one long chain never has to be
    sorted in a single task.
    """
    grouped = records.where(F.coalesce("follow_up_group", F.lit("")) != "")
    order = F.struct(F.coalesce("is_follow_up", F.lit(False)), F.col("seq"), F.col("sample_id"))
    first = grouped.groupBy("follow_up_group").agg(
        F.min_by(F.struct("step_count", "sample_id"), order).alias("_first")
    )
    return grouped.join(first, "follow_up_group").where(F.col("sample_id") != F.col("_first.sample_id")).select(
        "follow_up_group", "sample_id", "seq", F.col("_first.step_count").alias("initial_steps"), F.col("step_count").alias("follow_up_steps")
    )


def follow_up_cost(chains: DataFrame) -> DataFrame:
    cost = F.when(F.col("initial_steps") > 0, F.round(F.col("follow_up_steps") / F.col("initial_steps"), 4)).otherwise(1.0)
    return chains.withColumn("relative_cost", cost)


def quality_savings(chains_judged: DataFrame) -> DataFrame:
    """Saving of each follow-up, zero unless its answer is correct, or partly correct and grounded."""
    ok = (F.col("verdict") == "correct") | ((F.col("verdict") == "partially_correct") & F.col("grounded"))
    saved = F.greatest(F.lit(0.0), 1 - F.col("follow_up_steps") / F.greatest(F.lit(1), F.col("initial_steps")))
    return chains_judged.withColumn("quality_ok", ok).withColumn("score", F.when(ok, saved).otherwise(0.0))


def savings_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("follow_ups"), F.coalesce(F.avg(F.col("quality_ok").cast("int")), F.lit(0.0)).alias("reuse_success_rate"),
        F.coalesce(F.avg((F.col("follow_up_steps") > 0).cast("int")), F.lit(0.0)).alias("tool_fallback_rate"),
        F.coalesce(F.avg(F.round("score", 4)), F.lit(0.0)).alias("quality_preserving_savings"),
    )


def judge_summary(judgments: DataFrame) -> DataFrame:
    valid = F.col("judge_error_type").isNull()
    n, total = F.count_if(valid), F.count("*")
    kind = F.col("judge_error_type")
    return judgments.agg(
        total.alias("total"), *[ratio(F.count_if(valid & (F.col("verdict") == v)), n).alias(f"{v}_rate") for v in fixed.VERDICTS],
        ratio(F.count_if("uses_supported_evidence"), total).alias("grounded_rate"),
        ratio(F.count_if(kind == "judge_unavailable"), total).alias("unavailable_rate"),
        ratio(F.count_if(kind == "judge_invalid_schema"), total).alias("invalid_schema_rate"),
        ratio(n, total).alias("effective_rate"), F.count_if(F.col("retry_error").isNotNull() & valid).alias("retry_successes"),
    )


# --- issue evaluation ---------------------------------------------------------------------------


_MISSED = "(missed)"


def _with_missed(verdicts: DataFrame, missed: DataFrame) -> DataFrame:
    """Verdicts and missed issues as one input, so that one aggregation counts both."""
    judged = verdicts.select("sample_id", "verdict", F.lit(None).cast("string").alias("severity"))
    return judged.unionByName(missed.select("sample_id", F.lit(_MISSED).alias("verdict"), "severity"))


def verdict_counts() -> list[Column]:
    v = F.col("verdict")
    return [
        F.count_if(v != _MISSED).alias("total"), F.count_if(v == "correct").alias("correct"),
        F.count_if(v == "false_positive").alias("false_positive"),
        F.count_if(~v.isin("correct", "false_positive", _MISSED)).alias("uncertain"),
    ]


def _precision() -> Column:
    return F.round(ratio(F.col("correct"), F.col("correct") + F.col("false_positive")), 4)


def issue_metrics(verdicts: DataFrame, missed: DataFrame) -> DataFrame:
    """Precision, recall, F1 and false-positive rate of issues. missed: sample_id, severity."""
    lost = F.col("verdict") == _MISSED
    both = _with_missed(verdicts, missed).agg(
        *verdict_counts(), F.count_if(lost).alias("missed"),
        F.count_if(lost & F.col("severity").isin("high", "critical")).alias("missed_high"),
    )
    both = both.withColumn("precision", _precision()).withColumn(
        "recall", F.round(ratio(F.col("correct"), F.col("correct") + F.col("missed")), 4)
    )
    p, r = F.col("precision"), F.col("recall")
    return both.withColumn("f1", F.when(p + r > 0, F.round(2 * p * r / (p + r), 4)).otherwise(0.0)).withColumn(
        "false_positive_rate", F.round(ratio(F.col("false_positive"), F.col("total")), 4)
    )


def issue_metrics_by_tool(joined: DataFrame) -> DataFrame:
    """Counts and precision per tool; an issue of several tools counts for each."""
    rows = joined.select("verdict", F.explode("sources").alias("tool"))
    return rows.groupBy("tool").agg(*verdict_counts()).withColumn("precision", _precision())


def issue_metrics_by_severity(joined: DataFrame) -> DataFrame:
    rows = joined.where(F.col("severity").isin(list(fixed.SEVERITY_RANK)))
    return rows.groupBy("severity").agg(*verdict_counts()).withColumn("precision", _precision())


def issue_metrics_per_sample(samples: DataFrame, verdicts: DataFrame, missed: DataFrame) -> DataFrame:
    """State and counts of each sample; failed runs and unjudged samples without issues give no row.

    samples: sample_id, pipeline_error, issue_count, has_judgment, judgment_error, risk_level.
    """
    v = verdicts.groupBy("sample_id").agg(*verdict_counts()).drop("total")
    m = missed.groupBy("sample_id").agg(F.count("*").alias("missed"))
    rows = samples.where(F.col("pipeline_error").isNull()).where(F.col("has_judgment") | (F.col("issue_count") > 0))
    judged = F.col("has_judgment") & F.col("judgment_error").isNull()
    note = F.when(~F.col("has_judgment"), "未评判").when(~judged, F.col("judgment_error"))
    out = rows.join(v, "sample_id", "left").join(m, "sample_id", "left")
    counts = [F.when(judged, F.coalesce(c, F.lit(0))).alias(c) for c in ("correct", "false_positive", "uncertain", "missed")]
    return out.select("sample_id", "risk_level", "issue_count", judged.alias("judged"), note.alias("note"), *counts)


def high_risk_totals(per_sample: DataFrame) -> DataFrame:
    return per_sample.where("judged").where("risk_level = 'high'").agg(
        F.count("*").alias("samples"), F.coalesce(F.sum("correct"), F.lit(0)).alias("issues_detected"),
        F.coalesce(F.sum("missed"), F.lit(0)).alias("missed"),
    )


def verdict_summary(judged: DataFrame, verdicts: DataFrame, missed: DataFrame) -> DataFrame:
    """Totals over the judgments without error. judged: sample_id, error."""
    fine = judged.where(F.col("error").isNull()).select("sample_id")
    rows = _with_missed(verdicts, missed).join(fine, "sample_id", "left_semi")
    out = rows.agg(*verdict_counts(), F.count_if(F.col("verdict") == _MISSED).alias("missed"))
    return out.withColumn("samples", judged.agg(F.count("*")).scalar()).withColumn(
        "errors", judged.agg(F.count("error")).scalar()
    ).withColumn("precision", _precision())


def batch_summary(runs: DataFrame) -> DataFrame:
    """runs: error, issue_count."""
    good = F.col("error").isNull()
    return runs.agg(
        F.count("*").alias("total"), F.count_if(good).alias("success"), F.count_if(~good).alias("failures"),
        F.coalesce(F.sum(F.when(good, F.col("issue_count"))), F.lit(0)).alias("issues"),
    ).withColumn("avg_issues", F.round(ratio(F.col("issues"), F.col("success")), 1))


# --- coverage ------------------------------------------------------------------------------------


def coverage_report(samples: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Number of samples per value of each dimension, most frequent first when shown."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("value")) for d, c in dims.items()])
    return samples.select(F.inline(pairs)).where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.count("*").alias("samples"))


def combo_coverage(samples: DataFrame) -> DataFrame:
    """language+risk, language+analyzers and the set of risk signals, from the stored truth."""
    signals = F.array_join(F.array_sort("risk_signals"), "+")
    return coverage_report(samples, {
        "language_risk": F.concat_ws("+", "language", "risk_level"),
        "language_analyzers": F.concat_ws("+", F.col("language"), F.array_join("analyzers", "+")),
        "risk": F.when(F.size("risk_signals") > 0, F.concat(F.lit("risk="), signals)),
    })


# --- timelines and other counts -------------------------------------------------------------------


def timeline_summary(stages: DataFrame) -> DataFrame:
    """Successes, failures, total time and the longest stage (the first of equals). stages: run_id, ord, stage, ..."""
    longest = F.max_by("stage", F.struct(F.col("duration_ms"), -F.col("ord")))
    return stages.groupBy("run_id").agg(
        F.count_if(F.col("status") == "success").alias("success_count"), F.count_if(F.col("status") == "failed").alias("failure_count"),
        longest.alias("bottleneck"), F.max("duration_ms").alias("longest_ms"),
    )


def enumerate_usages(evidence: DataFrame) -> DataFrame:
    """Each place once (query_id, file, start_line), with the first evidence id that shows it."""
    return evidence.groupBy("query_id", "file", "start_line").agg(F.min("ev_id").alias("ev_id"))


def usage_totals(usages: DataFrame) -> DataFrame:
    """Places per file, and over all files of the query in the row without a file."""
    return usages.rollup("query_id", "file").agg(F.count("*").alias("hits")).where(F.col("query_id").isNotNull())


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """Verified and candidate evidence per task. evidence: query_id, task_id, ok."""
    return evidence.groupBy("query_id", "task_id").agg(
        F.count_if("ok").alias("verified"), F.count_if(~F.col("ok")).alias("candidates")
    )


def files_visited(evidence: DataFrame) -> DataFrame:
    return evidence.where(F.coalesce("file", F.lit("")) != "").select("query_id", "file").distinct()


def failure_labels(records: DataFrame) -> DataFrame:
    """Labels of each record; several may apply.

    records: sample_id, answer, expected_answer_keywords, file_hit, budget_exceeded, any_failed_step, trace.
    """
    low = F.lower(F.coalesce("answer", F.lit("")))
    expected = F.col("expected_answer_keywords")
    words = (F.size(expected) > 0) & F.forall(expected, lambda k: F.contains(low, F.lower(k)))
    tool = F.col("any_failed_step") | F.exists("trace", lambda t: t.startswith("tool_error:") | t.startswith("error:"))
    labels = F.array_compact(F.array(
        F.when(~F.coalesce(words, F.lit(False)), F.lit("keyword_miss")), F.when(~F.col("file_hit"), F.lit("expected_file_miss")),
        F.when(low.contains("llm 不可用"), F.lit("llm_fallback")), F.when(F.col("budget_exceeded"), F.lit("budget_exhausted")),
        F.when(F.coalesce(tool, F.lit(False)), F.lit("tool_error")),
    ))
    return records.withColumn("labels", labels)


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("records"))
