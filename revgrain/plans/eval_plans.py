"""Evaluation: plan scores, answer metrics, judgments, follow-ups, issue metrics, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from revgrain import fixed
from revgrain.operators import aggs, joins
from revgrain.plans.registry import query


def _list(column: str):
    return F.array_remove(F.split(column, ","), "")


def _sql_list(column: str) -> str:
    return f"list_filter(string_split({column}, ','), lambda x: x <> '')"


def _scores_sql() -> str:
    def prf(p: str, t: str, name: str) -> str:
        c = f"len(list_intersect({p}, {t}))"
        return f"""case when len({p}) > 0 then {c} / len({p}) else 0.0 end as {name}_precision, case when len({t}) > 0 then {c} / len({t}) else 1.0 end as {name}_recall"""

    return f"""with l as (select sample_id, risk_level, true_risk_level, {_sql_list('predicted')} as p, {_sql_list('truth')} as t, {_sql_list('predicted_reasons')} as pr, {_sql_list('true_reasons')} as tr from v_plans),
      s as (select *, {prf('p', 't', 'analyzer')}, {prf('pr', 'tr', 'reason')} from l)
      select sample_id, cast(analyzer_precision as double) as analyzer_precision, cast(analyzer_recall as double) as analyzer_recall,
        cast(case when analyzer_precision + analyzer_recall > 0 then 2 * analyzer_precision * analyzer_recall / (analyzer_precision + analyzer_recall) else 0 end as double) as analyzer_f1,
        cast(reason_precision as double) as reason_precision, cast(reason_recall as double) as reason_recall,
        cast(case when reason_precision + reason_recall > 0 then 2 * reason_precision * reason_recall / (reason_precision + reason_recall) else 0 end as double) as reason_f1,
        risk_level = true_risk_level as risk_ok, list_has_any(tr, ['auth_change', 'command_injection', 'sql_risk', 'deserialization']) or true_risk_level = 'high' as high_risk,
        list_contains(p, 'bandit') as has_bandit from s"""


def _pairs(t):
    pred = t.plans.select("sample_id", _list("predicted").alias("analyzers"), _list("predicted_reasons").alias("reason_codes"), "risk_level")
    truth = t.plans.select("sample_id", _list("truth").alias("true_analyzers"), _list("true_reasons").alias("true_reason_codes"), "true_risk_level")
    return joins.predictions_with_truth(pred, truth)


@query("plan_scores", "J04 A02 U04", _scores_sql())
def _(t):
    return aggs.plan_scores(_pairs(t))


_ROUNDED = ["analyzer_precision", "analyzer_recall", "analyzer_f1", "reason_precision", "reason_recall", "reason_f1"]


@query("planner_metrics", "A02", f"""select count(*) as total_samples, {', '.join(f'round(avg({c}), 9) as {c}' for c in _ROUNDED)}, avg(cast(risk_ok as int)) as risk_level_accuracy,
  count(*) filter (high_risk and has_bandit) / count(*) filter (high_risk) as high_risk_recall from ({_scores_sql()})""")
def _(t):
    m = aggs.planner_metrics(aggs.plan_scores(_pairs(t)))
    return m.select("total_samples", *[F.round(c, 9).alias(c) for c in _ROUNDED], "risk_level_accuracy", "high_risk_recall")


@query("keyword_micro_metrics", "A03", f"""with l as (select {_sql_list('predicted')} as p, {_sql_list('truth')} as t, risk_level, case when sample_id % 5 = 0 then '' else true_risk_level end as tr from v_plans),
  s as (select count(*) as total, sum(len(list_intersect(p, t))) as tp, sum(len(p) - len(list_intersect(p, t))) as fp, sum(len(t) - len(list_intersect(p, t))) as fn, count(*) filter (tr = '' or tr = risk_level) as ok from l),
  r as (select total, ok / total as a, tp / (tp + fp) as p, tp / (tp + fn) as r from s)
  select total, a as question_type_accuracy, p as keyword_precision, r as keyword_recall, 2 * p * r / (p + r) as keyword_f1 from r""")
def _(t):
    rows = t.plans.select(_list("predicted").alias("keywords"), _list("truth").alias("expected_keywords"), F.col("risk_level").alias("question_type"),
                          F.when(F.col("sample_id") % 5 == 0, "").otherwise(F.col("true_risk_level")).alias("expected_type"))
    return aggs.keyword_micro_metrics(rows)


def _side(scores, name):
    return scores.select("sample_id", F.col(name).alias("analyzer_f1"))


@query("planner_compare", "A31", f"""select sample_id, analyzer_f1 as f1_a, reason_f1 as f1_b, case when analyzer_f1 > reason_f1 then 'a' when reason_f1 > analyzer_f1 then 'b' else 'tie' end as winner from ({_scores_sql()})""")
def _(t):
    s = aggs.plan_scores(_pairs(t))
    return aggs.planner_compare(_side(s, "analyzer_f1"), _side(s, "reason_f1"))


@query("planner_compare_summary", "A31", f"""select count(*) as samples, count(*) filter (analyzer_f1 > reason_f1) as wins_a, count(*) filter (reason_f1 > analyzer_f1) as wins_b, round(avg(analyzer_f1) - avg(reason_f1), 8) as delta,
  (select avg(l_linenumber) from lineitem) as mean_latency_ms, (select count(*) from lineitem where l_linenumber = 7) as errors from ({_scores_sql()})""")
def _(t):
    s = aggs.plan_scores(_pairs(t))
    calls = t.lineitem.select(F.col("l_linenumber").alias("latency_ms"), F.when(F.col("l_linenumber") == 7, "timeout").alias("error"))
    c = aggs.planner_compare_summary(aggs.planner_compare(_side(s, "analyzer_f1"), _side(s, "reason_f1")), calls)
    return c.select("samples", "wins_a", "wins_b", F.round("delta", 8).alias("delta"), "mean_latency_ms", "errors")


# --- citations ---------------------------------------------------------------------------------------------

_REFS = r"""select sample_id, split_part(r, ':', 1) as file, cast(split_part(r, ':', 2) as bigint) as line, count(*) as times
  from (select sample_id, unnest(regexp_extract_all(answer_part, '[\w./-]+\.[\w]+:\d+')) as r from v_answers) group by all"""
_GROUND_SQL = f"""select c.sample_id, c.file, c.line, c.times, coalesce(bool_or(c.line between e.start_line and e.end_line), false) as verified,
    case when count(e.sample_id) = 0 then 'file not found in evidence' when not bool_or(c.line between e.start_line and e.end_line) then 'line out of evidence range' end as reason
  from ({_REFS}) c left join (select distinct * from v_citing_evidence) e on c.sample_id = e.sample_id and c.file = e.file group by c.sample_id, c.file, c.line, c.times"""


def _citations(t):
    return joins.answer_citations(t.answers.withColumnRenamed("answer_part", "answer"))


@query("ground_citations", "J07 F10", _GROUND_SQL)
def _(t):
    return joins.ground_citations(_citations(t), t.citing_evidence)


@query("grounding_summary", "J07", f"""select o_orderkey as sample_id, coalesce(cast(sum(times) as bigint), 0) as total_refs, coalesce(cast(sum(case when verified then times else 0 end) as bigint), 0) as verified_refs,
  coalesce(bool_and(verified), false) as grounded, count(g.sample_id) = 0 as no_refs from orders left join ({_GROUND_SQL}) g on o_orderkey = g.sample_id group by o_orderkey""")
def _(t):
    samples = t.orders.select(F.col("o_orderkey").alias("sample_id"))
    return joins.grounding_summary(samples, joins.ground_citations(_citations(t), t.citing_evidence))


@query("citations_strict", "J08 A05", f"""with c as ({_REFS}), e as (select distinct sample_id, file, start_line as line, true as hit from v_citing_evidence)
  select o_orderkey as sample_id, coalesce(bool_and(coalesce(hit, false)) filter (c.sample_id is not null), false) as grounded
  from orders left join c on c.sample_id = o_orderkey left join e on c.sample_id = e.sample_id and c.file = e.file and c.line = e.line group by o_orderkey""")
def _(t):
    samples = t.orders.select(F.col("o_orderkey").alias("sample_id"))
    return joins.citations_strict(samples, _citations(t), t.citing_evidence)


@query("ground_verdicts", "F24", f"""with g as (select sample_id, bool_and(verified) as grounded from ({_GROUND_SQL}) group by sample_id)
  select r.sample_id, case when r.verdict = 'correct' and not coalesce(g.grounded, true) then 'partially_correct' else r.verdict end as verdict,
    case when r.verdict = 'correct' and not coalesce(g.grounded, true) then 1 else 2 end as score, r.verdict = 'correct' and not coalesce(g.grounded, true) as downgraded
  from v_records r left join g using (sample_id)""")
def _(t):
    g = joins.grounding_summary(_citations(t), joins.ground_citations(_citations(t), t.citing_evidence))
    return joins.ground_verdicts(t.records.select("sample_id", "verdict", F.lit(2).alias("score")), g)


# --- answer metrics ------------------------------------------------------------------------------------------

_HITS = """select r.sample_id, bool_or(e.file is not null) or count(r.expected_file) = 0 as file_hit from v_records r
  left join (select distinct sample_id, file from v_citing_evidence) e on r.sample_id = e.sample_id and r.expected_file = e.file group by r.sample_id"""


def _file_hits(t):
    return joins.expected_file_hits(t.records.select("sample_id", F.col("expected_file").alias("file")), t.citing_evidence)


@query("expected_file_hits", "J09", _HITS)
def _(t):
    return _file_hits(t)


@query("expected_file_hit_arrays", "J09 U04", f"""select sample_id, len(p) = 0 or list_has_any(p, t) as file_hit from (select sample_id, {_sql_list('predicted')} as p, {_sql_list('truth')} as t from v_plans)""")
def _(t):
    return t.plans.select("sample_id", joins.expected_file_hit(_list("predicted"), _list("truth")).alias("file_hit"))


_DONE = f"""select r.sample_id, expected_words <> '' and len(list_filter({_sql_list('expected_words')}, lambda w: not contains(lower(answer), w))) = 0 and file_hit as completed, file_hit
  from v_records r join ({_HITS}) h using (sample_id)"""


def _completed(t):
    rows = t.records.join(_file_hits(t), "sample_id")
    return rows.withColumn("completed", aggs.completion(F.col("answer"), _list("expected_words"), F.col("file_hit")))


@query("completion_rate", "A04 A05 F12", f"""select count(*) as total, avg(cast(completed as int)) as completed_rate, avg(cast(file_hit as int)) as file_hit_rate from ({_DONE})""")
def _(t):
    return aggs.rates(_completed(t), ["completed", "file_hit"])


@query("avg_steps_by_type", "A06", """select coalesce(question_type, '(all)') as question_type, avg(step_count) as avg_steps, count(*) as records
  from v_records where not is_follow_up group by grouping sets ((question_type), ())""")
def _(t):
    return aggs.avg_steps_by_type(t.records)


def _stepped(t):
    step = F.struct("decision", "status", "action", F.lit(None).cast("string").alias("budget_reason"))
    state = F.struct(F.col("final_status").alias("status"), F.lit(None).cast("string").alias("budget_type"), F.lit(None).cast("string").alias("budget_reason"))
    return t.records.withColumn("steps", F.array(step)).withColumn("final_state", state).withColumn("trace", F.array("trace"))


_BUDGET = r"""select sample_id, case when decision = 'STOP_FILE_LIMIT' then 'files' when decision = 'BUDGET' then null when status = 'budget_exhausted' then action
    when final_status = 'STOP_STEP_LIMIT' then 'steps' else coalesce(nullif(regexp_extract(trace, 'budget_exhausted:\s*(steps|files|tokens)', 1), ''), nullif(regexp_extract(trace, 'budget: (\w+) exhausted', 1), '')) end as budget_type,
  decision in ('STOP_FILE_LIMIT', 'BUDGET') or status = 'budget_exhausted' or final_status = 'STOP_STEP_LIMIT' or regexp_matches(trace, 'budget_exhausted:\s*(steps|files|tokens)|budget: (\w+) exhausted') as budget_exceeded from v_records"""


@query("budget_flags", "F20", _BUDGET)
def _(t):
    return aggs.budget_flags(_stepped(t)).select("sample_id", "budget_exceeded", "budget_type")


@query("budget_overrun", "A07", f"""select coalesce(budget_type, 'unknown') as budget_type, count(*) as records, count(*) / (select count(*) from v_records) as share from ({_BUDGET}) where budget_exceeded group by 1""")
def _(t):
    return aggs.budget_overrun(aggs.budget_flags(_stepped(t)))


_PHASES = "select sample_id, " + ", ".join(
    f"(status = 'budget_exhausted' and action = '{p}') or trace = 'budget: {p} exhausted' as {p.lower()}_out" for p in fixed.PHASES) + " from v_records"


@query("phase_flags", "F21", _PHASES)
def _(t):
    return aggs.phase_flags(_stepped(t)).select("sample_id", *[p.lower() + "_out" for p in fixed.PHASES])


@query("phase_exhaustion", "A08", f"select avg(cast(main_out or gap_out or retool_out as int)) as any_rate, avg(cast(main_out as int)) as main_out_rate, avg(cast(gap_out as int)) as gap_out_rate, avg(cast(retool_out as int)) as retool_out_rate from ({_PHASES})")
def _(t):
    return aggs.phase_exhaustion(aggs.phase_flags(_stepped(t)))


_VERDICT_RATES = ", ".join(f"count(*) filter (judge_error_type is null and verdict = '{v}') / greatest(1, count(*) filter (judge_error_type is null)) as {v}_rate" for v in fixed.VERDICTS)


@query("semantic_rates", "A09", f"""select count(*) filter (judge_error_type is null) as judged, {_VERDICT_RATES},
  count(*) filter (judge_error_type is null and verdict in ('correct', 'partially_correct')) / greatest(1, count(*) filter (judge_error_type is null)) as any_correct_rate from v_judgments""")
def _(t):
    return aggs.semantic_rates(t.judgments)


@query("rule_judge_mismatch", "A10", f"""select count(*) filter (not completed and judge_error_type is null and verdict in ('correct', 'partially_correct')) as mismatches, count(*) as records
  from ({_DONE}) d join v_records r using (sample_id)""")
def _(t):
    return aggs.rule_judge_mismatch(_completed(t))


@query("step_status_distribution", "A11", "select status, count(*) as steps, count(*) / (select count(*) from v_steps) as share from v_steps group by status")
def _(t):
    return aggs.step_status_distribution(t.steps)


@query("fallback_recovery", "A12", """select count(*) filter (contains(trace, 'fallback:')) as fallback_lines, count(*) filter (contains(trace, 'fallback:') and step_count > 2) as recovered,
  count(*) filter (contains(trace, 'fallback:') and step_count > 2) / count(*) filter (contains(trace, 'fallback:')) as fallback_recovery_rate from v_records""")
def _(t):
    rows = t.records.select(F.array("trace").alias("trace"), (F.col("step_count") > 2).alias("has_evidence"))
    return aggs.fallback_recovery(rows).withColumn("fallback_lines", F.col("fallback_lines").cast("bigint"))


_CLAIMS = """select query_id, seq as claim_index, concat('sym', start_line * 5, ' must call', start_line, ' 42 x') as claim from (
  select l_orderkey as query_id, l_linenumber as start_line, concat(l_linenumber, '_', l_partkey, '_', l_suppkey) as seq from lineitem)"""
_CLAIM_EV = """select l_orderkey as query_id, concat('def sym', l_partkey % 40, '(x): call', l_suppkey % 7, '(y)') as snippet from lineitem where l_discount >= 0.02"""
_COVERED = f"""select c.query_id, c.claim_index, c.claim, coalesce(bool_or(len(list_filter(string_split(lower(c.claim), ' '), lambda w: length(w) >= 2 and w <> '42' and contains(lower(e.snippet), w))) > 0), false) as covered
  from ({_CLAIMS}) c left join ({_CLAIM_EV}) e on c.query_id = e.query_id group by all"""


def _claims(t):
    claims = t.lineitem.selectExpr("l_orderkey as query_id", "concat(l_linenumber, '_', l_partkey, '_', l_suppkey) as claim_index",
                                   "concat('sym', l_linenumber * 5, ' must call', l_linenumber, ' 42 x') as claim")
    ev = t.lineitem.where("l_discount >= 0.02").selectExpr("l_orderkey as query_id", "concat('def sym', l_partkey % 40, '(x): call', l_suppkey % 7, '(y)') as snippet")
    return joins.claims_covered(claims, ev)


@query("claims_covered", "J12 F13", _COVERED)
def _(t):
    return _claims(t)


@query("claim_coverage", "A13", f"select query_id, count(*) as required, count(*) filter (covered) as covered, count(*) filter (covered) / count(*) as coverage from ({_COVERED}) group by query_id")
def _(t):
    return aggs.claim_coverage(_claims(t))


# --- follow-ups ------------------------------------------------------------------------------------------------

_CHAIN = """select follow_up_group, sample_id, seq, cast(initial_steps as int) as initial_steps, cast(step_count as int) as follow_up_steps from (select *, first_value(step_count) over w as initial_steps, row_number() over w as rn
  from {source} where follow_up_group <> '' window w as (partition by follow_up_group order by is_follow_up, seq, sample_id)) where rn > 1"""


@query("chain_baseline", "W05", _CHAIN.format(source="v_chains"))
def _(t):
    return aggs.chain_baseline(t.chains)


@query("follow_up_cost", "A14", f"select follow_up_group, sample_id, initial_steps, follow_up_steps, case when initial_steps > 0 then round(follow_up_steps / initial_steps, 4) else 1.0 end as relative_cost from ({_CHAIN.format(source='v_chains')})")
def _(t):
    return aggs.follow_up_cost(aggs.chain_baseline(t.chains)).drop("seq")


_SAVED = f"""select c.follow_up_group, c.sample_id, c.initial_steps, c.follow_up_steps, coalesce(j.verdict, '') as verdict, coalesce(j.uses_supported_evidence, false) as grounded,
    coalesce(j.verdict = 'correct' or (j.verdict = 'partially_correct' and j.uses_supported_evidence), false) as quality_ok,
    case when coalesce(j.verdict = 'correct' or (j.verdict = 'partially_correct' and j.uses_supported_evidence), false) then greatest(0.0, 1 - c.follow_up_steps / greatest(1, c.initial_steps)) else 0.0 end as score
  from ({_CHAIN.format(source='v_records')}) c left join v_judgments j on j.sample_id = c.sample_id"""


def _saved(t):
    chains = aggs.chain_baseline(t.records)
    return aggs.quality_savings(joins.judgment_lookup(chains, t.judgments))


@query("quality_savings", "A15 J06", f"select follow_up_group, sample_id, initial_steps, follow_up_steps, verdict, grounded, quality_ok, round(score, 8) as score from ({_SAVED})")
def _(t):
    return _saved(t).drop("seq").withColumn("score", F.round("score", 8))


@query("savings_summary", "A15", f"""select count(*) as follow_ups, avg(cast(quality_ok as int)) as reuse_success_rate, avg(cast(follow_up_steps > 0 as int)) as tool_fallback_rate, round(avg(round(score, 4)), 7) as quality_preserving_savings from ({_SAVED})""")
def _(t):
    return aggs.savings_summary(_saved(t)).withColumn("quality_preserving_savings", F.round("quality_preserving_savings", 7))


@query("judge_summary", "A16", f"""select count(*) as total, {_VERDICT_RATES}, count(*) filter (step_count > 3) / count(*) as grounded_rate, count(*) filter (judge_error_type = 'judge_unavailable') / count(*) as unavailable_rate,
  count(*) filter (judge_error_type = 'judge_invalid_schema') / count(*) as invalid_schema_rate, count(*) filter (judge_error_type is null) / count(*) as effective_rate,
  count(*) filter (judge_error_type is null and step_count = 5) as retry_successes from v_records""")
def _(t):
    rows = t.records.select("verdict", "judge_error_type", (F.col("step_count") > 3).alias("uses_supported_evidence"),
                            F.when(F.col("step_count") == 5, "first attempt").alias("retry_error"))
    return aggs.judge_summary(rows)


# --- issue metrics ------------------------------------------------------------------------------------------------

_SOURCES = "case when l_suppkey % 3 = 0 then 'ruff,bandit' when l_suppkey % 3 = 1 then 'ruff' else 'semantic' end"
_ISSUES = f"select l_orderkey as sample_id, l_linenumber - 1 as issue_index, min(l_shipmode_severity) as severity, min(s) as sources from (select l_orderkey, l_linenumber, case when l_quantity >= 45 then 'critical' when l_quantity >= 35 then 'high' when l_quantity >= 20 then 'medium' when l_quantity >= 8 then 'low' else 'info' end as l_shipmode_severity, {_SOURCES} as s from lineitem where l_linenumber <= 5) group by all"


def _issues(t):
    sev = F.expr("case when l_quantity >= 45 then 'critical' when l_quantity >= 35 then 'high' when l_quantity >= 20 then 'medium' when l_quantity >= 8 then 'low' else 'info' end")
    rows = t.lineitem.where("l_linenumber <= 5").groupBy(F.col("l_orderkey").alias("sample_id"), F.expr("l_linenumber - 1").alias("issue_index"))
    return rows.agg(F.min(sev).alias("severity"), F.split(F.min(F.expr(_SOURCES)), ",").alias("sources"))


def _joined(t):
    return joins.issue_verdicts(t.verdicts, _issues(t))


@query("issue_verdicts", "J05", f"select v.ev_id, v.sample_id, v.issue_index, v.verdict, i.severity, i.sources from v_verdicts v left join ({_ISSUES}) i using (sample_id, issue_index)")
def _(t):
    return _joined(t).withColumn("sources", F.array_join("sources", ","))


_COUNTS = "count(*) as total, count(*) filter (verdict = 'correct') as correct, count(*) filter (verdict = 'false_positive') as false_positive, count(*) filter (verdict not in ('correct', 'false_positive')) as uncertain"
_PRECISION = "coalesce(round(count(*) filter (verdict = 'correct') / nullif(count(*) filter (verdict in ('correct', 'false_positive')), 0), 4), 0.0) as precision"


@query("issue_metrics", "A17", f"""with c as (select {_COUNTS}, {_PRECISION} from v_verdicts), m as (select count(*) as missed, count(*) filter (severity in ('high', 'critical')) as missed_high from v_missed),
  r as (select *, round(correct / (correct + missed), 4) as recall from c, m)
  select *, round(2 * precision * recall / (precision + recall), 4) as f1, round(false_positive / total, 4) as false_positive_rate from r""")
def _(t):
    return aggs.issue_metrics(t.verdicts, t.missed)


@query("issue_metrics_by_tool", "A18", f"select tool, {_COUNTS}, {_PRECISION} from (select verdict, unnest(string_split(sources, ',')) as tool from v_verdicts v join ({_ISSUES}) i using (sample_id, issue_index)) group by tool")
def _(t):
    return aggs.issue_metrics_by_tool(_joined(t))


@query("issue_metrics_by_severity", "A18", f"select severity, {_COUNTS}, {_PRECISION} from v_verdicts v join ({_ISSUES}) i using (sample_id, issue_index) group by severity")
def _(t):
    return aggs.issue_metrics_by_severity(_joined(t))


_PER_SAMPLE = f"""with v as (select sample_id, {_COUNTS} from v_verdicts group by sample_id), m as (select sample_id, count(*) as missed from v_missed group by sample_id)
  select s.sample_id, s.risk_level, s.issue_count, s.has_judgment and s.judgment_error is null as judged, case when not has_judgment then '未评判' else judgment_error end as note,
    {', '.join(f"case when has_judgment and judgment_error is null then coalesce({c}, 0) end as {c}" for c in ('correct', 'false_positive', 'uncertain', 'missed'))}
  from v_sample_state s left join v using (sample_id) left join m using (sample_id) where pipeline_error is null and (has_judgment or issue_count > 0)"""


def _per_sample(t):
    return aggs.issue_metrics_per_sample(t.sample_state, t.verdicts, t.missed)


@query("issue_metrics_per_sample", "A19", _PER_SAMPLE)
def _(t):
    return _per_sample(t)


@query("high_risk_totals", "A19", f"select count(*) as samples, cast(sum(correct) as bigint) as issues_detected, cast(sum(missed) as bigint) as missed from ({_PER_SAMPLE}) where judged and risk_level = 'high'")
def _(t):
    return aggs.high_risk_totals(_per_sample(t))


@query("verdict_summary", "A20", f"""with ok as (select sample_id from v_sample_state where judgment_error is null), v as (select * from v_verdicts where sample_id in (select sample_id from ok))
  select {_COUNTS}, {_PRECISION}, (select count(*) from v_missed where sample_id in (select sample_id from ok)) as missed, (select count(*) from v_sample_state) as samples, (select count(judgment_error) from v_sample_state) as errors from v""")
def _(t):
    return aggs.verdict_summary(t.sample_state.select("sample_id", F.col("judgment_error").alias("error")), t.verdicts, t.missed)


@query("batch_summary", "A21", """select count(*) as total, count(*) filter (pipeline_error is null) as success, count(pipeline_error) as failures, cast(sum(issue_count) filter (pipeline_error is null) as bigint) as issues,
  round(sum(issue_count) filter (pipeline_error is null) / count(*) filter (pipeline_error is null), 1) as avg_issues from v_sample_state""")
def _(t):
    return aggs.batch_summary(t.sample_state.select(F.col("pipeline_error").alias("error"), "issue_count"))


@query("pair_results", "S15", "select s.sample_id, s.issue_count, j.verdict from v_sample_state s left join v_judgments j using (sample_id)")
def _(t):
    return joins.pair_results(t.sample_state.select("sample_id", "issue_count"), t.judgments.select("sample_id", "verdict"))


@query("judgment_lookup", "J06", "select r.sample_id, coalesce(j.verdict, '') as verdict, coalesce(j.uses_supported_evidence, false) as grounded from v_records r left join v_judgments j using (sample_id)")
def _(t):
    return joins.judgment_lookup(t.records.select("sample_id"), t.judgments)


_DIMS = ["language", "risk_level", "change_type", "question_type"]


@query("coverage_report", "A22", " union all ".join(f"select '{d}' as dimension, cast({d} as varchar) as value, count(*) as samples from v_samples group by 2" for d in _DIMS)
       + " union all select 'files', concat('files_', files), count(*) from v_samples group by 2 union all select 'lines', concat('lines_', lines), count(*) from v_samples group by 2")
def _(t):
    dims = {d: F.col(d) for d in _DIMS} | {"files": F.concat(F.lit("files_"), "files"), "lines": F.concat(F.lit("lines_"), "lines")}
    return aggs.coverage_report(t.samples, dims)


@query("combo_coverage", "A23", f"""with s as (select language, risk_level, {_sql_list('predicted')} as a, {_sql_list('true_reasons')} as r from v_samples join v_plans p using (sample_id))
  select 'language_risk' as dimension, concat(language, '+', risk_level) as value, count(*) as samples from (select language, s.risk_level from v_samples s) group by 2
  union all select 'language_analyzers', concat(language, '+', array_to_string(a, '+')), count(*) from (select language, a from (select s.language, {_sql_list('p.predicted')} as a from v_samples s join v_plans p using (sample_id))) group by 2
  union all select 'risk', concat('risk=', array_to_string(list_sort(r), '+')), count(*) from (select {_sql_list('true_reasons')} as r from v_plans) where len(r) > 0 group by 2""".replace("with s as (select language, risk_level, " + _sql_list('predicted') + " as a, " + _sql_list('true_reasons') + " as r from v_samples join v_plans p using (sample_id))\n", ""))
def _(t):
    plans = t.plans.select("sample_id", _list("predicted").alias("analyzers"), _list("true_reasons").alias("risk_signals"))
    return aggs.combo_coverage(t.samples.select("sample_id", "language", "risk_level").join(plans, "sample_id"))


_LABELS = f"""select r.sample_id, list_filter([case when not (expected_words <> '' and len(list_filter({_sql_list('expected_words')}, lambda w: not contains(lower(answer), w))) = 0) then 'keyword_miss' end,
    case when not file_hit then 'expected_file_miss' end, case when budget_exceeded then 'budget_exhausted' end, case when status = 'failed' or trace like 'tool_error:%' then 'tool_error' end], lambda x: x is not null) as labels
  from v_records r join ({_HITS}) h using (sample_id) join ({_BUDGET}) b using (sample_id)"""


def _labelled(t):
    flags = aggs.budget_flags(_stepped(t)).withColumn("any_failed_step", F.exists("steps", lambda s: s["status"] == "failed"))
    rows = flags.withColumn("expected_answer_keywords", _list("expected_words")).join(_file_hits(t), "sample_id")
    return aggs.failure_labels(rows)


@query("failure_labels", "A33", f"select sample_id, array_to_string(labels, ',') as labels from ({_LABELS})")
def _(t):
    return _labelled(t).select("sample_id", F.array_join("labels", ",").alias("labels"))


@query("failure_label_counts", "A33", f"select label, count(*) as records from (select unnest(labels) as label from ({_LABELS})) group by label")
def _(t):
    return aggs.label_counts(_labelled(t))


