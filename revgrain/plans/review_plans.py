"""Change review: diffs, lint reports, risk plans, issues and traceability."""

from __future__ import annotations

from pyspark.sql import functions as F

from revgrain import fixed
from revgrain.functions import review
from revgrain.operators import aggs, joins
from revgrain.plans.registry import query
from revgrain.sources import diffs, lint

_NS = """select repo_id, base, head, c[1] as s, c from (select repo_id, base, head, string_split(l, chr(9)) as c
  from (select repo_id, base, head, unnest(string_split(name_status, chr(10))) as l from v_diffs) where trim(l) <> '')"""
_STATUS_SQL = f"""select repo_id, base, head, case left(s, 1) when 'A' then 'added' when 'D' then 'deleted' when 'R' then 'renamed' else 'modified' end as change_type,
  c[-1] as path, case when left(s, 1) = 'R' and len(c) >= 3 then c[2] else '' end as old_path from ({_NS})"""
_NUMSTAT_SQL = """select repo_id, base, head, case when p like '%{%' then regexp_replace(p, '\\{.* => (.*)\\}', '\\1') else p end as path,
  coalesce(case when c[1] = '-' then 0 else try_cast(c[1] as int) end, 0) as added,
  case when c[1] <> '-' and try_cast(c[1] as int) is null then 0 else coalesce(case when c[2] = '-' then 0 else try_cast(c[2] as int) end, 0) end as deleted
  from (select repo_id, base, head, c, c[-1] as p from (select repo_id, base, head, string_split(l, chr(9)) as c
    from (select repo_id, base, head, unnest(string_split(numstat, chr(10))) as l from v_diffs) where trim(l) <> ''))"""


@query("parse_name_status", "S04", _STATUS_SQL)
def _(t):
    return diffs.parse_name_status(t.diffs).drop("pos")


@query("parse_numstat", "S05", _NUMSTAT_SQL)
def _(t):
    return diffs.parse_numstat(t.diffs)


@query("changed_files", "J03", f"""select repo_id, base, head, path, change_type, old_path, coalesce(added, 0) as added, coalesce(deleted, 0) as deleted
  from ({_STATUS_SQL}) left join ({_NUMSTAT_SQL}) using (repo_id, base, head, path)""")
def _(t):
    return diffs.status_join_numstat(diffs.parse_name_status(t.diffs), diffs.parse_numstat(t.diffs))


_PATCH_SQL = """select repo_id, base, head, cast(i - 1 as int) as pos, regexp_extract(p, '^a/.* b/([^\\n]*)', 1) as path, concat('diff --git ', rtrim(p, chr(10))) as patch
  from (select repo_id, base, head, i, parts[i + 1] as p from (select repo_id, base, head, parts, unnest(range(1, len(parts))) as i
    from (select repo_id, base, head, string_split(diff, 'diff --git ') as parts from v_diffs)))"""


@query("file_patches", "S07", f"select repo_id, base, head, pos, path, left(patch, {fixed.PATCH_CHARS}) as patch from ({_PATCH_SQL})")
def _(t):
    return diffs.split_file_patches(t.diffs)


@query("parse_hunks", "S06", f"""select repo_id, base, head, path, cast(i - 1 as int) as hunk, cast(regexp_extract(h, '-(\\d+)', 1) as int) as old_start,
    cast(coalesce(nullif(regexp_extract(h, '-\\d+,(\\d+)', 1), ''), '1') as int) as old_lines, cast(regexp_extract(h, '\\+(\\d+)', 1) as int) as new_start,
    cast(coalesce(nullif(regexp_extract(h, '\\+\\d+,(\\d+)', 1), ''), '1') as int) as new_lines
  from (select repo_id, base, head, path, i, hs[i] as h from (select repo_id, base, head, path, hs, unnest(range(1, len(hs) + 1)) as i
    from (select repo_id, base, head, path, list_filter(string_split(patch, chr(10)), lambda l: starts_with(l, '@@ ')) as hs from ({_PATCH_SQL}))))""")
def _(t):
    return diffs.parse_hunks(t.diffs)


@query("ruff_reports", "S08", """select run_id, 'ruff' as tool, j->>'code' as rule_id, j->>'message' as message, 'info' as severity, j->>'filename' as file,
    coalesce(cast(j->'location'->>'row' as int), 0) as start_line, coalesce(cast(j->'end_location'->>'row' as int), 0) as end_line,
    concat(j->>'code', ': ', j->>'message') as snippet, concat('https://docs.astral.sh/ruff/rules/', lower(j->>'code'), '/') as reference
  from (select run_id, unnest(cast(ruff as json[])) as j from v_reports)""")
def _(t):
    return lint.read_ruff_reports(t.reports).drop("confidence", "evidence_id")


@query("bandit_reports", "S09 Q2", """select run_id, rule_id, j->>'issue_text' as message, case j->>'issue_severity' when 'LOW' then 'low' when 'MEDIUM' then 'medium' when 'HIGH' then 'high' else 'info' end as severity,
    j->>'filename' as file, cast(j->>'line_number' as int) as start_line, concat('https://bandit.readthedocs.io/en/latest/plugins/', lower(rule_id), '.html') as reference
  from (select run_id, j, case when j->>'test_id' like 'B%' then j->>'test_id' else concat('B', j->>'test_id') end as rule_id
    from (select run_id, unnest(cast(cast(bandit as json)->'results' as json[])) as j from v_reports))""")
def _(t):
    return lint.read_bandit_reports(t.reports).drop("confidence", "evidence_id", "tool", "end_line", "snippet")


@query("union_findings", "U01", """select run_id, tool, count(*) as findings, cast(sum(start_line) as bigint) as lines from (
  select run_id, tool, start_line from v_findings union all select run_id, 'ruff', coalesce(cast(j->'location'->>'row' as int), 0) from (select run_id, unnest(cast(ruff as json[])) as j from v_reports)) group by all""")
def _(t):
    return aggs.union_findings(t.findings, lint.read_ruff_reports(t.reports)).groupBy("run_id", "tool").agg(
        F.count("*").alias("findings"), F.sum("start_line").alias("lines"))


_RANK = "case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"
_ISSUE_SQL = f"""with f as (select run_id, file, rule_id, start_line as line, message, tool, seq, {_RANK} as r from v_findings),
  m as (select run_id, file, rule_id, line, message, min(seq) as seq from f group by all),
  g as (select run_id, file, rule_id, line, arg_min(tool, (seq, tool)) as source, max(r) as r, count(*) as n from f group by all),
  j as (select run_id, file, rule_id, line, string_agg(message, '; ' order by seq, message) as reason, arg_min(message, (seq, message)) as first_message from m group by all)
  select run_id, file, rule_id, line, 'static' as type, case r when 4 then 'critical' when 3 then 'high' when 2 then 'medium' when 1 then 'low' else 'info' end as severity,
    concat('[', rule_id, '] ', left(first_message, 80)) as title, reason, source, n as finding_count from g join j using (run_id, file, rule_id, line)"""


@query("aggregate_findings", "A01 W09 F22 U02", _ISSUE_SQL)
def _(t):
    issues = aggs.aggregate_findings(t.findings)
    return aggs.rank_issues(issues).withColumn("source", F.array_join("source", ",")).drop("rank")


@query("issue_evidence", "A01 U05", "select run_id, file, rule_id, start_line as line, evidence_id, min(seq) as seq from v_findings group by all")
def _(t):
    return aggs.issue_evidence(t.findings)


@query("resolve_evidence", "J01", """select f.finding_id as owner_id, e.ev_id, e.file, e.start_line, e.confidence
  from v_findings f join v_evidence e on f.run_id = e.run_id and f.evidence_id = e.ev_id""")
def _(t):
    refs = t.findings.select("run_id", F.col("finding_id").alias("owner_id"), F.array("evidence_id").alias("evidence_ids"))
    return joins.resolve_evidence(refs, t.evidence).select("owner_id", "ev_id", "file", "start_line", "confidence")


@query("traceability_problems", "J02", """select run_id, 'finding' as owner_kind, finding_id as owner_id, case when start_line = 7 then 'no evidence' else 'missing evidence' end as problem,
    case when start_line = 7 then null else evidence_id end as ev_id
  from v_findings f where start_line = 7 or not exists (select 1 from v_evidence e where e.run_id = f.run_id and e.ev_id = f.evidence_id)""")
def _(t):
    ids = F.when(F.col("start_line") == 7, F.array().cast("array<string>")).otherwise(F.array("evidence_id"))
    owners = t.findings.select("run_id", F.lit("finding").alias("owner_kind"), F.col("finding_id").alias("owner_id"), ids.alias("evidence_ids"))
    return joins.traceability_problems(owners, t.evidence)


_PY = "path like '%.py' and change_type <> 'deleted'"


@query("change_totals", "A24", f"""select run_id, cast(sum(case when {_PY} then added else 0 end) as bigint) as added, cast(sum(case when {_PY} then deleted else 0 end) as bigint) as deleted,
  count(*) filter ({_PY}) as python_files from v_changes group by run_id""")
def _(t):
    return aggs.change_totals(t.changes)


def _plan_sql(flag: dict[str, str], large: str, source: str) -> str:
    names = sorted([*flag, "large_diff"])
    sig = "concat_ws(',', " + ", ".join(f"case when py > 0 and {large if n == 'large_diff' else f'f_{n}'} then '{n}' end" for n in names) + ")"
    cnt = " + ".join(f"(case when py > 0 and {large if n == 'large_diff' else f'f_{n}'} then 1 else 0 end)" for n in names)
    cols = ", ".join(f"bool_or({e}) as f_{n}" for n, e in flag.items())
    mani = "bool_or(regexp_extract(path, '([^/]*)$', 1) in ('requirements.txt','setup.py','setup.cfg','pyproject.toml','Pipfile','poetry.lock'))"
    return f"""with c as (select run_id, count(*) filter ({_PY}) as py, sum(case when {_PY} then added + deleted else 0 end) as lines, {mani} as manifest, {cols} from {source} group by run_id),
      s as (select *, {sig} as signals, {cnt} as n from c)
      select run_id, concat_ws(',', 'git', case when py between 1 and 50 then 'python_ast' end, case when py > 0 then 'ruff' end, case when py > 0 and (n > 0 or lines > 100) then 'bandit' end, case when py > 0 and manifest then 'dependency' end) as analyzers,
        concat_ws(',', case when py > 50 then 'python_ast_skipped_large_diff' end, nullif(signals, ''), case when py > 0 and n = 0 and lines <= 100 then 'bandit_skipped_low_risk' end,
          case when py > 0 and manifest then 'dependency_change' end, case when py = 0 then 'no_python_changes' end) as reason_codes,
        case when n >= 3 then 'high' when n >= 1 then 'medium' else 'low' end as risk_level from s"""


def _any(column: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query("build_plans", "F19 F18 A24", _plan_sql({n: _any("lower(path)", w) for n, w in fixed.RISK_KEYWORDS.items()}, "lines > 500", "v_changes"))
def _(t):
    plans = aggs.build_plans(t.changes)
    return plans.withColumn("analyzers", F.array_join("analyzers", ",")).withColumn("reason_codes", F.array_join("reason_codes", ","))


_DOC_CHANGES = """select concat('chg_', doc_id // 7) as run_id, path, case when doc_id % 13 = 0 then 'deleted' else 'modified' end as change_type, cast(doc_id % 60 as int) as added, 1 as deleted, text from v_files"""


@query("build_plans_from_contents", "F19 F18", _plan_sql({
    n: f"({_PY} and ({_any('lower(text)', w)}" + (f" or {_any('lower(path)', w)}" if n == "dependency_change" else "") + "))"
    for n, w in fixed.RISK_KEYWORDS.items()}, "false", f"({_DOC_CHANGES})"))
def _(t):
    rows = t.files.selectExpr("concat('chg_', doc_id div 7) as run_id", "path", "case when doc_id % 13 = 0 then 'deleted' else 'modified' end as change_type",
                              "cast(doc_id % 60 as int) as added", "1 as deleted", "text")
    plans = aggs.build_plans(rows.drop("text"), rows.select("run_id", "path", "text"))
    return plans.withColumn("analyzers", F.array_join("analyzers", ",")).withColumn("reason_codes", F.array_join("reason_codes", ","))


@query("finding_errors", "F27", """select finding_id, case when message = 'flag A' then 'missing field ''location''' when f.start_line = 2 then 'missing field ''reason''' when tool = 'ruff' and f.start_line = 3 then 'missing field ''suggestion'''
    when e.ev_id is null then concat('evidence_id ''', f.evidence_id, ''' not found in pool') end as error
  from v_findings f left join v_evidence e on f.run_id = e.run_id and f.evidence_id = e.ev_id""")
def _(t):
    known = t.evidence.select("run_id", F.col("ev_id").alias("evidence_id"), F.lit(True).alias("known"))
    item = F.struct(F.when(F.col("message") != "flag A", F.col("file")).alias("location"), F.when(F.col("start_line") != 2, F.col("message")).alias("reason"),
                    F.when(~((F.col("tool") == "ruff") & (F.col("start_line") == 3)), F.col("message")).alias("suggestion"))
    rows = t.findings.join(known, ["run_id", "evidence_id"], "left")
    return rows.select("finding_id", review.first_finding_error(item, F.when(F.col("known").isNull(), F.col("evidence_id"))).alias("error"))
