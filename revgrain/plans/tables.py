"""The given tables, and the review, evidence and evaluation shapes derived from them.

Every shape has two texts: DataFrame expressions for Spark and one SQL text for the comparison side.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from revgrain.session import spread

_KEY = "concat('{}', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey)"
_FND, _EV = _KEY.format("fnd_"), _KEY.format("ev_")
_SEQ = "((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey"
_SEVERITY = """case when l_quantity >= 45 then 'critical' when l_quantity >= 35 then 'high'
  when l_quantity >= 20 then 'medium' when l_quantity >= 8 then 'low' else 'info' end"""
_VERDICT = """case when quality = 1 and toxic = 0 then 'correct' when quality = 1 then 'partially_correct'
  when toxic = 1 then 'incorrect' else 'unjudgeable' end"""
_PATH = """concat(case doc_id % 6 when 0 then 'src/app/' when 1 then 'tests/test_' when 2 then 'docs/'
  when 3 then 'examples/' when 4 then 'lib/' else 'conf/' end, 'm', doc_id,
  case doc_id % 6 when 2 then '.md' when 5 then '.toml' else '.py' end)"""
_MODULE = "concat('src/m', l_partkey % 40, '.py')"
_STEP_STATUS = """case event_type when 'error' then 'tool_error' when 'view' then 'success'
  when 'click' then 'no_evidence' else 'no_progress' end"""
_JOB_EVENT = """case event_id % 5 when 0 then 'queued' when 1 then 'running' when 2 then 'plan'
  when 3 then 'result' else 'end' end"""
_QTYPE = """case {} % 6 when 0 then 'locate' when 1 then 'grep' when 2 then 'explain' when 3 then 'trace'
  when 4 then 'impact' else 'compare' end"""
_SLOT = """case {} % 5 when 0 then 'definition' when 1 then 'implementation' when 2 then 'verified_caller_edge'
  when 3 then 'verified_callee_edge' else 'candidate_reference' end"""
_SOURCE = """case {} % 5 when 0 then 'resolve_symbol' when 1 then 'read_window' when 2 then 'verify_callsite'
  when 3 then 'verify_callees' else 'search_references' end"""



def _bits(column: str, words: list[str]) -> str:
    """Comma list of the words whose bit is set in the column; the modulo form reads the same on both engines."""
    parts = ", ".join(f"case when {column} % {2 << i} >= {1 << i} then ',{w}' else '' end" for i, w in enumerate(words))
    return f"substr(concat({parts}), 2)"


# name -> (table, filter, columns)
SHAPES: dict[str, tuple[str, str, dict[str, str]]] = {
    "v_files": ("documents", "true", {"doc_id": "doc_id", "path": _PATH, "text": "text"}),
    "v_findings": ("lineitem", "true", {
        "run_id": "concat('run_', l_orderkey % 20)", "finding_id": _FND,
        "tool": "case when l_linestatus = 'O' then 'ruff' else 'bandit' end",
        "rule_id": "concat('R', l_suppkey % 15)", "message": "concat('flag ', l_returnflag)",
        "severity": _SEVERITY, "file": _MODULE, "start_line": "l_linenumber", "evidence_id": _EV, "seq": _FND,
    }),
    "v_evidence": ("lineitem", "l_discount >= 0.02", {
        "run_id": "concat('run_', l_orderkey % 20)", "ev_id": _EV, "file": _MODULE, "start_line": "l_linenumber",
        "end_line": "l_linenumber + 2", "confidence": "round(1 - l_discount, 2)",
        "source": _SOURCE.format("l_suppkey"), "symbol": "concat('sym', l_partkey % 40)",
        "snippet": "concat('def sym', l_partkey % 40, '(x): call', l_suppkey % 7, '(y) ', l_returnflag)",
    }),
    "v_answers": ("lineitem", "true", {
        "sample_id": "l_orderkey",
        "answer_part": "concat('see src/m', l_partkey % 40, '.py:', l_linenumber + l_suppkey % 4, ' done')",
    }),
    "v_citing_evidence": ("lineitem", "l_discount >= 0.02", {
        "sample_id": "l_orderkey", "file": _MODULE, "start_line": "l_linenumber", "end_line": "l_linenumber + 1",
    }),
    "v_judgments": ("labels", "true", {
        "sample_id": "doc_id", "verdict": _VERDICT,
        "judge_error_type": "case when doc_id % 11 = 0 then 'judge_unavailable' else null end",
        "uses_supported_evidence": "quality = 1",
    }),
    "v_chains": ("conversations", "true", {
        "follow_up_group": "concat('g', conv_id)", "seq": "turn", "is_follow_up": "turn > 0",
        "step_count": "length(text) % 9", "sample_id": "concat(conv_id, '-', turn)",
    }),
    "v_steps": ("events", "true", {
        "sample_id": "user_id", "step_no": "event_id", "status": _STEP_STATUS, "duration_ms": "value", "ts": "ts",
    }),
    "v_job_events": ("events", "true", {
        "job_id": "concat('job_', user_id)", "seq": "event_id", "ts": "ts", "event": _JOB_EVENT, "data": "value",
    }),
    # One changed file per order line: a change set is an order.
    "v_changes": ("lineitem", "true", {
        "run_id": "concat('chg_', l_orderkey)",
        "path": """concat(case l_suppkey % 8 when 0 then 'app/auth_login' when 1 then 'db/sql_store' when 2 then 'core/job'
  when 3 then 'web/view' when 4 then 'requirements' when 5 then 'docs/note' when 6 then 'util/pickle_io' else 'api/main' end,
  l_partkey % 40, case l_suppkey % 8 when 4 then '.txt' when 5 then '.md' else '.py' end)""",
        "change_type": "case when l_linestatus = 'O' and l_linenumber = 1 then 'deleted' when l_linenumber % 3 = 0 then 'added' else 'modified' end",
        "added": "cast(l_quantity as int)", "deleted": "cast(l_quantity as int) % 7",
    }),
    # Evaluation samples: one per order, with the order's lines as its plan.
    "v_samples": ("orders", "true", {
        "sample_id": "o_orderkey", "group_id": "concat('grp_', o_custkey)",
        "question_type": _QTYPE.format("o_orderkey"), "risk_level":
        "case o_orderstatus when 'F' then 'high' when 'O' then 'medium' else 'low' end",
        "language": "case o_custkey % 4 when 0 then 'python' when 1 then 'javascript' when 2 then 'typescript' else 'go' end",
        "change_type": "case o_orderkey % 3 when 0 then 'feature' when 1 then 'bugfix' else 'refactor' end",
        "files": "o_custkey % 60", "lines": "cast(floor(o_totalprice) as bigint) % 900", "seq": "o_orderkey",
    }),
    # Diff texts: one per order, two files each; names and counts come from the order.
    "v_diffs": ("orders", "true", {
        "repo_id": "concat('repo_', o_custkey % 30)", "base": "concat('b', o_orderkey)", "head": "concat('h', o_orderkey)",
        "name_status": """concat('M', chr(9), 'src/m', o_custkey % 40, '.py', chr(10), case o_orderkey % 4
  when 0 then concat('A', chr(9), 'docs/n', o_orderkey % 9, '.md') when 1 then concat('D', chr(9), 'old', o_orderkey % 9, '.py')
  when 2 then concat('R087', chr(9), 'lib/a', o_orderkey % 9, '.py', chr(9), 'lib/b', o_orderkey % 9, '.py')
  else concat('C100', chr(9), 'x.py', chr(9), 'y', o_orderkey % 9, '.py') end, chr(10))""",
        "numstat": """concat(o_orderkey % 70, chr(9), o_custkey % 30, chr(9), 'src/m', o_custkey % 40, '.py', chr(10), case o_orderkey % 4
  when 0 then concat('-', chr(9), '-', chr(9), 'docs/n', o_orderkey % 9, '.md') when 1 then concat('0', chr(9), o_custkey % 50, chr(9), 'old', o_orderkey % 9, '.py')
  when 2 then concat('3', chr(9), '1', chr(9), 'lib/{a', o_orderkey % 9, '.py => b', o_orderkey % 9, '.py}')
  else concat('x', chr(9), '2', chr(9), 'y', o_orderkey % 9, '.py') end, chr(10))""",
        "diff": """concat('diff --git a/src/m', o_custkey % 40, '.py b/src/m', o_custkey % 40, '.py', chr(10), '--- a', chr(10), '@@ -', o_orderkey % 90 + 1,
  case when o_orderkey % 3 = 0 then '' else ',5' end, ' +', o_custkey % 80 + 1, ',6 @@ def f', chr(10), '+x = 1', chr(10),
  '@@ -200,7 +', o_custkey % 50 + 200, ' @@', chr(10), '-y', chr(10), 'diff --git a/lib/n', o_orderkey % 9, '.py b/lib/n', o_orderkey % 9, '.py', chr(10),
  '@@ -1 +1,', o_orderkey % 20, ' @@', chr(10), '+', o_orderpriority, chr(10))""",
    }),
    # Lint reports: one JSON text per order.
    "v_reports": ("orders", "true", {
        "run_id": "concat('run_', o_orderkey)",
        "ruff": """concat('[{"filename": "src/m', o_custkey % 40, '.py", "code": "F', o_orderkey % 900, '", "message": "', o_orderpriority,
  '", "location": {"row": ', o_orderkey % 90 + 1, ', "column": 1}, "end_location": {"row": ', o_orderkey % 90 + 2, '}}, {"filename": "b.py", "code": "E501", "message": "long"}]')""",
        "bandit": """concat('{"results": [{"filename": "src/m', o_custkey % 40, '.py", "test_id": "', case when o_orderkey % 2 = 0 then 'B' else '' end, o_orderkey % 700,
  '", "issue_severity": "', case o_orderkey % 4 when 0 then 'LOW' when 1 then 'MEDIUM' when 2 then 'HIGH' else 'UNDEFINED' end,
  '", "issue_text": "', o_orderpriority, '", "line_number": ', o_orderkey % 90 + 1, '}]}')""",
    }),
    # Plans: predicted and true analyzer and reason sets, as comma lists built from the bits of the order's keys.
    "v_plans": ("orders", "true", {
        "sample_id": "o_orderkey",
        "predicted": _bits("o_custkey", ["git", "python_ast", "ruff", "bandit", "dependency"]),
        "truth": _bits("o_orderkey", ["git", "python_ast", "ruff", "bandit", "dependency"]),
        "predicted_reasons": _bits("o_custkey", ["sql_risk", "large_diff", "auth_change"]),
        "true_reasons": _bits("o_orderkey", ["large_diff", "sql_risk", "auth_change", "no_python_changes"]),
        "risk_level": "case o_custkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end",
        "true_risk_level": "case o_orderkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end",
    }),
    # Investigation records: one per order; answers and expectations from its keys.
    "v_records": ("orders", "true", {
        "sample_id": "o_orderkey", "seq": "o_orderkey", "question_type": _QTYPE.format("o_orderkey"),
        "is_follow_up": "o_custkey % 4 = 0", "follow_up_group": "case when o_custkey % 3 = 0 then '' else concat('g', o_custkey % 500) end",
        "step_count": "cast(o_orderkey % 7 as int)", "answer": "concat('Order Goes to src/m', o_custkey % 40, '.py:', o_orderkey % 9, ' ', o_orderpriority)",
        "expected_words": """case o_orderkey % 4 when 0 then 'goes' when 1 then 'goes,urgent' when 2 then 'order,low' else '' end""",
        "expected_file": "case when o_orderkey % 5 = 0 then null else concat('src/m', o_custkey % 37, '.py') end",
        "verdict": """case o_custkey % 5 when 0 then 'correct' when 1 then 'partially_correct' when 2 then 'incorrect' when 3 then 'unjudgeable' else 'correct' end""",
        "judge_error_type": "case when o_custkey % 11 = 0 then 'judge_unavailable' when o_custkey % 13 = 0 then 'judge_invalid_schema' else null end",
        "trace": """case o_orderkey % 7 when 0 then 'fallback: grep' when 1 then 'budget: GAP exhausted' when 2 then 'budget_exhausted: tokens'
  when 3 then 'tool_error: read' when 4 then 'budget: MAIN exhausted' else 'ok' end""",
        "status": "case o_custkey % 9 when 0 then 'budget_exhausted' when 1 then 'failed' else 'success' end",
        "action": "case o_custkey % 2 when 0 then 'MAIN' else 'RETOOL' end",
        "decision": "case o_custkey % 17 when 0 then 'STOP_FILE_LIMIT' when 1 then 'BUDGET' else 'CONTINUE' end",
        "final_status": "case o_orderkey % 19 when 0 then 'STOP_STEP_LIMIT' else 'DONE' end",
        "project": "case o_custkey % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end",
    }),
    # Issue verdicts: one per order line, at the line's place in its order.
    "v_verdicts": ("lineitem", "true", {
        "sample_id": "l_orderkey", "issue_index": "l_linenumber - 1", "verdict":
        "case when l_tax < 0.03 then 'false_positive' when l_tax > 0.06 then 'uncertain' else 'correct' end", "ev_id": _EV,
    }),
    "v_missed": ("lineitem", "l_returnflag = 'R'", {"sample_id": "l_orderkey", "severity": _SEVERITY}),
    "v_sample_state": ("orders", "true", {
        "sample_id": "o_orderkey", "pipeline_error": "case when o_custkey % 23 = 0 then 'clone failed' else null end",
        "issue_count": "o_orderkey % 4", "has_judgment": "o_custkey % 7 <> 0",
        "judgment_error": "case when o_custkey % 10 = 0 then 'parse' else null end",
        "risk_level": "case o_custkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end",
    }),
    # Task evidence: one row per order line, a task per (order, symbol).
    "v_task_evidence": ("lineitem", "true", {
        "query_id": "l_orderkey", "task_id": "concat('task_', l_partkey % 40)", "target": "concat('app.sym', l_partkey % 40)",
        "ev_id": _EV, "seq": _SEQ, "source": _SOURCE.format("l_suppkey"), "file": _MODULE, "start_line": "l_linenumber",
        "snippet": "concat('def sym', l_suppkey % 40, '(x): call', l_suppkey % 7, '(y)')", "ok": "l_discount >= 0.02",
    }),
    # Judged evidence: samples of about twenty rows, so that some are cut and some are not.
    "v_judged_evidence": ("lineitem", "true", {
        "sample_id": "l_partkey % 3000", "ev_id": _EV, "seq": _SEQ, "confidence": "round(1 - l_discount, 2)",
        "is_cited": "l_linenumber = 1", "is_expected": "l_suppkey % 3 > 0",
    }),
    # Python files: one per part. Every seventeenth does not parse.
    "v_code": ("part", "true", {
        "path": "concat('src/pkg/m', p_partkey, '.py')", "k": "p_partkey", "broken": "p_partkey % 17 = 0",
        "text": """concat('import os, requests', chr(10), 'from pkg.m', p_partkey + 1, ' import C', p_partkey + 1, ' as Next', chr(10), 'from .m', p_partkey + 2, ' import Next as Far', chr(10),
  'class C', p_partkey, '(Base):', chr(10), '    def run(self):', chr(10), '        self.save(', p_size, ')', chr(10), '        super().run()', chr(10), '        return helper', p_partkey % 10, '(1)', chr(10),
  '    async def save(self, x):', chr(10), '        x.items.put(str(x))', chr(10), 'def helper', p_partkey % 10, '(y):', chr(10), '    return y', chr(10), '@app.get("/items/', p_partkey, '")', chr(10),
  'def route', p_partkey, '():', chr(10), '    return Next().run(', case when p_partkey % 17 = 0 then '' else ')' end, chr(10))""",
    }),
    # Questions: one per order, in the wordings the planner rules tell apart.
    "v_questions": ("orders", "true", {
        "query_id": "o_orderkey",
        "question": """concat(case o_orderkey % 12 when 0 then 'where is ' when 1 then 'list every use of ' when 2 then 'what does '
  when 3 then 'who calls ' when 4 then 'what breaks if I change ' when 5 then 'compare ' when 6 then 'API endpoint for '
  when 7 then 'find ' when 8 then 'explain purpose of ' when 9 then 'which module imports ' when 10 then '接口在哪里 ' else 'show ' end,
  case o_custkey % 6 when 0 then concat('"Order', o_custkey % 50, '.load_', o_custkey % 7, '"') when 1 then concat('Cust', o_custkey % 50, '.find_all')
  when 2 then concat('load_row', o_custkey % 9, ' and save_row_x') when 3 then concat('Store::', 'put', o_custkey % 30)
  when 4 then 'the function class' else concat('"part.size_', o_custkey % 5, '" or "Line', o_custkey % 11, '"') end,
  case o_orderkey % 5 when 0 then ' defined' when 1 then ' do' when 2 then ' in pipeline' when 3 then '' else ' diff' end)""",
        "target": """case o_custkey % 9 when 0 then '@cached' when 1 then 'try:' when 2 then 'os.path.join' when 3 then concat('app.Model', o_custkey % 40)
  when 4 then concat('Model', o_custkey % 40, '.save') when 5 then 'Evidence' when 6 then concat('load_', o_custkey % 40) when 7 then 'two words' else '  ' end""",
    }),
    # Contract targets: one slot row per order line.
    "v_target_slots": ("lineitem", "true", {
        "query_id": "l_orderkey", "question_type": _QTYPE.format("l_orderkey"),
        "symbol": "concat('sym', l_partkey % 40)", "slot": _SLOT.format("l_suppkey"),
        "has_evidence": "l_discount >= 0.05", "verified": "l_tax >= 0.04", "blocked": "l_quantity >= 48",
        "ev_id": _EV, "seq": _FND,
    }),
}


def shape_sql(name: str) -> str:
    table, where, columns = SHAPES[name]
    body = ", ".join(f"{expr} as {alias}" for alias, expr in columns.items())
    return f"select {body} from {table} where {where}"


_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
SQL_VIEWS: dict[str, str] = {name: shape_sql(name) for name in SHAPES}
SQL_VIEWS["v_text_lines"] = f"""select doc_id, path, case when parts[-1] = '' then parts[:-2] else parts end as parts
  from (select doc_id, path, regexp_split_to_array(text, '{_BREAKS}') as parts from v_files)"""
SQL_VIEWS["v_lines"] = """select doc_id, path, i as line_no, parts[i] as line
  from (select doc_id, path, parts, unnest(range(1, len(parts) + 1)) as i from v_text_lines)"""


def with_views(sql: str) -> str:
    """Prefix a SQL text with the views it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+\b", text)):
            if name in SQL_VIEWS and name not in needed:
                visit(SQL_VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{n} as ({SQL_VIEWS[n]})" for n in needed)
    opening = re.match(r"(?i)\s*with (recursive )?", sql)
    return f"{opening[0]}{ctes}, {sql[opening.end():]}" if opening else f"with {ctes} {sql}"


class Tables:
    """Reads ``{sf_dir}/{table}.parquet`` on attribute access, and the derived shapes as ``shape(name)``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def shape(self, name: str) -> DataFrame:
        table, where, columns = SHAPES[name]
        return self.read(table).where(where).selectExpr(*[f"{expr} as {alias}" for alias, expr in columns.items()])

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.read("documents"), "doc_id")

    @cached_property
    def files(self) -> DataFrame:
        _, _, columns = SHAPES["v_files"]
        return self.documents.selectExpr(*[f"{expr} as {alias}" for alias, expr in columns.items()])

    @cached_property
    def code(self) -> DataFrame:
        return spread(self.shape("v_code"), "path")

    @cached_property
    def lines(self) -> DataFrame:
        from revgrain.sources.corpus import explode_lines

        return explode_lines(self.files, keep=["doc_id", "path"])

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        view = f"v_{name}"
        return self.shape(view) if view in SHAPES else self.read(name)


def clock(c: str = "ts"):
    """Microseconds of a zone-free timestamp, independent of the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")
