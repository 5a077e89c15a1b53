"""Column functions and filters, run over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from revgrain import fixed
from revgrain.functions import paths, questions, review, search, text
from revgrain.functions.patterns import python_strip
from revgrain.operators import filters
from revgrain.plans.registry import query
from revgrain.plans.search_plans import CLASSED, EDGE_L, EDGE_R, TYPE_SCORE_SQL
from revgrain.sources import corpus


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


@query("exclude_dirs", "S02", f"""select doc_id, path from v_files
  where len(list_filter(string_split(lower(path), '/'), lambda s: s in {_in(fixed.NON_PRODUCTION_DIRS)})) = 0
    and len(list_filter(string_split(path, '/'), lambda s: starts_with(s, '.') or s = '__pycache__')) = 0""")
def _(t):
    return corpus.exclude_dirs(t.files, fixed.NON_PRODUCTION_DIRS, hidden=True).select("doc_id", "path")


@query("explode_lines", "S03", "select doc_id, path, cast(line_no as int) as line_no, line from v_lines")
def _(t):
    return t.lines


@query("classify_file", "F01 F02", f"""select doc_id, path, file_type, cast({TYPE_SCORE_SQL} as int) as type_score
  from ({CLASSED.format(source='v_files')})""")
def _(t):
    kind = paths.classify_file("path")
    return t.files.select("doc_id", "path", kind.alias("file_type"), paths.file_type_score(kind).alias("type_score"))


@query("classify_page_url", "F01", f"""select page_id, file_type from (
  {CLASSED.format(source="(select page_id, regexp_replace(url, '^[a-z]+://', '') as path from pages)")})""")
def _(t):
    return t.pages.select("page_id", paths.classify_file(F.regexp_replace("url", "^[a-z]+://", "")).alias("file_type"))


@query("changed_python", "P01", """select run_id, path, change_type, added, deleted from v_changes
  where path like '%.py' and change_type <> 'deleted'""")
def _(t):
    return filters.changed_python(t.changes)


@query("reviewable", "P02", """select run_id, path from v_changes
  where regexp_matches(path, '\\.(py|jsx?|tsx?|java|go|rb|php|json|ya?ml|toml|cfg|ini)$')""")
def _(t):
    return filters.reviewable(t.changes).select("run_id", "path")


@query("match_pathspec", "P03", """select run_id, path from v_changes
  where path glob 'app/*' or path glob '*note1*.md' or path = 'db' or starts_with(path, 'db/')""")
def _(t):
    return filters.match_pathspec(t.changes, ["app/*", "*note1*.md", "db"]).select("run_id", "path")


@query("grep_lines", "P04", """select doc_id, cast(line_no as int) as line_no,
    left(regexp_replace(line, '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '', 'g'), 200) as snippet from v_lines
  where (contains(lower(line), 'license') or regexp_matches(line, '(?i)data[a-z]+ing'))""")
def _(t):
    return filters.grep(t.lines, ["license", "data[a-z]+ing"]).select("doc_id", "line_no", "snippet")


@query("reference_predicate", "P05", f"""select doc_id, cast(line_no as int) as line_no, kind from (
  select doc_id, line_no, line, 'callers' as kind from v_lines where regexp_matches(line, '{EDGE_L}data[\\s]*\\(')
  union all select doc_id, line_no, line, 'references' from v_lines where regexp_matches(line, '{EDGE_L}from{EDGE_R}')
  union all select doc_id, line_no, line, 'literal' from v_lines where contains(line, 'e.g.')
  union all select doc_id, line_no, line, 'decorator' from v_lines where regexp_matches(line, '@example{EDGE_R}'))""")
def _(t):
    wanted = [("callers", "io.data", "callers"), ("references", "from", "references"), ("literal", "e.g.", "literal"),
              ("decorator", "@example", "references")]
    found = F.array_compact(F.array(*[
        F.when(filters.reference_match(F.col("line"), term, kind), F.lit(name)) for name, term, kind in wanted]))
    return t.lines.select("doc_id", "line_no", F.explode(found).alias("kind"))


@query("valid_judgments", "P06", "select sample_id, verdict from v_judgments where judge_error_type is null")
def _(t):
    return filters.valid_judgments(t.judgments).select("sample_id", "verdict")


_ORDERED = """select ev_id, source, snippet, file, symbol, symbol as target,
  case when start_line = 3 then concat('pkg.', symbol) when start_line = 5 then 'other' else '' end as counterpart from v_evidence"""


@query("split_verified", "P07", f"""select ev_id, reason is null as ok, reason from (select ev_id, case
    when source = 'verify_callsite' then case when not regexp_matches(snippet, concat('\\b', target, '\\s*\\('))
      or regexp_matches(snippet, concat('\\bdef\\s+', target, '\\s*\\(')) then concat('no call expression for ', target) end
    when source = 'verify_callees' and counterpart <> '' and not (symbol = counterpart or counterpart like concat('%.', symbol)
      or symbol like concat('%.', counterpart)) then concat('verified ', symbol, ', expected directed callee ', counterpart) end as reason
  from ({_ORDERED}))""")
def _(t):
    ordered = t.evidence.select(
        "ev_id", "source", "snippet", "file", "symbol", F.col("symbol").alias("target"),
        F.when(F.col("start_line") == 3, F.concat(F.lit("pkg."), "symbol")).when(F.col("start_line") == 5, "other")
        .otherwise("").alias("counterpart"))
    return filters.judge_evidence(ordered).select("ev_id", "ok", "reason")


@query("verify_slots", "P08 P09 P10 P11", """with d as (select symbol, min(file) as def_file, min(start_line) as def_line from v_evidence
    where source = 'resolve_symbol' group by symbol)
  select ev_id, source = 'resolve_symbol' or (source in ('read_window', 'search_references')
      and regexp_matches(lower(snippet), concat('\\b(?:class|def)\\s+', lower(symbol), '\\b'))) as definition_ok,
    regexp_matches(snippet, concat('\\b(?:async\\s+def|def|class)\\s+', symbol, '\\b')) as implementation_ok,
    not coalesce(file = def_file and abs(start_line - def_line) <= 2, false) and regexp_matches(snippet, concat('\\b', symbol, '\\s*\\('))
      and not regexp_matches(snippet, concat('\\bdef\\s+', symbol, '\\s*\\(')) as caller_ok,
    trim(symbol) <> '' as callee_ok, true as reference_ok
  from (select ev_id, source, file, start_line, symbol, case when start_line % 2 = 0 then replace(snippet, 'def ', '') else snippet end as snippet
    from v_evidence) e left join d using (symbol)""")
def _(t):
    ev = t.evidence.withColumn(
        "snippet", F.when(F.col("start_line") % 2 == 0, F.replace("snippet", F.lit("def "), F.lit(""))).otherwise(F.col("snippet")))
    defs = ev.where("source = 'resolve_symbol'").groupBy("symbol").agg(
        F.min("file").alias("def_file"), F.min("start_line").alias("def_line"))
    return filters.verify_slots(ev, defs).select(
        "ev_id", "definition_ok", "implementation_ok", "caller_ok", "callee_ok", "reference_ok")


@query("blank_summaries", "P12", "select sample_id from (select o_orderkey as sample_id, case when o_orderkey % 7 = 0 then '  ' when o_orderkey % 7 = 1 then null else o_orderpriority end as summary from orders) where trim(coalesce(summary, '')) = ''")
def _(t):
    samples = t.orders.select(F.col("o_orderkey").alias("sample_id"), F.expr(
        "case when o_orderkey % 7 = 0 then '  ' when o_orderkey % 7 = 1 then null else o_orderpriority end").alias("summary"))
    return filters.blank_summaries(samples).select("sample_id")


@query("edge_case_samples", "P13", "select sample_id, files from v_samples where files = 0 or files > 50")
def _(t):
    return filters.edge_cases(t.samples).select("sample_id", "files")


@query("hit_scores", "F02 F03 F06", """with l as (select doc_id, line_no, trim(line, ' ') as line from v_lines where regexp_matches(line, '(class|def|function|import|from|enum|interface)')),
  h as (select doc_id, line_no, regexp_extract(regexp_replace(line, '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '', 'g'), '(?:(?:class|def|async\\s+def)\\s+|\\bfn\\s+|\\bfunc\\s+(?:\\s*\\([^)]*\\)\\s+)?|\\bfunction\\s+|\\b(?:public|private|protected)?\\s*(?:static\\s+)?(?:class|interface|enum)\\s+)([\\p{L}\\p{N}\\p{M}_]+)', 1) as d,
    regexp_replace(line, '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', '') as s from l)
  select doc_id, cast(line_no as int) as line_no, nullif(d, '') as defined_name,
    case when regexp_matches(s, '^(#|//|--)') then 'comment' when lower(d) in ('of', 'the') then 'definition' when regexp_matches(s, '^(import |from )') then 'import'
      when contains(s, '(') then 'call' else 'reference' end as hit_type from h""")
def _(t):
    marked = t.lines.where(F.col("line").rlike("(class|def|function|import|from|enum|interface)")).withColumn("line", python_strip("line"))
    return marked.select("doc_id", "line_no", search.defined_name("line").alias("defined_name"),
                         search.classify_hit("line", ["of", "the"]).alias("hit_type"))


@query("match_precision", "F04 F05", f"""select doc_id, cast(line_no as int) as line_no,
    case when not contains(lower(line), 'data') then 0 when regexp_matches(line, '{EDGE_L}data{EDGE_R}') then 300
      when regexp_matches(line, '(?i){EDGE_L}data{EDGE_R}') then 250 else 50 end as match_score,
    (case when contains(lower(line), 'data') then 50 else 0 end) + (case when contains(lower(line), 'the') then 50 else 0 end) as coverage,
    concat_ws(',', case when contains(lower(line), 'data') then 'data' end, case when contains(lower(line), 'the') then 'the' end) as terms
  from v_lines""")
def _(t):
    return t.lines.select(
        "doc_id", "line_no", search.match_precision("line", ["data"]).alias("match_score"),
        search.query_coverage("line", ["data", "the"]).alias("coverage"),
        F.array_join(search.matched_terms("line", ["data", "the"]), ",").alias("terms"))


@query("evidence_ids", "F07 F08", """select ev_id, replace(concat('C:\\', file), '\\', '/') as path,
  concat('ev_', left(md5(concat('HEAD|', file, '|', start_line, '|', end_line, '|', snippet)), 8)) as content_id from v_evidence""")
def _(t):
    return t.evidence.select(
        "ev_id", paths.norm_path(F.concat(F.lit("C:\\"), "file")).alias("path"),
        text.content_id("HEAD", F.col("file"), F.col("start_line"), F.col("end_line"), F.col("snippet")).alias("content_id"))


_PARAMS_SQL = """concat('{"change_type": "', change_type, '", "files": ', files, ', "language": "', language, '", "lines": ', lines, '}')"""


@query("sample_ids", "F09", f"""select sample_id, concat('r', files, '_', lines, '_', left(language, 4), '_', left(md5({_PARAMS_SQL}), 6)) as stable_id from v_samples""")
def _(t):
    canonical = F.concat(F.lit('{"change_type": "'), "change_type", F.lit('", "files": '), F.col("files").cast("string"),
                         F.lit(', "language": "'), "language", F.lit('", "lines": '), F.col("lines").cast("string"), F.lit("}"))
    return t.samples.select(
        "sample_id", text.sample_id(F.col("files"), F.col("lines"), F.col("language"), canonical).alias("stable_id"))


@query("citations", "F10 F12", r"""select sample_id, answer_part, split_part(r, ':', 1) as file, cast(split_part(r, ':', 2) as bigint) as line, true as traceable
  from (select sample_id, answer_part, unnest(regexp_extract_all(answer_part, '[\w./-]+\.[\w]+:\d+')) as r from v_answers)""")
def _(t):
    return t.answers.select(
        "sample_id", "answer_part", F.inline(text.citations("answer_part")),
        ).withColumn("traceable", text.has_citation("answer_part"))


@query("has_citation", "F12", r"""select conv_id, turn, regexp_matches(replace(text, '\', '/'), '[\w./-]+\.\w+:\d+')
  or regexp_matches(replace(text, '\', '/'), '[\w./-]+\.\w+.*?line\s*\d+') as traceable from conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", text.has_citation("text").alias("traceable"))


@query("claim_keywords", "F13", r"""select conv_id, turn, array_to_string(list_filter(k, lambda w: length(w) >= 2 and not regexp_matches(w, '^\p{Nd}+$')), ' ') as keywords
  from (select conv_id, turn, list_transform(list_filter(list_zip(p, range(1, len(p) + 1)), lambda z: list_position(p, z[1]) = z[2]), lambda z: z[1]) as k
    from (select conv_id, turn, regexp_split_to_array(text, '[，。！？、：；"（）()\[\]【】\s\x0b\x1c-\x1f\x{85}\p{Z}]+') as p from conversations))""")
def _(t):
    return t.conversations.select("conv_id", "turn", F.array_join(text.claim_keywords("text"), " ").alias("keywords"))


_STOP = _in(fixed.KEYWORD_STOP_WORDS + fixed.GENERIC_TERMS)
_TIER_SQL = """list_filter(list_transform({found}, lambda w: (case when not regexp_matches(m(w), '^[A-Za-z_][A-Za-z0-9_]*$') then null
  when lower(m(w)) in {stop} then null when contains(c(w), '.') or (contains(c(w), '::')) then c(w) else m(w) end)), lambda x: x is not null)"""


def _tier(found: str) -> str:
    import re

    def clean(w: str) -> str:
        return f"trim({w}, '`''\"()[]{{}} ')"

    def member(w: str) -> str:
        return f"regexp_extract({clean(w)}, '([^.:]*)$', 1)"

    body = _TIER_SQL.format(found=found, stop=_STOP)
    body = re.sub(r"\bm\(w\)", lambda _: member("w"), body)
    return re.sub(r"\bc\(w\)", lambda _: clean("w"), body)


@query("question_keywords", "F14", f"""with q as (select query_id,
    {_tier("regexp_extract_all(question, '[\"'']([^\"'']+)[\"'']', 1)")} as t1,
    {_tier("regexp_extract_all(question, '\\b([A-Z][a-zA-Z0-9_]*\\.[a-z_][a-zA-Z0-9_]*)\\b', 1)")} as t2,
    {_tier("regexp_extract_all(question, '\\b([A-Z][a-zA-Z0-9_]*|[a-z]+_[a-z_]+|[a-z][a-z0-9_]{2,})\\b', 1)")} as t3,
    {_tier("regexp_extract_all(question, '[a-zA-Z_][a-zA-Z0-9_]{2,}')")} as t4 from v_questions),
  p as (select query_id, case when len(t1) > 0 then t1 when len(t2) > 0 then t2 when len(t3) > 0 then t3 else t4 end as k from q)
  select query_id, array_to_string(list_slice(list_transform(list_filter(list_zip(k, range(1, len(k) + 1)), lambda z: list_position(k, z[1]) = z[2]), lambda z: z[1]), 1, 3), ',') as keywords from p""")
def _(t):
    words = F.transform(questions.question_keywords("question"), lambda w: w["symbol"])
    return t.questions.select("query_id", F.array_join(words, ",").alias("keywords"))


def _case(patterns, default) -> str:
    return "case " + " ".join(f"when regexp_matches(lower(q), '{p}') then '{n}'" for n, p in patterns) + f" else '{default}' end"


_REQ_SQL = "list_filter([" + ", ".join(
    f"case when regexp_matches(lower(q), '{p}') then '{n}' end" for names, p in fixed.REQUIREMENT_PATTERNS for n in names
) + "], lambda r: r is not null)"
_FIRST_TYPE = "case first_req " + " ".join(f"when '{k}' then '{v}'" for k, v in fixed.REQUIREMENT_TYPE.items()) + " else 'locate' end"
_FIRST_REL = "case first_req " + " ".join(f"when '{k}' then '{v}'" for k, v in fixed.REQUIREMENT_RELATION.items()) + " end"


def _question_sql(key: str, table: str, column: str) -> str:
    return f"""select {key}, question_type, array_to_string(r, ',') as requirements, {_FIRST_TYPE} as fallback_type, {_FIRST_REL} as relation_type, structural
      from (select *, r[1] as first_req from (select {key}, {_case(fixed.QUESTION_TYPE_PATTERNS, 'locate')} as question_type,
        case when len({_REQ_SQL}) = 0 then ['LOCATE_SYMBOL'] else {_REQ_SQL} end as r,
        {' or '.join(f"contains(lower(q), '{w}')" for w in fixed.STRUCTURE_WORDS)} as structural
        from (select {key}, {column} as q from {table})))"""


def _question_rows(df, keys, column):
    return df.select(
        *keys, questions.question_type(column).alias("question_type"),
        F.array_join(questions.requirements(column), ",").alias("requirements"),
        questions.fallback_type(column).alias("fallback_type"), questions.relation_type(column).alias("relation_type"),
        questions.is_structural(column).alias("structural"))


@query("question_types", "F15 F34", _question_sql("query_id", "v_questions", "question"))
def _(t):
    return _question_rows(t.questions, ["query_id"], "question")


@query("conversation_question_types", "F15 F34", _question_sql("conv_id, turn", "conversations", "text"))
def _(t):
    return _question_rows(t.conversations, ["conv_id", "turn"], "text")


@query("classify_targets", "F16 F17", f"""select query_id, kind, owner, member,
    case when kind in ('symbol', 'member') then 20 when kind = 'module' then 30 else 15 end as max_files,
    case when kind in ('symbol', 'member') then 50 when kind = 'module' then 60 else 30 end as max_total
  from (select query_id, k as kind, case k when 'decorator' then ltrim(s, '@') when 'syntax_pattern' then rtrim(s, ':')
      when 'member' then regexp_extract(s, '^(.*)\\.', 1) else s end as owner, case when k = 'member' then regexp_extract(s, '([^.]*)$', 1) else '' end as member
    from (select query_id, s, case when s = '' then 'text_pattern' when s like '@%' then 'decorator' when rtrim(s, ':') in {_in(fixed.SYNTAX_WORDS)} then 'syntax_pattern'
      when s in {_in(fixed.KNOWN_MODULES)} or len(list_filter({list(fixed.KNOWN_MODULES)}, lambda m: starts_with(s, concat(m, '.')))) > 0 then 'module'
      when contains(s, '.') and regexp_matches(s, '\\._*[A-Z]\\w*$') then 'symbol' when contains(s, '.') then 'member'
      when regexp_matches(s, '^_*[A-Z]\\w*$') or regexp_matches(s, '^[a-z_]\\w*$') then 'symbol' else 'text_pattern' end as k
      from (select query_id, trim(target) as s from v_questions)))""")
def _(t):
    named = t.questions.select("query_id", questions.classify_target("target").alias("c")).select("query_id", "c.*")
    scope = questions.scope_for("kind")
    return named.select("query_id", "kind", "owner", "member", scope["max_files"].alias("max_files"), scope["max_total"].alias("max_total"))


_SIGNALS = sorted(fixed.RISK_KEYWORDS.items())


@query("content_risk_signals", "F18", "select doc_id, concat_ws(',', " + ", ".join(
    "case when " + " or ".join([f"contains(lower(text), '{w}')" for w in ws]
    + ([f"contains(lower(path), '{w}')" for w in ws] if n == "dependency_change" else [])) + f" then '{n}' end" for n, ws in _SIGNALS) + ") as signals from v_files")
def _(t):
    return t.files.select("doc_id", F.array_join(review.content_signals("path", "text"), ",").alias("signals"))


@query("severity_functions", "F22 F23 F24 F38 F33", """select finding_id, case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end as rank,
    case when start_line * 0.2 < 0.6 then 'info' else severity end as shown,
    case when tool = 'ruff' then 'OK' when rule_id = 'R3' then 'SKIP' else 'FAIL' end as status_label,
    case upper(severity) when 'LOW' then 'low' when 'MEDIUM' then 'medium' when 'HIGH' then 'high' else 'info' end as scanner_severity,
    cast(greatest(1, length(finding_id) // 4) as bigint) as tokens from v_findings""")
def _(t):
    status = F.when(F.col("tool") == "ruff", "success").when(F.col("rule_id") == "R3", "skipped_low_risk").otherwise("failed")
    return t.findings.select(
        "finding_id", review.severity_rank("severity").alias("rank"),
        review.downgrade_low_confidence("severity", F.col("start_line") * F.lit(0.2)).alias("shown"),
        review.status_label(status).alias("status_label"),
        review.bandit_severity(F.upper("severity")).alias("scanner_severity"),
        text.estimate_tokens(F.length("finding_id")).alias("tokens"))


@query("latency_labels", "F38", """select sample_id, step_no, case when duration_ms = 0 then '-' else concat(printf('%.1f', duration_ms / 1000), 's') end as label
  from (select sample_id, step_no, cast(floor(duration_ms * 64) as bigint) * 15.625 as duration_ms from v_steps)""")
def _(t):
    return t.steps.select("sample_id", "step_no", review.latency_label(F.floor(F.col("duration_ms") * 64).cast("bigint") * 15.625).alias("label"))


@query("symbol_equivalence", "F30", """select distinct a.symbol as left_symbol, b.target as right_symbol, a.symbol = b.target or ends_with(a.symbol, concat('.', b.target)) or ends_with(b.target, concat('.', a.symbol)) as same
  from (select concat('app.Model', l_partkey % 40) as symbol, l_orderkey as k from lineitem) a join (select query_id as k, trim(target) as target from v_questions where trim(target) <> '') b using (k)""")
def _(t):
    left = t.lineitem.select(F.expr("concat('app.Model', l_partkey % 40)").alias("left_symbol"), F.col("l_orderkey").alias("query_id"))
    right = t.questions.where(F.trim("target") != "").select("query_id", F.trim("target").alias("right_symbol"))
    return left.join(right, "query_id").select("left_symbol", "right_symbol").distinct().withColumn(
        "same", text.symbols_equivalent("left_symbol", "right_symbol"))


@query("relation_slots", "F29", "select query_id, relation, slot, case slot when 'definition' then 'resolve_symbol' when 'implementation' then 'read_window' when 'verified_caller_edge' then 'verify_callers' when 'verified_callee_edge' then 'verify_callees' else 'search_references' end as tool from (select query_id, relation, unnest(case relation "
       + " ".join(f"when '{k}' then {v}" for k, v in fixed.RELATION_SLOTS.items())
       + " end) as slot from (select query_id, case query_id % 6 when 0 then 'definition_location' when 1 then 'explain_behavior' when 2 then 'trace_call_chain' when 3 then 'compare_behavior' when 4 then 'impact_change' else 'enumerate_usages' end as relation from v_questions))")
def _(t):
    names = ["definition_location", "explain_behavior", "trace_call_chain", "compare_behavior", "impact_change", "enumerate_usages"]
    relation = F.get(F.array(*[F.lit(n) for n in names]), (F.col("query_id") % 6).cast("int"))
    slots = t.questions.select("query_id", relation.alias("relation"), F.explode(questions.expand_relation(relation)).alias("slot"))
    return slots.withColumn("tool", questions.slot_tool("slot"))


@query("stop_reasons", "F31 F32", """select query_id, case when met and retool then 'COMPLETE_AFTER_RETOOL' when met then 'COMPLETE' when steps >= 6 then 'STOP_MAIN_BUDGET' when pending <= 0 then 'STOP_NO_PENDING' else 'PARTIAL' end as stop_reason,
    case when ver > 0 then 'verified' when steps > 1 then 'no_evidence' else 'failed' end as status
  from (select query_id, bool_or(verified) as met, bool_or(blocked) as retool, count(*) as steps, sum(case when has_evidence then 0 else 1 end) as pending, sum(case when verified then 1 else 0 end) as ver from v_target_slots group by query_id)""")
def _(t):
    state = t.target_slots.groupBy("query_id").agg(
        F.bool_or("verified").alias("met"), F.bool_or("blocked").alias("retool"), F.count("*").alias("steps"),
        F.count_if(~F.col("has_evidence")).alias("pending"), F.count_if("verified").alias("ver"))
    return state.select(
        "query_id",
        questions.stop_reason(F.col("met"), F.col("retool"), F.col("steps"), F.lit(6), F.col("pending")).alias("stop_reason"),
        questions.task_status(F.col("ver"), F.col("steps") - 1).alias("status"))


@query("change_evidence", "F35 F36", """select run_id, path, concat(change_type, ': ', path, ' (+', added, '/-', deleted, ')') as snippet,
  regexp_extract(path, '([^/]*)$', 1) in ('requirements.txt', 'requirements7.txt', 'setup.py', 'setup.cfg', 'pyproject.toml', 'Pipfile', 'poetry.lock', 'Pipfile.lock') and regexp_extract(path, '([^/]*)$', 1) <> 'requirements7.txt' as manifest from v_changes""")
def _(t):
    return t.changes.select("run_id", "path", review.change_snippet(F.col("change_type"), F.col("path"), F.col("added"), F.col("deleted")).alias("snippet"),
                            paths.manifest_changed("path").alias("manifest"))


@query("safe_paths", "F37", """select page_id, p <> '' and not starts_with(p, '/') and not list_contains(string_split(p, '/'), '..') as safe
  from (select page_id, regexp_replace(url, '^[a-z]+:/', case page_id % 3 when 0 then '' when 1 then '..' else 'x' end) as p from pages)""")
def _(t):
    start = F.expr("case page_id % 3 when 0 then '' when 1 then '..' else 'x' end")
    return t.pages.select("page_id", paths.safe_path(F.regexp_replace("url", F.lit("^[a-z]+:/"), start)).alias("safe"))


@query("valid_conversations", "F37", """select conv_id, count(*) <= 200 and bool_and(case role when 'assistant' then 'agent' else role end in ('user', 'agent') and length(text) <= 16000) as valid
  from conversations group by conv_id""")
def _(t):
    # Each message is checked on its own first, so a long conversation shuffles counters and no texts.
    role = F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role"))
    good = role.isin("user", "agent") & (F.length("text") <= 16000)
    return t.conversations.groupBy("conv_id").agg(((F.count("*") <= 200) & F.bool_and(good)).alias("valid"))
