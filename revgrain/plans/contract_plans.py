"""Evidence contracts, reuse, packets and stage timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from revgrain import fixed
from revgrain.operators import aggs, contracts, filters, joins
from revgrain.plans.registry import query

_RELATION = "case l_orderkey % 6 when 0 then 'definition_location' when 1 then 'explain_behavior' when 2 then 'trace_call_chain' when 3 then 'compare_behavior' when 4 then 'impact_change' else 'enumerate_usages' end"
_RELATIONS = f"select distinct l_orderkey as query_id, concat('relation_', l_linenumber) as relation_id, {_RELATION} as type, concat('A', l_partkey % 40, ',B', l_suppkey % 20, ',C', l_linenumber) as names from lineitem"


def _relations(t):
    return t.lineitem.selectExpr("l_orderkey as query_id", "concat('relation_', l_linenumber) as relation_id", f"{_RELATION} as type",
                                 "split(concat('A', l_partkey % 40, ',B', l_suppkey % 20, ',C', l_linenumber), ',') as subjects").distinct()


@query("relation_edges", "G07", f"""select query_id, relation_id, s[i] as source, s[i + 1] as destination from (select query_id, relation_id, s, unnest(range(1, len(s))) as i
  from (select query_id, relation_id, string_split(names, ',') as s from ({_RELATIONS}) where type = 'trace_call_chain'))""")
def _(t):
    return contracts.relation_edges(_relations(t))


_SLOTS_SQL = "case type when 'trace_call_chain' then ['definition', 'implementation'] " + " ".join(
    f"when '{k}' then {v}" for k, v in fixed.RELATION_SLOTS.items() if k != "trace_call_chain") + " end"


@query("target_slots", "G07 F29 U05", f"select distinct query_id, symbol, unnest(slots) as slot from (select query_id, unnest(string_split(names, ',')) as symbol, {_SLOTS_SQL} as slots from ({_RELATIONS}))")
def _(t):
    return contracts.target_slots(_relations(t))


_FILLED = """with e as (select query_id, task_id, target, ev_id, case source when 'resolve_symbol' then 'definition' when 'read_window' then 'implementation' when 'search_references' then 'candidate_reference'
    when 'verify_callsite' then 'verified_caller_edge' else 'verified_callee_edge' end as slot from v_task_evidence),
  s as (select distinct query_id, concat('sym', start_line * 5) as symbol from v_task_evidence union select distinct query_id, target from v_task_evidence)
  select distinct e.query_id, s.symbol, e.slot, e.ev_id, e.slot not in ('verified_caller_edge', 'verified_callee_edge') as plain from e join s on e.query_id = s.query_id and (contains(e.target, s.symbol) or contains(s.symbol, e.target))"""


def _filled(t):
    ev = t.task_evidence
    targets = ev.selectExpr("query_id", "concat('sym', start_line * 5) as symbol").unionByName(ev.selectExpr("query_id", "target as symbol"))
    return contracts.fill_slots(ev.select("query_id", "task_id", "target").distinct(), ev, targets)


@query("fill_slots", "A30", _FILLED)
def _(t):
    return _filled(t)


# Required slots and their counts per (query, symbol, slot).
_COUNTS = """select query_id, symbol, slot, count(*) filter (has_evidence) as evidence, count(*) filter (verified) as verified, bool_or(blocked) as blocked from v_target_slots group by all"""


def _counts(t):
    return t.target_slots.groupBy("query_id", "symbol", "slot").agg(
        F.count_if("has_evidence").alias("evidence"), F.count_if("verified").alias("verified"), F.bool_or("blocked").alias("blocked"))


_STATUS = f"""select *, not closed and not blocked as open from (select *, verified > 0 or ((slot in ('definition', 'implementation') or (slot = 'candidate_reference'
    and not bool_or(slot in ('verified_caller_edge', 'verified_callee_edge')) over (partition by query_id, symbol))) and evidence > 0) as closed from ({_COUNTS}))"""


@query("slot_counts", "A30 A32", f"""with f as ({_FILLED}) select query_id, symbol, slot, count(*) filter (plain) as evidence, count(*) as verified, false as blocked from f group by all""")
def _(t):
    filled = _filled(t)
    return contracts.slot_counts(filled.select("query_id", "symbol", "slot").distinct(), filled)


@query("slot_status", "A28", _STATUS)
def _(t):
    return contracts.slot_status(_counts(t))


@query("target_status", "A28", f"select query_id, symbol, not bool_or(open) as complete, bool_or(closed) as any_closed, count(*) filter (open) as open_slots from ({_STATUS}) group by all")
def _(t):
    return contracts.target_status(contracts.slot_status(_counts(t)))


_CONTRACT = f"""with g as (select query_id, symbol, bool_or(slot = 'definition' and evidence + verified > 0) as d, bool_or(slot = 'implementation' and evidence + verified > 0) as i,
    bool_or(slot = 'candidate_reference' and evidence + verified > 0) as r, bool_or(slot = 'candidate_reference' and evidence > 0) as ref, bool_or(slot = 'verified_caller_edge' and verified > 0) as caller,
    sum(case when slot like 'verified_call%' then verified else 0 end) as edges from ({_COUNTS}) group by all),
  q as (select query_id, bool_or(d) as d, bool_or(d and i) as ready, count(*) filter (d and i) as n_ready, bool_or(r) as r, sum(edges) as edges, bool_or(d and (caller or ref)) as dep from g group by query_id),
  s as (select o_orderkey as query_id, case o_orderkey % 6 when 0 then 'locate' when 1 then 'grep' when 2 then 'explain' when 3 then 'trace' when 4 then 'impact' else 'compare' end as t from orders),
  m as (select s.query_id, t, case when q.query_id is null then false else case t when 'locate' then d when 'grep' then r when 'explain' then ready when 'trace' then edges >= 2 when 'impact' then dep else n_ready >= 2 end end as ok,
    case when q.query_id is null then 'no targets' when t = 'locate' and d then 'found definition' when t = 'grep' and r then 'found references' when t = 'explain' then case when ready then 'found definition and implementation' when d then 'has definition but no implementation body' else 'no definition or implementation for explain' end
      when t = 'trace' then case when edges >= 2 then concat('found ', cast(edges as bigint), ' verified call edges') when edges = 0 then 'no verified call edges for trace' when d then 'only 1 verified edge, need 2 for trace chain' else 'no evidence found' end
      when t = 'impact' then case when dep then 'found definition and dependency/caller evidence' else 'need definition + dependency evidence for impact' end
      when t = 'compare' then case when n_ready >= 2 then concat(n_ready, ' targets have definition+implementation for comparison') when n_ready = 1 then 'only 1 target(s) ready, need 2 for comparison' else 'no targets ready for comparison' end else 'no evidence found' end as why
    from s left join q using (query_id))"""


def _typed(t):
    return t.samples.select(F.col("sample_id").alias("query_id"), "question_type")


@query("minimum_contract", "A29", f"{_CONTRACT} select query_id, t as question_type, ok as met, why as reason from m")
def _(t):
    return contracts.minimum_contract(_counts(t), _typed(t))


@query("minimum_contract_with_claims", "A29 J12", f"""{_CONTRACT}, c as (select l_orderkey as query_id, count(*) as n, count(*) filter (l_discount >= 0.03) as k from lineitem where l_orderkey % 4 > 0 group by 1)
  select query_id, t as question_type, case when n is null or why = 'no targets' then ok else ok and n = k end as met, case when n is null or why = 'no targets' then why when not ok then concat('structural unmet (', why, '); claims: ', k, '/', n, ' claims covered')
    when n <> k then concat('structural met but claims unmet: ', k, '/', n, ' claims covered') else concat('structural met (', why, '); claims: ', k, '/', n, ' claims covered') end as reason from m left join c using (query_id)""")
def _(t):
    claims = t.lineitem.where("l_orderkey % 4 > 0").selectExpr("l_orderkey as query_id", "l_linenumber as claim_index", "l_discount >= 0.03 as covered")
    return contracts.minimum_contract(_counts(t), _typed(t), claims)


@query("next_open_slot", "W20", """with r as (select distinct query_id, symbol as task_id, slot from v_target_slots), v as (select distinct query_id, symbol as task_id, slot from v_target_slots where verified),
  m as (select *, list_position(['definition', 'implementation', 'verified_caller_edge', 'verified_callee_edge', 'candidate_reference'], slot) as p from r where not exists (select 1 from v where v.query_id = r.query_id and v.task_id = r.task_id and v.slot = r.slot))
  select query_id, task_id, slot, ['resolve_symbol', 'read_window', 'verify_callers', 'verify_callees', 'search_references'][p] as tool, ['definition', 'definition', 'callers', 'definition', 'references'][p] as search_kind from m
  qualify row_number() over (partition by query_id, task_id order by p) = 1""")
def _(t):
    rows = t.target_slots.withColumnRenamed("symbol", "task_id")
    source = F.create_map(*[F.lit(x) for k, v in fixed.SOURCE_SLOT.items() for x in (v, k)])
    return contracts.next_open_slot(rows.select("query_id", "task_id", "slot").distinct(), rows.where("verified").select("query_id", "task_id", source[F.col("slot")].alias("source")))


_REPORT_LABELS = "case slot " + " ".join(f"when '{s}' then '{fixed.SLOT_LABEL[s]}'" for s in fixed.SLOT_ORDER) + " end"


@query("slot_report", "S25", f"""with r as (select distinct query_id, symbol, slot from v_target_slots), f as (select distinct query_id, symbol, slot, ev_id from v_target_slots where verified),
  k as (select *, row_number() over (partition by query_id, symbol, slot order by ev_id) as n from f qualify n <= 3),
  b as (select r.query_id, r.symbol, list_position(['definition', 'implementation', 'verified_caller_edge', 'verified_callee_edge', 'candidate_reference'], r.slot) as slot_no, coalesce(k.n, 1) as line_no,
    concat('  [', {_REPORT_LABELS.replace('case slot', 'case r.slot')}, '] ', coalesce(e.file || ':' || e.start_line || ' — ' || left(e.snippet, 200), '尚待确认')) as line
    from r left join (k join v_task_evidence e using (query_id, ev_id)) using (query_id, symbol, slot))
  select query_id, symbol, cast(slot_no as int) as slot_no, cast(line_no as int) as line_no, line from b union all select distinct query_id, symbol, 0, 0, concat('## ', symbol) from r""")
def _(t):
    rows = t.target_slots
    keys = ["query_id", "symbol", "slot"]
    return contracts.slot_report(rows.select(*keys).distinct(), rows.where("verified").select(*keys, "ev_id").distinct(), t.task_evidence)


@query("plain_report", "S25", """select query_id, cast(n as int) as line_no, concat('- ', file, ':', start_line, ' — ', left(snippet, 240)) as line from (select *, row_number() over (partition by query_id order by seq) as n from v_task_evidence) where n <= 10""")
def _(t):
    return contracts.plain_report(t.task_evidence)


@query("grounded_sentences", "F11", """with a as (select l_orderkey as query_id, min(concat('See [', 'ev_', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey, '] there。Nothing here！Also [ev_none] and [ev_', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey, ']')) as answer from lineitem group by 1),
  p as (select query_id, regexp_extract_all(answer, '[^。！？\\n]*[。！？\\n]|[^。！？\\n]+$') as s from a), r as (select query_id, i - 1 as sentence_no, s[i] as sentence from (select query_id, s, unnest(range(1, len(s) + 1)) as i from p)),
  e as (select query_id, ev_id, concat(file, ':', start_line) as place from v_task_evidence)
  select r.query_id, cast(sentence_no as int) as sentence_no, replace(sentence, concat('[', ev_id, ']'), place) as sentence from r join e on r.query_id = e.query_id and contains(r.sentence, concat('[', e.ev_id, ']'))""")
def _(t):
    answers = t.lineitem.selectExpr("l_orderkey as query_id", "concat('ev_', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey) as e").groupBy("query_id").agg(
        F.min(F.expr("concat('See [', e, '] there。Nothing here！Also [ev_none] and [', e, ']')")).alias("answer"))
    return contracts.grounded_sentences(answers, t.task_evidence)


@query("evidence_reuse", "J16", """with n as (select distinct query_id, concat('sym', start_line * 6) as name from v_task_evidence), h as (select distinct e.query_id, e.ev_id, e.seq from v_task_evidence e join n on e.query_id = n.query_id and contains(lower(e.snippet), n.name))
  select query_id, ev_id, seq, cast(row_number() over (partition by query_id order by seq, ev_id) as int) as rank from h qualify rank <= 10""")
def _(t):
    tasks = t.task_evidence.selectExpr("query_id", "concat('app.Sym', start_line * 6) as target")
    return joins.evidence_reuse(tasks, t.task_evidence)


@query("reusable_evidence", "J16", """with n as (select distinct query_id, concat('m', start_line * 6, '.py') as word from v_task_evidence)
  select distinct e.query_id, e.ev_id, concat('[', source, '] ', file, ':', start_line) as ref from v_task_evidence e join n on e.query_id = n.query_id and contains(lower(concat(snippet, ' ', source, ' ', file)), n.word)""")
def _(t):
    words = t.task_evidence.selectExpr("query_id", "concat('M', start_line * 6, '.py') as word")
    return joins.reusable_evidence(words, t.task_evidence)


@query("answer_missing_evidence", "J17", """select query_id, ev_id, file, cast(row_number() over (partition by query_id, file order by seq) as int) as rank from (select distinct query_id, ev_id, file, start_line, seq from v_task_evidence) e
  where not exists (select 1 from lineitem l where l.l_orderkey = e.query_id and concat('src/m', l_partkey % 40, '.py') = e.file and l_linenumber + l_suppkey % 4 = e.start_line) qualify row_number() over (partition by query_id, file order by seq) <= 8""")
def _(t):
    cited = joins.answer_citations(t.answers.withColumnRenamed("answer_part", "answer")).withColumnRenamed("sample_id", "query_id")
    return joins.answer_missing_evidence(t.task_evidence, cited).select("query_id", "ev_id", "file", "rank")


@query("claim_packets", "J18", """with c as (select distinct query_id, task_id, concat('claim ', start_line % 2) as claim from v_task_evidence), r as (select c.query_id, c.claim, e.ev_id, min(e.seq) as seq, min(e.file) as file, min(e.start_line) as line from c join v_task_evidence e using (query_id, task_id) group by all),
  k as (select *, row_number() over (partition by query_id, claim order by seq, ev_id) as n from r qualify n <= 4)
  select query_id, claim, string_agg(concat('[', ev_id, '] ', file, ':', line), ', ' order by n) as evidence from k group by all""")
def _(t):
    return joins.claim_packets(t.task_evidence.selectExpr("query_id", "task_id", "concat('claim ', start_line % 2) as claim"), t.task_evidence)


@query("session_join", "J15", """select r.o_orderkey as request_id, n.n_name as username from (select o_orderkey, concat('token-', o_custkey) as token from orders) r
  join (select sha256(concat('token-', c_custkey)) as token_hash, c_nationkey as user_id, c_acctbal as expires_at from customer) s on sha256(r.token) = s.token_hash and s.expires_at > 0 join nation n on n.n_nationkey = s.user_id""")
def _(t):
    requests = t.orders.selectExpr("o_orderkey as request_id", "concat('token-', o_custkey) as token")
    sessions = t.customer.selectExpr("sha2(concat('token-', c_custkey), 256) as token_hash", "c_nationkey as user_id", "c_acctbal as expires_at")
    users = t.nation.selectExpr("n_nationkey as user_id", "n_name as username")
    return joins.session_join(requests, sessions, users, F.lit(0)).select("request_id", "username")


@query("enumerate_usages", "A27", "select run_id as query_id, file, start_line, min(ev_id) as ev_id from v_evidence group by all")
def _(t):
    return aggs.enumerate_usages(t.evidence.withColumnRenamed("run_id", "query_id"))


@query("usage_totals", "A27", """with u as (select distinct run_id as query_id, file, start_line from v_evidence) select query_id, file, count(*) as hits from u group by query_id, file union all select query_id, null, count(*) from u group by query_id""")
def _(t):
    return aggs.usage_totals(aggs.enumerate_usages(t.evidence.withColumnRenamed("run_id", "query_id")))


@query("evidence_counts", "A32", "select query_id, task_id, count(*) filter (ok) as verified, count(*) filter (not ok) as candidates from v_task_evidence group by all")
def _(t):
    return aggs.evidence_counts(t.task_evidence)


@query("files_visited", "A32", "select distinct query_id, file from v_task_evidence")
def _(t):
    return aggs.files_visited(t.task_evidence)


@query("production_references", "A29 S02", "select ev_id from v_task_evidence")
def _(t):
    return contracts.production_references(t.task_evidence).select("ev_id")


@query("uncovered_claims", "U03", "select distinct query_id, start_line from v_task_evidence a where not exists (select 1 from v_task_evidence b where b.ok and b.query_id = a.query_id and b.start_line = a.start_line)")
def _(t):
    rows = t.task_evidence.select("query_id", "start_line").distinct()
    return contracts.uncovered(rows, t.task_evidence.where("ok"), ["query_id", "start_line"])


@query("candidate_references", "P11", "select ev_id from v_task_evidence where source = 'search_references'")
def _(t):
    return filters.split_verified(t.task_evidence.where("source = 'search_references'").withColumn("symbol", F.col("target")).withColumn("counterpart", F.lit("")))[0].select("ev_id")


_STEP = "case event_type when 'click' then 'git' when 'view' then 'ruff' when 'purchase' then 'aggregator' when 'signup' then 'llm_review:a' else 'report' end"
_LAST = f"select user_id as run_id, {_STEP} as stage, arg_max(case when event_id % 5 = 0 then 'failed' else 'success' end, event_id) as status, arg_max(value, event_id) as duration_ms, min(event_id) as first_seq from events group by all"
_STAGES = f"""with l as ({_LAST}), p as (select distinct user_id as run_id from events)
  select l.run_id, stage, status, duration_ms, case when stage in ('git', 'ruff') then 0 when stage in ('aggregator', 'report') then 1 else 2 end as part,
    cast(case stage when 'git' then 0 when 'ruff' then 1 when 'aggregator' then 0 when 'report' then 1 else first_seq end as bigint) as ord,
    case when stage = 'ruff' then l.run_id % 7 else 0 end as finding_count, case when stage = 'ruff' then l.run_id % 11 else 0 end as evidence_count from l"""


def _stages(t):
    runs = t.events.select(F.col("user_id").alias("run_id")).distinct()
    analyzers = runs.select("run_id", F.posexplode(F.array(F.lit("git"), F.lit("ruff"), F.lit("bandit"))).alias("pos", "stage"))
    trace = t.events.selectExpr("user_id as run_id", "event_id as seq", f"{_STEP} as step", "case when event_id % 5 = 0 then 'failed' else 'success' end as status", "value as duration_ms")
    results = runs.selectExpr("run_id", "'ruff' as stage", "run_id % 7 as finding_count", "run_id % 11 as evidence_count")
    return joins.stage_metrics(analyzers, trace, results)


@query("stage_metrics", "J13", _STAGES)
def _(t):
    return _stages(t)


@query("timeline_summary", "A25", f"""select run_id, count(*) filter (status = 'success') as success_count, count(*) filter (status = 'failed') as failure_count,
  arg_max(stage, (duration_ms, -(part * 1000000000 + ord))) as bottleneck, max(duration_ms) as longest_ms from ({_STAGES}) group by run_id""")
def _(t):
    return aggs.timeline_summary(_stages(t).withColumn("ord", F.col("part") * 1000000000 + F.col("ord")))


def _judge_inputs(t):
    samples = t.samples.select("sample_id", F.col("question_type").alias("question")).join(
        t.orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("expected_answer_summary")), "sample_id")
    outputs = t.documents.select(F.col("doc_id").alias("sample_id"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("diff"))
    answers = t.orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("answer"))
    return joins.judge_inputs(samples, outputs.join(answers, "sample_id"))


_JUDGED = """select r.sample_id, case when d is null or d = '' then null else concat('{"question":"', q, '","expected_answer_summary":"', s, '","answer":"', a, '"}') end as payload,
    nullif(d, '') as diff, case when d is null or d = '' then 'pipeline result has no unified diff' end as error
  from (select o_orderkey as sample_id, question_type as q, o_orderpriority as s, o_orderstatus as a from orders join v_samples on o_orderkey = sample_id) r
  join (select doc_id as sample_id, case when doc_id % 9 = 0 then null else text end as d from documents) using (sample_id)"""


@query("judge_inputs", "J19", _JUDGED)
def _(t):
    return _judge_inputs(t)


@query("judge_inputs_whole", "J19", _JUDGED)
def _(t):
    return _judge_inputs(t)  # the name it had beside a shortened form


@query("format_issues", "J19", """select l_orderkey as sample_id, l_linenumber as issue_index, concat('--- Issue #', l_linenumber, ' ---', chr(10), '  严重度: high | 文件: m.py:', l_linenumber, ' | 来源: ruff, bandit', chr(10), '  标题: ', l_returnflag,
  case when l_linestatus = 'O' then concat(chr(10), '  原因: open') else '' end) as block from lineitem""")
def _(t):
    rows = t.lineitem.selectExpr("l_orderkey as sample_id", "l_linenumber as issue_index", "'high' as severity", "'m.py' as file", "l_linenumber as line", "array('ruff', 'bandit') as sources",
                                 "l_returnflag as title", "case when l_linestatus = 'O' then 'open' else '' end as reason", "'' as fix")
    return joins.format_issues(rows)


@query("review_context", "J14")
def _(t):
    files = t.changes.groupBy("run_id", "path").agg(F.min("added").alias("seq"))
    findings = t.changes.selectExpr("run_id", "path", "concat('R', added % 5) as rule_id", "added as start_line", "concat('m', deleted) as message", "added * 100 + deleted as seq")
    symbols = t.changes.selectExpr("run_id", "path", "'function' as kind", "concat('f', added) as name", "deleted as start_line")
    patches = t.changes.groupBy("run_id", "path").agg(F.max(F.concat(F.lit("@@ "), "path")).alias("patch"))
    return joins.review_context(files, findings, symbols, patches)
