"""Persistence, reports, generated evaluation data, model output checks, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from revgrain.functions import judging
from revgrain.functions.patterns import strings
from revgrain.operators import aggs, generate, reports, tools
from revgrain.plans.registry import query
from revgrain.plans.search_plans import SEARCHES, _search_sql
from revgrain.plans.tables import clock
from revgrain.session import shared_folder
from revgrain.sources import corpus, knowledge, runs, samples
from revgrain.streaming import evaluation, jobs
from revgrain.streaming.runner import table_stream


def _folder(t) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/{uuid.uuid4().hex}"


def _list(column: str):
    return F.array_remove(F.split(column, ","), "")


def _sql_list(column: str) -> str:
    return f"list_filter(string_split({column}, ','), lambda x: x <> '')"


# --- sources and sinks ----------------------------------------------------------------------------------


@query("corpus_size", "A34", "select source as repo_id, count(*) as file_count, cast(sum(octet_length(encode(text))) as bigint) as total_bytes from documents group by source")
def _(t):
    return corpus.corpus_size(t.documents.select(F.col("source").alias("repo_id"), F.lit("a/b.py").alias("path"), "text"), ["repo_id"])


@query("read_corpus", "S01", "select concat('d', doc_id) as name, octet_length(encode(text)) as length, text from documents")
def _(t):
    # Every text is written as a plain file first and then read back as a corpus.
    folder = _folder(t)
    rows = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "text")
    corpus.write_files(rows, folder)
    found = corpus.read_corpus(t.spark, folder, [".txt"])
    text = F.regexp_replace("text", "\\x00$", "")
    return found.select(corpus.file_name("path").alias("name"), (F.col("length") - 1).alias("length"), text.alias("text"))


def _stored_runs(t):
    return t.lineitem.selectExpr("concat('run_', l_orderkey) as run_id", "concat(l_linenumber, l_returnflag) as issue", "l_quantity as quantity")


@query("load_run", "S10 S11", "select concat('run_', l_orderkey) as run_id, concat(l_linenumber, l_returnflag) as issue, l_quantity as quantity from lineitem where l_orderkey = (select max(o_orderkey) from orders)")
def _(t):
    folder = _folder(t)
    runs.write_runs(_stored_runs(t), folder)
    last = t.orders.agg(F.max("o_orderkey")).first()[0]
    return runs.load_run(t.spark, folder, f"run_{last}")


@query("list_runs", "S12", """select concat('run_', o_orderkey) as run_id, concat('repo_', o_custkey) as repo_url, '' as base_ref, o_orderstatus as head_ref, o_orderpriority as created_at,
  case when o_orderkey % 3 = 0 then 'unknown' else 'high' end as risk_level, o_orderkey % 4 as issue_count, o_totalprice as duration_ms from orders where o_orderkey % 5 > 0""")
def _(t):
    folder = _folder(t)
    docs = t.orders.selectExpr("concat('run_', o_orderkey) as run_id", "concat('repo_', o_custkey) as repo_url", "cast(null as string) as base_ref", "o_orderstatus as head_ref", "o_orderpriority as created_at",
                               "named_struct('risk_level', case when o_orderkey % 3 = 0 then null else 'high' end) as plan", "transform(sequence(1, cast(o_orderkey % 4 as int) + 1), x -> concat('i', x)) as issues", "o_totalprice as duration_ms", "o_orderkey % 5 = 0 as torn")
    text = F.to_json(F.struct("run_id", "repo_url", "base_ref", "head_ref", "created_at", "plan", F.slice("issues", F.lit(1), F.size("issues") - 1).alias("issues"), "duration_ms"))
    docs.select(F.when(F.col("torn"), F.expr("'{\"run_id\": '")).otherwise(text).alias("value")).write.text(folder)
    return runs.list_runs(t.spark, folder).withColumn("issue_count", F.col("issue_count").cast("bigint"))


@query("run_documents", "S21", """with c as (select l_orderkey, count(*) as n from lineitem group by 1) select concat('run_', o_orderkey) as run_id, 'run' as record, concat('{"run_id":"run_', o_orderkey, '","risk":"', o_orderstatus, '","issue_count":', coalesce(n, 0), '}') as document
  from orders left join c on o_orderkey = l_orderkey union all select concat('run_', l_orderkey), 'issue', concat('{"run_id":"run_', l_orderkey, '","line":', l_linenumber, ',"severity":"', l_returnflag, '"}') from lineitem""")
def _(t):
    heads = t.orders.selectExpr("concat('run_', o_orderkey) as run_id", "o_orderstatus as risk")
    return runs.run_documents(heads, t.lineitem.selectExpr("concat('run_', l_orderkey) as run_id", "l_linenumber as line", "l_returnflag as severity"))


def _report(t):
    heads = t.orders.selectExpr("concat('run_', o_orderkey) as run_id", "concat('b', o_custkey) as base", "'HEAD' as head", "o_orderkey * 125.0D as duration_ms", "'high' as risk_level",
                                "array('git', 'ruff') as analyzers", "case when o_orderkey % 2 = 0 then array('sql_risk') else cast(array() as array<string>) end as reason_codes")
    key = "concat(l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey)"
    changes = t.lineitem.where("l_discount > 0.05").selectExpr("concat('run_', l_orderkey) as run_id", f"concat('src/', {key}) as path", "'modified' as change_type", "cast(l_quantity as int) as added", "l_linenumber as deleted")
    trace = t.lineitem.selectExpr("concat('run_', l_orderkey) as run_id", "l_linenumber as seq", "concat('s', l_suppkey) as step", "case when l_tax > 0.06 then 'failed' else 'success' end as status", "l_quantity * 125.0D as duration_ms")
    issues = t.lineitem.where("l_returnflag = 'R'").selectExpr("concat('run_', l_orderkey) as run_id", f"{key} as issue_id", "case when l_tax > 0.04 then 'high' else 'low' end as severity", "concat('[R] ', l_partkey) as title",
                                                             "'a.py' as file", "l_linenumber as line", "'ruff' as source", "'why' as reason")
    proof = t.lineitem.where("l_returnflag = 'R'").selectExpr("concat('run_', l_orderkey) as run_id", f"{key} as issue_id", f"concat('ev_', {key}) as ev_id", "l_linestatus as snippet")
    return reports.report_lines(heads, changes, trace, issues, proof)


_RUN = "'run_' || o_orderkey"
_LKEY = "l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey"


@query("report_lines", "S20 F38", f"""with n as (select o_orderkey, count(l_orderkey) filter (l_discount > 0.05) as n, count(l_orderkey) filter (l_returnflag = 'R') as m from orders left join lineitem on o_orderkey = l_orderkey group by 1)
  select {_RUN} as run_id, 0 as section, 0 as part, '# Code Review Report' || chr(10) || chr(10) || '**Base:** `b' || o_custkey || '` → **Head:** `HEAD`' || chr(10) || '**Duration:** ' || printf('%.1f', o_orderkey * 125.0 / 1000) || 's' || chr(10) || '**Risk Level:** high' as line from orders
  union all select {_RUN}, 1, 0, '## 1. Change Summary' || chr(10) || chr(10) || '| # | Type | File | +Added | -Deleted |' || chr(10) || '|---|---|---|---|---|' from n
  union all select 'run_' || l_orderkey, 1, 1, '| | modified | `src/' || {_LKEY} || '` | ' || cast(l_quantity as int) || ' | ' || l_linenumber || ' |' from lineitem where l_discount > 0.05
  union all select {_RUN}, 1, 1, '| | | (no changes) | 0 | 0 |' from n where n = 0
  union all select {_RUN}, 2, -1, chr(10) || '**Total:** ' || n || ' files changed.' || chr(10) from n
  union all select {_RUN}, 2, 0, '## 2. Execution Trace' || chr(10) || chr(10) || '| Step | Status | Duration |' || chr(10) || '|---|---|---|' from n
  union all select 'run_' || l_orderkey, 2, l_linenumber, '| s' || l_suppkey || ' | ' || case when l_tax > 0.06 then 'FAIL' else 'OK' end || ' | ' || printf('%.1f', l_quantity * 125.0 / 1000) || 's |' from lineitem
  union all select {_RUN}, 2, 0, '| _sql_risk_ | — | — |' from orders where o_orderkey % 2 = 0
  union all select {_RUN}, 3, 0, '## 3. Issues (' || m || ')' || chr(10) from n union all select {_RUN}, 3, 1, 'No issues found.' || chr(10) from n where m = 0
  union all select 'run_' || l_orderkey, 3, 0, '### [' || case when l_tax > 0.04 then 'HIGH' else 'LOW' end || '] [R] ' || l_partkey || chr(10) || chr(10) || '- **File:** `a.py:' || l_linenumber || '`' || chr(10) || '- **Source:** ruff' || chr(10) || '- **Reason:** why' from lineitem where l_returnflag = 'R'
  union all select 'run_' || l_orderkey, 3, 1, '- `ev_' || {_LKEY} || '`: ' || l_linestatus from lineitem where l_returnflag = 'R'
  union all select {_RUN}, 4, 0, '## 4. Plan Details' || chr(10) || chr(10) || '- **Analyzers:** git, ruff' || chr(10) || '- **Reason Codes:** ' || case when o_orderkey % 2 = 0 then 'sql_risk' else 'none' end || chr(10) || '- **Risk Level:** high' from orders""")
def _(t):
    return _report(t).select("run_id", "section", F.col("part").cast("int").alias("part"), "line")


@query("metric_summaries", "S22", """with c as (select count(*) as total, count(*) filter (verdict = 'correct') as correct from v_judgments), r as (select total, correct / total as rate from c)
  select 0 as line_no, '| samples | ' || total || ' |' as line from r union all select 1, '| correct | ' || printf('%.1f', round_even(rate * 100, 1)) || '% |' from r""")
def _(t):
    m = t.judgments.agg(F.count("*").alias("total"), (F.count_if(F.col("verdict") == "correct") / F.count("*")).alias("rate"))
    return reports.metric_table(m, {"total": "samples", "rate": "correct"}, ["rate"])


@query("tool_table", "S22", """select verdict, '| ' || verdict || ' | ' || count(*) || ' |' as line from v_verdicts group by verdict""")
def _(t):
    return reports.grouped_table(t.verdicts.groupBy("verdict").agg(F.count("*").alias("n")), "verdict", ["n"], [])


@query("external_samples", "S14", """select sample_id, case when expected_words <> '' then expected_words when sample_id % 3 = 0 then 'goes' else array_to_string(list_filter(['src', 'Order', 'nope'], lambda s: contains(lower(answer), lower(s))), ',') end as answer_keywords
  from v_records where project = 'alpha'""")
def _(t):
    rows = t.records.select("sample_id", "project", F.col("answer").alias("expected_answer_summary"), _list("expected_words").alias("expected_answer_keywords"),
                            F.when(F.col("sample_id") % 3 == 0, strings(["goes"])).alias("expected_keywords"), strings(["src", "Order", "nope"]).alias("target_symbols"))
    return samples.external_samples(rows, "alpha").select("sample_id", F.array_join("answer_keywords", ",").alias("answer_keywords"))


@query("load_samples", "S13 S19", "select concat('a', o_orderkey) as id, question from v_questions join orders on o_orderkey = query_id where o_custkey % 3 = 0")
def _(t):
    folder = _folder(t)
    rows = t.questions.join(t.orders.withColumnRenamed("o_orderkey", "query_id"), "query_id").selectExpr(
        "concat('a', query_id) as id", "case when o_custkey % 3 = 0 then 'investigation' else 'review' end as mode", "question", "named_struct('risk_level', 'low', 'question_type', 'locate') as ground_truth")
    samples.write_dataset(rows, folder)
    paths = {"v1": f"{folder}/none", "latest": f"{folder}/eval_dataset_v2"}
    return samples.load_samples(t.spark, paths, "agent").select("id", "question")


@query("pending", "S16", """with d as (select sample_id, follow_up_group, step_count > 0 as done from v_records), g as (select follow_up_group from d where follow_up_group <> '' group by 1 having not bool_and(done))
  select sample_id from d where (follow_up_group = '' and not done) or follow_up_group in (select follow_up_group from g)""")
def _(t):
    rows = t.records.select("sample_id", "follow_up_group")
    return samples.pending(rows, t.records.where("step_count > 0")).select("sample_id")


def _repos(t):
    return t.records.selectExpr("sample_id", "concat('https://example.org/', project) as repo_url", "concat('c', sample_id) as commit_sha", "project")


_FROZEN = """select 'external_glm_v7' as baseline_id, sample_id, 'https://example.org/' || project as url, case when sample_id % 9 = 0 then null else answer end as raw_llm_response,
  case when sample_id % 9 = 0 then 'llm_unavailable_or_request_failed' end as fallback_reason, step_count as steps_used from v_records"""


@query("freeze_baseline", "S17", _FROZEN)
def _(t):
    answer = F.when(F.col("sample_id") % 9 == 0, "LLM 不可用").otherwise(F.col("answer"))
    rows = t.records.drop("project").withColumn("answer", answer).withColumn("question", F.lit("q")).withColumn("labels", strings([]))
    target = samples.freeze_baseline(rows, _repos(t), "external_glm_v7", _folder(t))
    frozen = t.spark.read.parquet(target)
    return frozen.select("baseline_id", "sample_id", F.col("repository.url").alias("url"), "raw_llm_response", "fallback_reason", "steps_used")


@query("enrich_baseline", "S18", "select r.sample_id, coalesce(j.verdict, '') as expected_answer_summary, j.sample_id is not null as enriched from v_records r left join v_judgments j using (sample_id)")
def _(t):
    truth = t.judgments.select("sample_id", F.col("verdict").alias("expected_answer_summary"), F.lit(None).cast("array<string>").alias("expected_answer_keywords"))
    rows = samples.enrich_baseline(t.records.select("sample_id"), truth)
    return rows.select("sample_id", F.coalesce("expected_answer_summary", F.lit("")).alias("expected_answer_summary"), "enriched")


@query("step_counts", "F39", "select sample_id, count(*) filter (status <> 'no_progress') as steps from v_steps group by sample_id")
def _(t):
    step = F.array(F.struct(F.when(F.col("status") == "no_progress", "(blocked)").otherwise(F.col("status")).alias("tool")))
    return t.steps.groupBy("sample_id").agg(F.sum(samples.step_count(step)).alias("steps"))


@query("error_records", "F39", "select sample_id, '(执行错误: ' || pipeline_error || ')' as answer, 0 as step_count, 'error: ' || pipeline_error as trace from v_sample_state where pipeline_error is not null")
def _(t):
    bad = t.sample_state.where("pipeline_error is not null").select("sample_id", F.lit("q").alias("question"), F.lit(None).cast("string").alias("question_type"), F.lit("").alias("follow_up_group"), F.col("pipeline_error").alias("error"))
    return samples.error_records(bad).select("sample_id", "answer", "step_count", F.array_join("trace", "").alias("trace"))


@query("append_knowledge", "S23", """select distinct source as collection, doc_id as item_id from documents where doc_id not in (select doc_id from labels where quality = 1)""")
def _(t):
    items = t.documents.select(F.col("source").alias("collection"), F.col("doc_id").alias("item_id"), "text")
    stored = t.labels.where("quality = 1").join(t.documents, "doc_id").select(F.col("source").alias("collection"), F.col("doc_id").alias("item_id"))
    folder = _folder(t)
    knowledge.append_knowledge(items, stored, folder)
    return t.spark.read.parquet(folder).select("collection", "item_id")


_OLD = "select conv_id as user_id, turn as conv_id, text as title, 1 + turn % 3 as version from conversations where turn % 4 < 3"
_NEW = "select conv_id as user_id, turn as conv_id, upper(role) as title, case when turn % 4 = 3 then 0 else turn % 3 + turn % 2 end as version, case when turn % 5 = 4 then 'delete' else 'save' end as op from conversations where turn % 6 > 0"
_UPSERT = f"""with o as ({_OLD}), n as ({_NEW}), b as (select user_id, conv_id, o.title as ot, o.version as ov, n.title as nt, n.version as nv, op from o full join n using (user_id, conv_id)),
  s as (select *, case when op is null then 'kept' when op = 'delete' then case when coalesce(ov = nv, false) then 'deleted' else 'conflict' end when nv = 0 and ov is null then 'inserted' when nv <> 0 and coalesce(ov = nv, false) then 'updated' else 'conflict' end as outcome from b)
  select user_id, conv_id, outcome, case when outcome in ('inserted', 'updated') then nt when outcome <> 'deleted' then ot end as title, case outcome when 'inserted' then 1 when 'updated' then ov + 1 when 'deleted' then null else ov end as version from s"""


@query("versioned_upsert", "S24", _UPSERT)
def _(t):
    conv = t.conversations
    old = conv.where("turn % 4 < 3").selectExpr("conv_id as user_id", "turn as conv_id", "text as title", "1 + turn % 3 as version")
    new = conv.where("turn % 6 > 0").selectExpr("conv_id as user_id", "turn as conv_id", "upper(role) as title", "case when turn % 4 = 3 then 0 else turn % 3 + turn % 2 end as version", "case when turn % 5 = 4 then 'delete' else 'save' end as op")
    return knowledge.versioned_upsert(old, new)


_SEVERAL = "select conv_id % 40 as user_id, conv_id % 3 as conv_id, conv_id * 1000 + turn as seq, concat('t', turn) as title, case when turn % 3 = 0 then turn % 4 else least(turn, 3) end as version, case when (conv_id + turn) % 7 = 6 then 'delete' else 'save' end as op from conversations"
_STORED = "select distinct conv_id % 40 as user_id, conv_id % 3 as conv_id, 'stored' as title, 2 as version from conversations where conv_id % 5 < 2"
_FOLDED = f"""with recursive u as (select *, row_number() over (partition by user_id, conv_id order by seq) as n from ({_SEVERAL})), c as ({_STORED}),
  s as (select k.user_id, k.conv_id, cast(0 as bigint) as n, cast(null as bigint) as seq, cast(null as varchar) as title, '' as outcome, cast(coalesce(c.version, 0) as bigint) as v
      from (select distinct user_id, conv_id from u) k left join c using (user_id, conv_id)
    union all select u.user_id, u.conv_id, u.n, u.seq, u.title, case when op = 'delete' then case when version = v and v > 0 then 'deleted' else 'conflict' end when version = v then case when v = 0 then 'inserted' else 'updated' end else 'conflict' end,
      case when op = 'delete' then case when version = v then 0 else v end when version = v then v + 1 else v end from s join u on u.user_id = s.user_id and u.conv_id = s.conv_id and u.n = s.n + 1)"""


def _several(conversations):
    key = ["conv_id % 40 as user_id", "conv_id % 3 as conv_id"]
    version = "case when turn % 3 = 0 then turn % 4 else least(turn, 3) end as version"
    return conversations.selectExpr(*key, "conv_id * 1000 + turn as seq", "concat('t', turn) as title", version, "case when (conv_id + turn) % 7 = 6 then 'delete' else 'save' end as op")


def _stored(t):
    return t.conversations.where("conv_id % 5 < 2").selectExpr("conv_id % 40 as user_id", "conv_id % 3 as conv_id", "'stored' as title", "2 as version").distinct()


@query("apply_updates", "S24", f"{_FOLDED} select user_id, conv_id, seq, outcome, case when outcome in ('inserted', 'updated') then title end as title, nullif(v, 0) as version from s where n > 0")
def _(t):
    return knowledge.apply_updates(_stored(t), _several(t.conversations))


@query("state_after_updates", "S24", f"""{_FOLDED}, l as (select *, row_number() over (partition by user_id, conv_id order by n desc) as back from s where n = 0 or outcome <> 'conflict')
  select l.user_id, l.conv_id, case when l.n = 0 then c.title else l.title end as title, v as version from l left join c using (user_id, conv_id) where back = 1 and v > 0""")
def _(t):
    return knowledge.state_after(_stored(t), knowledge.apply_updates(_stored(t), _several(t.conversations)))


# --- generated evaluation data --------------------------------------------------------------------------


@query("risk_combos", "N01", "select concat_ws('+', " + ", ".join(f"case when o_orderkey % {2 << i} >= {1 << i} then '{s}' end" for i, s in enumerate(generate.SIGNALS)) + ") as combo, count(*) as samples from orders group by 1")
def _(t):
    rows = generate.subsets(generate.SIGNALS, t.orders, "o_orderkey")
    return rows.groupBy(F.array_join("risk_signals", "+").alias("combo")).agg(F.count("*").alias("samples"))


def _matrix(t):
    return generate.review_ids(generate.coverage_matrix(t.orders.select(F.col("o_orderkey").alias("seed"))))


@query("coverage_matrix", "N02 F09")
def _(t):
    return _matrix(t).withColumn("risk_signals", F.array_join("risk_signals", "+")).withColumn("file_exts", F.array_join("file_exts", ","))


_PARAMS = f"""select sample_id, {_sql_list("case sample_id % 4 when 0 then '.py' when 1 then '.py,.md' when 2 then '.toml' else '' end")} as exts, cast(case when sample_id % 4 < 2 then files else 0 end as int) as n, cast(lines as int) as lines, sample_id % 7 = 0 as dep,
  list_filter(string_split(true_reasons, ','), lambda x: x in ('sql_risk', 'auth_change')) as sig from v_samples join v_plans p using (sample_id)"""


def _params(t):
    rows = t.samples.join(t.plans.select("sample_id", "true_reasons"), "sample_id")
    exts = F.split(F.expr("case sample_id % 4 when 0 then '.py' when 1 then '.py,.md' when 2 then '.toml' else '' end"), ",")
    return rows.select("sample_id", F.array_remove(exts, "").alias("file_exts"), F.expr("cast(case when sample_id % 4 < 2 then files else 0 end as int)").alias("python_file_count"), F.col("lines").cast("int").alias("total_lines"),
                       (F.col("sample_id") % 7 == 0).alias("has_dep_files"), F.filter(_list("true_reasons"), lambda x: x.isin("sql_risk", "auth_change")).alias("risk_signals"),
                       F.lit("Python").alias("language"), F.lit("feature").alias("change_type"), F.lit(0).alias("static_findings_count"))


@query("fake_changesets", "N03", f"""with p as ({_PARAMS}) select sample_id, case when i > 0 then 'changed_' || i || '.py' when list_contains(sig, 'auth_change') then 'auth.py' else 'main.py' end as path, cast(greatest(1, lines // greatest(1, n)) as int) as added, cast(greatest(1, lines // greatest(1, n)) // 3 as int) as deleted, 'modified' as change_type
    from (select *, unnest(range(n)) as i from p where n > 0)
  union all select sample_id, case when e = '.md' then 'README.md' else 'config' || e end, cast(greatest(1, lines // greatest(1, len(exts))) as int), 0, 'modified' from (select *, unnest(exts) as e from p) where e <> '.py'
  union all select sample_id, 'requirements.txt', 5, 2, 'modified' from p where dep""")
def _(t):
    return generate.fake_changesets(_params(t))


@query("ground_truth", "N04", f"""with p as (select *, list_contains(exts, '.py') or n > 0 as py from ({_PARAMS}))
  select sample_id, concat_ws(',', 'git', case when py then 'ruff' end, case when py and n between 1 and 50 then 'python_ast' end, case when py and (len(sig) > 0 or lines > 100) then 'bandit' end, case when dep then 'dependency' end) as analyzers,
    concat_ws(',', case when py and n > 50 then 'python_ast_skipped_large_diff' end, case when py and len(sig) > 0 then array_to_string(list_sort(sig), ',') end, case when py and len(sig) = 0 and lines <= 100 then 'bandit_skipped_low_risk' end,
      case when not py and len(exts) > 0 then 'no_python_changes' end, case when dep then 'dependency_change' end) as reason_codes, case when len(sig) >= 3 then 'high' when len(sig) >= 1 then 'medium' else 'low' end as risk_level from p""")
def _(t):
    truth = generate.ground_truth(_params(t))
    return truth.withColumn("analyzers", F.array_join("analyzers", ",")).withColumn("reason_codes", F.array_join("reason_codes", ","))


@query("question_samples", "N05")
def _(t):
    symbols = t.part.select(F.concat(F.lit("load_"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_")).alias("symbol"))
    return generate.question_samples(symbols).withColumn("expected_keywords", F.array_join("expected_keywords", ","))


@query("assemble_samples", "N06", f"""with p as ({_PARAMS}) select sample_id as id, 'review' as mode, case when sample_id % 3 = 0 then '' else o_orderpriority end as scenario, n + len(exts) as files, lines as added_lines, lines // 3 as deleted_lines, case when len(sig) >= 3 then 'high' when len(sig) >= 1 then 'medium' else 'low' end as risk_level
  from p join orders on o_orderkey = sample_id""")
def _(t):
    texts = t.orders.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("change_summary"), F.lit("ast").alias("ast_summary"))
    rows = generate.assemble_samples(_params(t), texts, generate.ground_truth(_params(t)))
    size = "input.diff_size"
    return rows.select("id", "mode", "scenario", F.col(f"{size}.files").cast("bigint").alias("files"), F.col(f"{size}.added_lines").alias("added_lines"), F.col(f"{size}.deleted_lines").alias("deleted_lines"), F.col("ground_truth.risk_level").alias("risk_level"))


@query("baseline_predictions", "N07", f"""with p as ({_PARAMS}), f as (select sample_id, 'changed' || unnest(exts) as path, lines from p), g as (select sample_id, count(*) filter (path like '%.py') as py, sum(case when path like '%.py' then lines + 1 else 0 end) as s from f group by 1)
  select 'p' || sample_id as run_id, concat_ws(',', 'git', case when py > 0 then 'python_ast' end, case when py > 0 then 'ruff' end, case when py > 0 and s > 100 then 'bandit' end) as analyzers, case when py > 0 and s > 500 then 'medium' else 'low' end as risk_level from g""")
def _(t):
    rows = _params(t).select(F.concat(F.lit("p"), F.col("sample_id").cast("string")).alias("run_id"), F.col("file_exts").alias("file_types"), F.col("total_lines").alias("added"), F.lit(1).alias("deleted"))
    plans = aggs.build_plans(generate.baseline_changes(rows))
    return plans.select("run_id", F.array_join("analyzers", ",").alias("analyzers"), "risk_level")


@query("mock_answers", "N08", "select sample_id, answer || case when expected_file is null then '' else chr(10) || chr(10) || '参考位置: ' || expected_file || ':10' end as answer from v_records")
def _(t):
    files = F.array_compact(F.array("expected_file"))
    return generate.mock_answers(t.records.select("sample_id", F.col("answer").alias("expected_answer_summary"), files.alias("expected_evidence_files")))


# --- model output ------------------------------------------------------------------------------------------

_RAW = """case o_orderkey % 6 when 0 then concat('{"verdict": "correct", "score": ', o_custkey % 5, ', "answered_question": true, "uses_supported_evidence": true, "expected_file_coverage": "full", "reason": "r", "missing_points": []}')
  when 1 then concat('```json', chr(10), '{"verdict": "odd", "score": 1}', chr(10), '```') when 2 then concat('Sure: {"a": {"b": "}', o_orderkey, '"}} done') when 3 then 'no json' when 4 then '[1, 2' else '{"x": "open' end"""


def _raw(t):
    return t.orders.selectExpr("o_orderkey as sample_id", f"{_RAW} as raw")


@query("recover_json", "F25", """select o_orderkey as sample_id, case o_orderkey % 6 when 0 then concat('{"verdict": "correct", "score": ', o_custkey % 5, ', "answered_question": true, "uses_supported_evidence": true, "expected_file_coverage": "full", "reason": "r", "missing_points": []}')
  when 1 then '{"verdict": "odd", "score": 1}' when 2 then concat('{"a": {"b": "}', o_orderkey, '"}}') end as json from orders""")
def _(t):
    return _raw(t).select("sample_id", judging.recover_json("raw").alias("json"))


@query("schema_errors", "F26", """select o_orderkey as sample_id, case o_orderkey % 6 when 0 then case when o_custkey % 5 > 2 then concat('score: ', o_custkey % 5, ' > 最大值 2') else '' end
  when 1 then '缺少必需字段: answered_question; 缺少必需字段: uses_supported_evidence; 缺少必需字段: expected_file_coverage; 缺少必需字段: reason; 缺少必需字段: missing_points'
  else '缺少必需字段: verdict; 缺少必需字段: score; 缺少必需字段: answered_question; 缺少必需字段: uses_supported_evidence; 缺少必需字段: expected_file_coverage; 缺少必需字段: reason; 缺少必需字段: missing_points' end as errors from orders where o_orderkey % 6 < 3""")
def _(t):
    rows = _raw(t).withColumn("json", judging.recover_json("raw")).where("json is not null")
    return rows.select("sample_id", F.array_join(judging.schema_errors("json"), "; ").alias("errors"))


@query("planner_output_errors", "F28")
def _(t):
    json = F.expr("""concat('{"question_type": "', case o_orderkey % 3 when 0 then 'trace' else 'why' end, '", "relations": [{"type": "', case o_custkey % 2 when 0 then 'trace_call_chain' else 'x' end, '", "subjects": ["a", ',
      case o_custkey % 3 when 0 then '" "' else '"b"' end, ']}], "required_claims": ', case o_custkey % 4 when 0 then '"no"' else '["c"]' end, '}')""")
    return t.orders.select(F.col("o_orderkey").alias("query_id"), F.array_join(judging.planner_output_errors(json), "; ").alias("errors"))


@query("sufficiency_errors", "F28")
def _(t):
    json = F.expr("""concat('{"sufficient": ', case o_orderkey % 3 when 0 then 'true' else '"yes"' end, ', "reason": "r", "missing_requirements": [{"type": "definition", "symbol": "', case o_custkey % 2 when 0 then 'a.b' else '1x' end,
      '"}], "suggested_actions": [{"tool": "read_window", "symbol": "f", "search_kind": "definition", "line": ', o_custkey % 3 - 1, '}]}')""")
    return t.orders.select(F.col("o_orderkey").alias("query_id"), F.array_join(judging.sufficiency_errors(json), "; ").alias("errors"))


@query("state_decision_errors", "F28")
def _(t):
    json = F.expr("""concat('{"action": "', case o_orderkey % 3 when 0 then 'continue' when 1 then 'answer' else 'stop' end, '", "reason": "r", "work_orders": [', case o_custkey % 2 when 0 then '{"target": "f", "tool_hint": "git"}' else '' end, ']}')""")
    return t.orders.select(F.col("o_orderkey").alias("query_id"), F.array_join(judging.state_decision_errors(json), "; ").alias("errors"))


def _count_words(path: str, text: str) -> dict:
    if "license" in text:
        raise ValueError("cannot read")
    return {"findings": [{"rule_id": "W1", "message": f"{len(text)} characters", "severity": "info", "start_line": 1}]}


@query("run_tool", "X01", "select path, case when contains(text, 'license') then 'failed' else 'success' end as status, case when contains(text, 'license') then 'WORDS_ERROR: cannot read' else length(text) || ' characters' end as note from v_files")
def _(t):
    got = tools.run_tool(t.files, "words", _count_words)
    fault = F.get("diagnostics", F.lit(0))
    return got.select("path", "status", F.coalesce(F.get("findings", F.lit(0))["message"], F.concat(fault["code"], F.lit(": "), fault["message"])).alias("note"))


def _stub_judge(prompts: list[str]) -> list[str | None]:
    """Deterministic stand-in for a model: bad text for some prompts until it is asked to repair it."""
    good = '{"verdict": "correct", "score": 2, "answered_question": true, "uses_supported_evidence": true, "expected_file_coverage": "full", "reason": "ok", "missing_points": []}'
    out: list[str | None] = []
    for p in prompts:
        if p.startswith("fix"):
            out.append(good if "score" in p else "still not json")
        else:
            out.append('{"verdict": "correct", "score": "high"}' if "URGENT" in p else "sorry" if "LOW" in p else good)
    return out


def _judged(rows):
    return tools.judge_with_repair(rows, "sample_id", _stub_judge, lambda raw, errors: F.concat(F.lit("fix "), raw, F.array_join(errors, ";")))


@query("judge_with_repair", "X02 F25 F26", "select o_orderkey as sample_id, case when contains(o_orderpriority, 'LOW') then 'judge_unavailable' end as judge_error_type, contains(o_orderpriority, 'LOW') or contains(o_orderpriority, 'URGENT') as retried, case when contains(o_orderpriority, 'LOW') then 'unjudgeable' else 'correct' end as verdict from orders")
def _(t):
    return _judged(t.orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("prompt"))).select("sample_id", "judge_error_type", "retried", "verdict")


@query("call_model_in_batches", "X02", "select o_orderkey as sample_id, upper(o_orderpriority) as raw, 1 as attempts from orders")
def _(t):
    prompts = t.orders.select(F.col("o_orderkey").alias("sample_id"), F.lower("o_orderpriority").alias("prompt"))
    return tools.call_model(prompts, "sample_id", lambda batch: [p.upper() for p in batch], batch=16).select("sample_id", "raw", "attempts")


# --- streams ------------------------------------------------------------------------------------------------

_STATUS_SQL = """select job_id, arg_max(case event when 'queued' then 'queued' when 'result' then 'completed' else 'running' end, seq) filter (event <> 'end') as status, arg_max(data, seq) filter (event = 'result') as result, cast(null as double) as error,
  bool_or(event = 'end') as ended, max(seq) as last_seq, count(*) as events from v_job_events group by job_id"""


@query("job_status", "R01", _STATUS_SQL)
def _(t):
    return jobs.job_status(t.job_events)


def _event_stream(t):
    events = table_stream(t.spark, t.sf_dir, "events")
    columns = {"job_id": "concat('job_', user_id)", "seq": "event_id", "event": "case event_id % 5 when 0 then 'queued' when 1 then 'running' when 2 then 'plan' when 3 then 'result' else 'end' end", "data": "value"}
    return events.selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


@query("job_status_stream", "R01", _STATUS_SQL)
def _(t):
    return jobs.job_status_stream(_event_stream(t), _folder(t))


@query("active_jobs", "R02", """with a as (select job_id, seq, ts, event, case when event in ('queued', 'running', 'plan') then 1 else 0 end as act from v_job_events),
  d as (select *, act - coalesce(lag(act) over (partition by job_id order by ts, seq), 0) as delta from a) select job_id, seq, event, cast(sum(delta) over (order by ts, seq) as bigint) as active_jobs, sum(delta) over (order by ts, seq) >= 50 as at_limit from d""")
def _(t):
    return jobs.active_jobs(t.job_events.withColumn("clock", clock("ts")).drop("ts", "data"))


@query("active_job_count", "R02", f"select count(*) filter (status in ('queued', 'running')) as active_jobs, count(*) filter (status in ('queued', 'running')) >= 50 as at_limit from ({_STATUS_SQL})")
def _(t):
    return jobs.active_job_count(jobs.job_status_stream(_event_stream(t), _folder(t)))


_LOG_SQL = "select job_id, seq, event, data from v_job_events join (select job_id, min(seq) as e from v_job_events where event = 'end' group by job_id) using (job_id) where seq <= e"


@query("job_event_log", "R03", _LOG_SQL)
def _(t):
    return jobs.job_event_log(t.job_events).select("job_id", "seq", "event", "data")


@query("job_event_log_stream", "R03", _LOG_SQL)
def _(t):
    return jobs.job_event_log_stream(_event_stream(t), _folder(t))


@query("search_stream", "R04", _search_sql(SEARCHES, 20))
def _(t):
    docs = table_stream(t.spark, t.sf_dir, "documents")
    path = """concat(case doc_id % 6 when 0 then 'src/app/' when 1 then 'tests/test_' when 2 then 'docs/' when 3 then 'examples/' when 4 then 'lib/' else 'conf/' end, 'm', doc_id, case doc_id % 6 when 2 then '.md' when 5 then '.toml' else '.py' end)"""
    lines = corpus.explode_lines(docs.selectExpr(f"{path} as path", "text"), ["path"])
    return evaluation.search_stream(lines, SEARCHES, 20, _folder(t))


@query("judge_stream", "R05 X02", "select doc_id as sample_id, case when quality = 1 then 'correct' else 'incorrect' end as verdict from labels")
def _(t):
    records = table_stream(t.spark, t.sf_dir, "labels").selectExpr("doc_id as sample_id", "quality")
    return evaluation.judge_stream(records, lambda df: df.select("sample_id", F.when(F.col("quality") == 1, "correct").otherwise("incorrect").alias("verdict")), _folder(t)).select("sample_id", "verdict")


@query("upsert_stream", "R06", _UPSERT)
def _(t):
    conv = t.conversations
    old = conv.where("turn % 4 < 3").selectExpr("conv_id as user_id", "turn as conv_id", "text as title", "1 + turn % 3 as version")
    updates = table_stream(t.spark, t.sf_dir, "conversations").where("turn % 6 > 0").selectExpr("conv_id as user_id", "turn as conv_id", "upper(role) as title", "case when turn % 4 = 3 then 0 else turn % 3 + turn % 2 end as version", "case when turn % 5 = 4 then 'delete' else 'save' end as op")
    return evaluation.upsert_stream(updates, old, _folder(t)).select("user_id", "conv_id", "outcome", "title", "version")




@query("update_stream", "R06 S24", f"{_FOLDED} select user_id, conv_id, seq, outcome, case when outcome in ('inserted', 'updated') then title end as title, nullif(v, 0) as version from s where n > 0")
def _(t):
    updates = _several(table_stream(t.spark, t.sf_dir, "conversations"))
    return evaluation.update_stream(updates, _stored(t), _folder(t))[0].select("user_id", "conv_id", "seq", "outcome", "title", "version")
