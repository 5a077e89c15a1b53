"""Search, filters and ranking over source lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from revgrain import fixed
from revgrain.operators import ranking, token_index
from revgrain.plans.registry import query

# Word boundaries that treat every letter, digit and underscore as part of a word.
EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}\p{M}_])", r"($|[^\p{L}\p{N}\p{M}_])"

FILE_TYPE_SQL = r"""case
  when len(list_filter(string_split(lower(path), '/'), lambda s: s in ('docs','doc','documentation','docs_src','doc_src'))) > 0 then 'documentation'
  when regexp_matches(stem, 'readme|changelog|contributing|license|authors|index|security') then 'documentation'
  when regexp_matches(fname, '\.(md|rst|txt|adoc)$') then 'documentation'
  when len(list_filter(string_split(lower(path), '/'), lambda s: s in ('tests','test','testing','__tests__','spec'))) > 0 then 'test'
  when regexp_matches(stem, '^(test_|spec_)|(_test|_spec)$') or stem = 'conftest' then 'test'
  when len(list_filter(string_split(lower(path), '/'), lambda s: s in ('examples','example','samples','sample','tutorials','tutorial','demo'))) > 0 then 'example'
  when stem in ('setup.py','setup.cfg','pyproject.toml','makefile','dockerfile','package.json','.gitignore') then 'build'
  when regexp_matches(fname, '\.(cfg|ini|toml|yml|yaml|json)$') then 'config'
  when regexp_matches(fname, '^\.*[^.].*\.(py|js|ts|jsx|tsx|java|go|rs|rb|c|h|cpp|hpp)$') then 'source'
  else 'other' end"""

CLASSED = f"""select *, {FILE_TYPE_SQL} as file_type from (
  select *, case when regexp_extract(fname, '^(\\.*[^.].*)\\.[^.]*$', 1) = '' then fname
    else regexp_extract(fname, '^(\\.*[^.].*)\\.[^.]*$', 1) end as stem
  from (select *, regexp_extract(lower(path), '([^/]*)$', 1) as fname from {{source}}))"""

TYPE_SCORE_SQL = """case file_type when 'source' then 500 when 'test' then 300 when 'example' then 200
  when 'documentation' then 100 when 'config' then 50 when 'build' then 30 else 10 end"""


def _precision_sql(word: str) -> str:
    return f"""case when not contains(lower(snippet), '{word}') then 0
      when regexp_matches(snippet, '{EDGE_L}{word}{EDGE_R}') then 300
      when regexp_matches(snippet, '(?i){EDGE_L}{word}{EDGE_R}') then 250 else 50 end"""


def _search_sql(queries: dict[str, list[str]], k: int) -> str:
    parts = []
    for q, words in queries.items():
        hit = " or ".join(f"contains(lower(line), '{w}')" for w in words)
        precision = f"greatest({', '.join(_precision_sql(w) for w in words)})"
        coverage = " + ".join(f"(case when contains(lower(snippet), '{w}') then 50 else 0 end)" for w in words)
        terms = "concat_ws(',', " + ", ".join(
            f"case when contains(lower(snippet), '{w}') then '{w}' end" for w in words) + ")"
        kws = ", ".join(f"'{w}'" for w in words)
        parts.append(f"""select '{q}' as query_id, path, line_no, snippet, file_type,
          case when regexp_matches(snippet, '^(#|//|--)') then 'comment'
            when lower(regexp_extract(snippet, '(?:(?:class|def|async\\s+def)\\s+|\\bfn\\s+|\\bfunc\\s+(?:\\s*\\([^)]*\\)\\s+)?|\\bfunction\\s+|\\b(?:public|private|protected)?\\s*(?:static\\s+)?(?:class|interface|enum)\\s+)([\\p{{L}}\\p{{N}}_]+)', 1)) in ({kws}) then 'definition'
            when regexp_matches(snippet, '^(import |from )') then 'import'
            when contains(snippet, '(') then 'call' else 'reference' end as hit_type,
          {precision} + {coverage} as word_score, {terms} as matched_terms
        from (select path, line_no, line, file_type,
          left(regexp_replace(line, '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g'), 200) as snippet from classed)
        where {hit}""")
    return f"""with classed as ({CLASSED.format(source='v_lines')}), hits as ({' union all '.join(parts)}),
    scored as (select *, {TYPE_SCORE_SQL} + case hit_type when 'definition' then 500 when 'import' then 400
      when 'call' then 300 when 'reference' then 200 else 100 end + word_score as score from hits),
    best as (select * from scored qualify row_number() over (partition by query_id, path order by score desc, line_no, snippet) = 1)
    select query_id, path, cast(score as int) as score, cast(line_no as int) as line_no, snippet, file_type, hit_type, matched_terms,
      cast(row_number() over (partition by query_id order by score desc, path, line_no, snippet) as int) as rank,
      cast(case hit_type when 'definition' then 0.98 when 'call' then 0.95 when 'import' then 0.9 when 'reference' then 0.8 else 0.6 end as double) as confidence
    from best qualify row_number() over (partition by query_id order by score desc, path, line_no, snippet) <= {k}"""


SEARCHES = {"q_words": ["that", "with", "this"], "q_from": ["from"], "q_data": ["license", "data"]}


@query("search_topk", "W01 F04 F05 F06 P04 S03", _search_sql(SEARCHES, 20))
def _(t):
    return ranking.search_topk(t.lines, SEARCHES, 20)


# Two repositories with the same paths, and one request for each benchmark item, of its long words.
_TWO_REPOS = "select concat('repo', doc_id % 2) as repo, concat('src/m', cast(floor(doc_id / 2) as bigint), '.py') as path, line_no, line from v_lines"


def _word_precision_sql() -> str:
    pattern = lambda flags: f"concat('{flags}{EDGE_L}', word, '{EDGE_R}')"
    return f"""case when not contains(lower(snippet), lower(word)) then 0 when regexp_matches(snippet, {pattern('')}) then 300
      when regexp_matches(snippet, {pattern('(?i)')}) then 250 else 50 end"""


_TABLE_SEARCH_SQL = f"""with src as ({_TWO_REPOS}), classed as ({CLASSED.format(source='src')}),
  asked as (select item_id as query_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]{{7,}}'))) as word from benchmark),
  lines as (select *, left(regexp_replace(line, '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g'), 200) as snippet from classed),
  met as (select query_id, word, repo, path, line_no, snippet, file_type, {_word_precision_sql()} as precision, contains(lower(snippet), lower(word)) as inside,
    lower(word) = lower(regexp_extract(snippet, '(?:(?:class|def|async\\s+def)\\s+|\\bfn\\s+|\\bfunc\\s+(?:\\s*\\([^)]*\\)\\s+)?|\\bfunction\\s+|\\b(?:public|private|protected)?\\s*(?:static\\s+)?(?:class|interface|enum)\\s+)([\\p{{L}}\\p{{N}}_]+)', 1)) as defines
    from lines join asked on contains(lower(line), lower(word))),
  hits as (select query_id, repo, path, line_no, snippet, file_type, max(precision) + 50 * count(*) filter (inside) as word_score, bool_or(defines) as defines,
    coalesce(string_agg(word, ',' order by word) filter (inside), '') as matched_terms from met group by all),
  kinds as (select *, case when regexp_matches(snippet, '^(#|//|--)') then 'comment' when defines then 'definition' when regexp_matches(snippet, '^(import |from )') then 'import'
    when contains(snippet, '(') then 'call' else 'reference' end as hit_type from hits),
  scored as (select *, {TYPE_SCORE_SQL} + case hit_type when 'definition' then 500 when 'import' then 400 when 'call' then 300 when 'reference' then 200 else 100 end + word_score as score from kinds),
  best as (select * from scored qualify row_number() over (partition by query_id, repo, path order by score desc, line_no, snippet) = 1)
  select query_id, repo, path, cast(score as int) as score, cast(line_no as int) as line_no, snippet, file_type, hit_type, matched_terms,
    cast(row_number() over (partition by query_id, repo order by score desc, path, line_no, snippet) as int) as rank,
    cast(case hit_type when 'definition' then 0.98 when 'call' then 0.95 when 'import' then 0.9 when 'reference' then 0.8 else 0.6 end as double) as confidence
  from best qualify row_number() over (partition by query_id, repo order by score desc, path, line_no, snippet) <= 20"""


@query("search_topk_table", "W01 F04 F05 F06", _TABLE_SEARCH_SQL)
def _(t):
    lines = t.lines.selectExpr("concat('repo', doc_id % 2) as repo", "concat('src/m', cast(floor(doc_id / 2) as bigint), '.py') as path", "line_no", "line")
    words = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))))
    return token_index.search_topk(lines, t.benchmark.select(F.col("item_id").alias("query_id"), words.alias("words")), 20, ["repo", "path"])


_FILE_WORDS = {"q_m1": "m1", "q_test": "test", "q_app": "app"}


@query("filename_search", "W02", " union all ".join(f"""select * from (select '{q}' as query_id, path, file_type, cast({TYPE_SCORE_SQL} + case when contains(fname, '{w}') then 200 else 0 end as int) as score,
    cast(row_number() over (order by {TYPE_SCORE_SQL} + case when contains(fname, '{w}') then 200 else 0 end desc, path) as int) as rank
  from ({CLASSED.format(source='v_files')}) where contains(path, '{w}')) where rank <= 50""" for q, w in _FILE_WORDS.items()))
def _(t):
    return ranking.filename_search(t.files, _FILE_WORDS, 50)


_TERMS = {"r_from": ("io.from", "references"), "r_call": ("data", "callers"), "r_text": ("e.g", "literal")}
_BAD_DIR = "len(list_filter(string_split(lower(path), '/'), lambda s: s in ('docs','docs_src','examples','tests','test','benchmarks','scripts','__pycache__'))) > 0"


def _reference_sql() -> str:
    tests = {"r_from": f"regexp_matches(line, '{EDGE_L}from{EDGE_R}')", "r_call": f"regexp_matches(line, '{EDGE_L}data\\s*\\(') and prio = 0", "r_text": "contains(line, 'e.g')"}
    parts = " union all ".join(f"select '{q}' as query_id, * from src where {c}" for q, c in tests.items())
    return f"""with src as (select path, line_no, line, case when {_BAD_DIR} then 1 else 0 end as prio from v_lines where ends_with(path, '.py')),
      hits as ({parts}), a as (select *, row_number() over (partition by query_id, path order by line_no) as hr, dense_rank() over (partition by query_id order by prio, path) as fr from hits),
      b as (select *, row_number() over (partition by query_id order by fr, line_no) as rank from a where hr <= 3 and (fr < 20 or (fr = 20 and hr = 1)))
      select query_id, cast(rank as int) as rank, path, cast(line_no as int) as line_no,
        regexp_replace(line, '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g') as snippet from b where rank <= 50"""


@query("reference_search", "W03 P05", _reference_sql())
def _(t):
    return ranking.reference_search(t.lines, _TERMS)


_EV = "select run_id as query_id, ev_id, file, confidence, ev_id as seq from v_evidence"


@query("select_evidence", "W04", f"""with a as (select *, row_number() over (partition by query_id, file order by confidence desc, seq) as fr from ({_EV})),
  b as (select *, row_number() over (partition by query_id order by fr > 3, confidence desc, seq) as rank from a)
  select query_id, ev_id, file, confidence, cast(rank as int) as rank from b where rank <= 20""")
def _(t):
    ev = t.evidence.select(F.col("run_id").alias("query_id"), "ev_id", "file", "confidence", F.col("ev_id").alias("seq"))
    return ranking.select_evidence(ev).drop("seq")


@query("truncate_evidence", "W06")
def _(t):
    return ranking.truncate_evidence(t.judged_evidence).select("sample_id", "ev_id", "place")


# Rules come from the caller.
_RULES = [{"content": "c1", "source": "s1", "tags": ["that", "with"]}, {"content": "c2", "source": "s2", "tags": ["this"]},
          {"content": "c3", "source": "s3", "tags": ["from", "license", "the"]}]


def _knowledge_sql(k: int) -> str:
    parts = " union all ".join(
        "select doc_id as query_id, " + " + ".join(f"(case when contains(lower(text), '{w}') then 1 else 0 end)" for w in r["tags"])
        + f" as score, {i} as rule, '{r['source']}' as source, '{r['content']}' as content from documents" for i, r in enumerate(_RULES))
    return f"""select query_id, cast(row_number() over (partition by query_id order by score desc, rule) as int) as rank, rule, source, content, score
      from ({parts}) where score > 0 qualify row_number() over (partition by query_id order by score desc, rule) <= {k}"""


@query("knowledge_topk", "W07", _knowledge_sql(5))
def _(t):
    return ranking.knowledge_topk(t.documents.select(F.col("doc_id").alias("query_id"), "text"), _RULES)


@query("vector_topk", "W08", """with q as (select label, arg_min(embedding, vec_id) as v from embeddings group by label),
  s as (select concat('q', q.label) as query_id, e.label as collection, vec_id as item_id, list_cosine_similarity(cast(q.v as double[]), cast(embedding as double[])) as similarity from q, embeddings e)
  select query_id, collection, item_id, round(similarity, 6) as similarity, cast(row_number() over (partition by query_id, collection order by similarity desc, item_id) as int) as rank from s
  qualify row_number() over (partition by query_id, collection order by similarity desc, item_id) <= 5""")
def _(t):
    items = t.embeddings.select(F.col("label").alias("collection"), F.col("vec_id").alias("item_id"), "embedding")
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))  # one request per collection
    requests = [(f"q{r['label']}", list(r["v"])) for r in first.orderBy("label").collect()]
    return ranking.vector_topk(items, requests).withColumn("similarity", F.round("similarity", 6))


_QUESTIONS = {"q1": "where is the review pipeline module m12", "q2": "项目结构 lib tests", "q3": "zzz"}


@query("map_select", "W10", """with r as (select path, lower(concat(path, ' pipeline', doc_id % 5)) as low from v_files),
  s as (select 'q1' as query_id, path, (case when contains(low, 'where') then 1 else 0 end) + (case when contains(low, 'the') then 1 else 0 end) + (case when contains(low, 'review') then 1 else 0 end)
      + (case when contains(low, 'pipeline') then 1 else 0 end) + (case when contains(low, 'module') then 1 else 0 end) + (case when contains(low, 'm12') then 1 else 0 end) + (case when contains(lower(path), 'pipeline') then 4 else 0 end) as score from r
    union all select 'q2', path, (case when contains(low, 'lib') then 1 else 0 end) + (case when contains(low, 'tests') then 1 else 0 end) from r union all select 'q3', path, 0 from r),
  h as (select query_id, path, score, row_number() over (partition by query_id order by score desc, path) as rank from s where score > 0),
  f as (select query_id, path, score, row_number() over (partition by query_id order by path) as rank from s where query_id not in (select query_id from h))
  select query_id, path, cast(score as int) as score, cast(rank as int) as rank from h where rank <= 6 union all select query_id, path, cast(score as int), cast(rank as int) from f where rank <= 3""")
def _(t):
    records = t.files.select("path", F.array(F.expr("concat('pipeline', doc_id % 5)")).alias("symbols"))
    return ranking.map_select(records, _QUESTIONS)


@query("gap_rank", "W11", """select query_id, symbol, slot, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by case slot when 'verified_callee_edge' then 0 when 'verified_caller_edge' then 0
    when 'implementation' then 1 when 'definition' then 2 else 3 end, seq) as rank from v_target_slots where not verified and not blocked) where rank <= 3""")
def _(t):
    return ranking.gap_rank(t.target_slots.where("not verified and not blocked")).select("query_id", "symbol", "slot", "rank")


@query("rank_context_files", "W12", r"""select run_id as query_id, file, count(*) as hits, bool_or(regexp_matches(snippet, '(?i)\b(?:class|def)\s+(sym1|sym12)\b')) as defines, false as low_priority from v_evidence group by all""")
def _(t):
    return ranking.rank_context_files(t.evidence.withColumnRenamed("run_id", "query_id"), ["sym1", "sym12"])


@query("best_candidate", "W13", f"select doc_id % 50 as name, path from v_files qualify row_number() over (partition by doc_id % 50 order by case when {_BAD_DIR} then 1 else 0 end, doc_id) = 1")
def _(t):
    rows = t.files.select((F.col("doc_id") % 50).alias("name"), "path", F.col("doc_id").alias("seq"))
    return ranking.best_candidate(rows, ["name"]).select("name", "path")


@query("context_windows", "W14", """with h as (select concat('run_', l_orderkey % 20) as query_id, concat('src/m', l_partkey % 40, '.py') as path, l_suppkey * 37 % 4000 as line_no, max(case when l_returnflag = 'R' then 4 else 1 end) as weight
    from lineitem where l_suppkey * 37 % 4000 between 1 and 3900 group by all),
  s as (select *, greatest(1, line_no - 30) as s, least(3900, line_no + 30) as e from h),
  o as (select *, case when lag(e) over w is null or s > lag(e) over w + 1 then 1 else 0 end as opens from s window w as (partition by query_id, path order by line_no)),
  i as (select *, sum(opens) over (partition by query_id, path order by line_no) as island from o),
  g as (select query_id, path, min(s) as start_line, max(e) as end_line, sum(weight) as weight from i group by query_id, path, island),
  k as (select *, row_number() over (partition by query_id, path order by weight desc, start_line) as r from g)
  select query_id, path, start_line, end_line, cast(weight as bigint) as weight, cast(row_number() over (partition by query_id, path order by start_line) as int) as window_no from k where r <= 3""")
def _(t):
    hits = t.lineitem.selectExpr("concat('run_', l_orderkey % 20) as query_id", "concat('src/m', l_partkey % 40, '.py') as path", "l_suppkey * 37 % 4000 as line_no",
                                 "l_returnflag = 'R' as is_definition", "bigint(3900) as n_lines")
    return ranking.context_windows(hits)


@query("snippet_windows", "W15", """with h as (select path, line_no from v_lines where contains(line, 'license'))
  select h.path, cast(h.line_no as int) as line_no, string_agg(concat(l.line_no, '| ', l.line), chr(10) order by l.line_no) as snippet, cast(max(l.line_no) as int) as end_line
  from h join v_lines l on l.path = h.path and l.line_no between h.line_no - 2 and h.line_no + 5 group by h.path, h.line_no""")
def _(t):
    return ranking.snippet_windows(t.lines.where(F.col("line").contains("license")), t.lines, 2, 5)


def _read_sql(lines: str, keys: str, window: str, by: str = "") -> str:
    """Windows read line by line: ``window`` gives (keys, by, line_no, before, after) of the hits in ``src``."""
    own = f"{keys}, {by + ', ' if by else ''}line_no"
    same = " and ".join(f"w.{c.strip()} is not distinct from s.{c.strip()}" for c in own.split(","))
    met = " and ".join(f"l.{c.strip()} = h.{c.strip()}" for c in keys.split(","))
    return f"""with recursive src as materialized ({lines}), h as ({window}),
    w as materialized (select {', '.join('h.' + c.strip() for c in own.split(','))}, l.line_no as n, concat(l.line_no, '| ', l.line) as t,
      regexp_replace(l.line, '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g') as bare,
      row_number() over (partition by {', '.join('h.' + c.strip() for c in own.split(','))} order by l.line_no) as i from h join src l on {met} and l.line_no between h.line_no - h.before and h.line_no + h.after),
    s as (select {own}, n as first, i, t as snippet, length(t) + 1 as chars, 1 as kept, false as done from w where i = 1
      union all select {', '.join('s.' + c.strip() for c in own.split(','))}, first, w.i, case when s.chars + length(t) > {fixed.WINDOW_CHARS} then snippet else concat(snippet, chr(10), t) end,
        case when s.chars + length(t) > {fixed.WINDOW_CHARS} then s.chars else s.chars + length(t) + 1 end, case when s.chars + length(t) > {fixed.WINDOW_CHARS} then kept else kept + 1 end,
        s.chars + length(t) > {fixed.WINDOW_CHARS} and regexp_matches(bare, '^($|def |class |return|raise|if |for )')
      from s join w on {same} and w.i = s.i + 1 where not done)
    select {own}, snippet, cast(first + kept - 1 as int) as end_line from s qualify row_number() over (partition by {own} order by i desc) = 1"""


_BEFORE, _AFTER = fixed.DEFAULT_WINDOW


@query("read_windows", "W15", _read_sql("select path, cast(line_no as int) as line_no, line from v_lines", "path",
                                        f"select path, line_no, {_BEFORE} as before, {_AFTER} as after from src where contains(line, 'license')"))
def _(t):
    return ranking.snippet_windows(t.lines.where(F.col("line").contains("license")), t.lines, _BEFORE, _AFTER, fixed.WINDOW_CHARS)


_ASKED = "case line_no % 4 when 0 then 'explain' when 1 then 'trace' when 2 then 'impact' else 'locate' end"


@query("read_windows_by_type", "W15", _read_sql(f"select repo, path, cast(line_no as int) as line_no, line from ({_TWO_REPOS})", "repo, path", f"""select *, case question_type when 'explain' then 5 when 'trace' then 5 when 'impact' then 5 else 20 end as before,
    case question_type when 'explain' then 120 when 'trace' then 80 when 'impact' then 80 else 60 end as after
    from (select repo, path, line_no, {_ASKED} as question_type from src where contains(line, 'license') union all select repo, path, line_no, 'explain' from src where contains(line, 'data') and line_no % 4 <> 0)""", "question_type"))
def _(t):
    lines = t.lines.selectExpr("concat('repo', doc_id % 2) as repo", "concat('src/m', cast(floor(doc_id / 2) as bigint), '.py') as path", "line_no", "line")
    asked = lines.where("contains(line, 'license')").selectExpr("repo", "path", "line_no", f"{_ASKED} as question_type")
    more = lines.where("contains(line, 'data') and line_no % 4 <> 0").selectExpr("repo", "path", "line_no", "'explain' as question_type")
    return ranking.read_windows(asked.unionByName(more), lines, ["repo", "path"])


@query("stratified_sample", "W16", """with s as (select sample_id, seq, risk_level, language = 'python' or language = 'go' as py, language <> 'python' as other, files from v_samples),
  b as (select sample_id, seq, case when risk_level = 'high' then 1 when risk_level = 'medium' then 2 when not py then 4 when other then 5 else 3 end as part from s union all select sample_id, seq, 6 from s where files = 0 or files > 50),
  r as (select *, row_number() over (partition by part order by seq) as rn from b), q as (select * from r where rn <= [8, 10, 8, 4, 4, 2][part]),
  d as (select * from q qualify row_number() over (partition by sample_id order by part, rn) = 1)
  select sample_id, case part when 1 then 'high' when 2 then 'medium' when 3 then 'low' when 4 then 'non_python' when 5 then 'mixed' else 'edge' end as bucket from d order by part, rn limit 40""")
def _(t):
    rows = t.samples.select("sample_id", "seq", "risk_level", F.col("language").isin("python", "go").alias("has_python"), (F.col("language") != "python").alias("has_other"), "files")
    return ranking.stratified_sample(rows, 40).select("sample_id", "bucket")


@query("dedupe_first", "W17", "select group_id, sample_id from v_samples qualify row_number() over (partition by group_id order by seq) = 1")
def _(t):
    return ranking.dedupe_first(t.samples.select("group_id", "sample_id", "seq"), ["group_id"], [F.asc("seq")]).drop("seq")


_CODE_LINES = """select concat('src/m', l_partkey % 40, '.py') as path, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as line_no,
  concat(case l_suppkey % 5 when 0 then '  def ' when 1 then 'class ' when 2 then 'async  def ' when 3 then 'x = ' else 'Function ' end, 'Sym', l_partkey % 13, '(x)') as line from lineitem"""


@query("definition_lines", "W18", f"""select path, line_no, cast(row_number() over (partition by path order by line_no) as int) as rank from ({_CODE_LINES})
  where regexp_matches(line, '(?i)^\\s*(?:class|def|async\\s+def|function)\\s+(sym1|sym12)\\b') qualify row_number() over (partition by path order by line_no) <= 5""")
def _(t):
    return ranking.definition_lines(t.spark.sql(_CODE_LINES.replace("from lineitem", "from {lineitem}"), lineitem=t.lineitem), ["sym1", "sym12"]).select("path", "line_no", "rank")


@query("most_recent", "W19", "select o_orderkey, o_custkey from orders order by o_orderdate desc, o_orderkey limit 100")
def _(t):
    return ranking.most_recent(t.orders, "o_orderdate", ["o_orderkey"], 100).select("o_orderkey", "o_custkey")
