"""Python facts and the code graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from revgrain.operators import fact_store, graph, pycode
from revgrain.plans.registry import query
from revgrain.session import cut_lineage, shared_folder
from revgrain.sources import corpus

_GOOD = "(select * from v_code where not broken)"


def _facts(t):
    return pycode.python_facts(t.code)


def _code_lines(t):
    return corpus.explode_lines(t.code, ["path"])


_SYM = f"""select path, 'C' || k as name, 'class' as kind, 4 as start_line from {_GOOD} union all select path, 'run', 'function', 5 from {_GOOD} union all select path, 'save', 'function', 9 from {_GOOD}
  union all select path, 'helper' || (k % 10), 'function', 11 from {_GOOD} union all select path, 'route' || k, 'function', 14 from {_GOOD}
  union all select path, 'os', 'import', 1 from {_GOOD} union all select path, 'requests', 'import', 1 from {_GOOD} union all select path, 'pkg.m' || (k + 1) || '.C' || (k + 1), 'import', 2 from {_GOOD}
  union all select path, 'm' || (k + 2) || '.Next', 'import', 3 from {_GOOD}"""


@query("python_symbols", "X03", _SYM)
def _(t):
    return pycode.symbols(_facts(t)).select("path", "name", "kind", "start_line")


@query("parse_evidence", "X03", "select path, case when broken then 'parse error — skipped' else 'parsed 9 symbols' end as snippet from v_code")
def _(t):
    return pycode.parse_evidence(_facts(t))


@query("line_kinds", "X03 F06", f"""select path, 11 as line_no, 'definition' as kind from {_GOOD} union all select path, 8, 'call' from {_GOOD} union all select path, unnest([1, 2, 3]), 'import' from {_GOOD}""")
def _(t):
    return pycode.line_kinds(_facts(t), ["helper"])


@query("python_calls", "X04", f"""select path, 'run' as func, 6 as line, 'self.save' as callee_expr, 'self' as receiver, 'C' || k || '.save' as callee from {_GOOD} union all select path, 'run', 7, 'super().run', 'super', 'Base.run' from {_GOOD}
  union all select path, 'run', 7, 'super', 'bare', 'super' from {_GOOD} union all select path, 'run', 8, 'helper' || (k % 10), 'bare', 'helper' || (k % 10) from {_GOOD} union all select path, 'save', 10, 'x.items.put', 'variable', 'x.items.put' from {_GOOD}
  union all select path, 'save', 10, 'str', 'bare', 'str' from {_GOOD} union all select path, 'route' || k, 15, 'Next.run', 'variable', 'Next.run' from {_GOOD} union all select path, 'route' || k, 15, 'Next', 'bare', 'Next' from {_GOOD}""")
def _(t):
    return pycode.calls(_facts(t)).drop("owner")


@query("python_imports", "X05", f"""select path, 'os' as module, 1 as line, 'import' as kind from {_GOOD} union all select path, 'requests', 1, 'import' from {_GOOD} union all select path, 'pkg', 2, 'from' from {_GOOD}
  union all select path, 'm' || (k + 2), 3, 'from_relative' from {_GOOD}""")
def _(t):
    return pycode.imports(_facts(t)).drop("times")


@query("external_imports", "A26", f"select path, '外部依赖引用: m' || (k + 2) || ', pkg, requests' as message, 1 as start_line, 'low' as severity, 'EXTERNAL_IMPORT' as rule_id from {_GOOD}")
def _(t):
    return pycode.external_imports(pycode.imports(_facts(t)))


@query("route_evidence", "X06 F08", f"""select path, 14 as start_line, 14 as end_line, s as snippet, 'ev_' || left(md5('HEAD|' || path || '|14|14|' || s), 8) as ev_id from (select path, 'GET /items/' || k || ' -> route' || k as s from {_GOOD})""")
def _(t):
    return pycode.route_evidence(pycode.routes(_facts(t)))


@query("route_listing", "X06", f"select path, 14 as line, '- GET /items/' || k || ' -> route' || k as item from {_GOOD}")
def _(t):
    return pycode.route_listing(pycode.routes(_facts(t)))


@query("name_index", "G01", """select distinct regexp_extract(line, '^\\s*(?:async\\s+def|def|class)\\s+([A-Za-z0-9_]+)', 1) as name, path from (select path, unnest(string_split(text, chr(10))) as line from v_code)
  where regexp_matches(line, '^\\s*(?:async\\s+def|def|class)\\s+([A-Za-z0-9_]+)')""")
def _(t):
    return graph.name_index(_code_lines(t))


_MODULES = """select regexp_replace(replace(regexp_replace(path, '\\.py$', ''), '/', '.'), '^\\.', '') as module, path from (select path from v_code) union all select replace(regexp_replace(substr(path, 5), '\\.py$', ''), '/', '.'), path from v_code"""


@query("module_index", "G02", _MODULES)
def _(t):
    return graph.module_index(t.code)


def _requests(t):
    """One symbol request per order, in each of the forms that resolve and some that do not."""
    return t.orders.selectExpr("""case o_orderkey % 6 when 0 then concat('pkg.m', o_custkey, '.C', o_custkey, '.run') when 1 then concat('C', o_custkey, '.save') when 2 then concat('helper', o_custkey % 12)
      when 3 then concat('pkg.m', o_custkey, '.Next') when 4 then concat('pkg.m', o_custkey, '.Far') else concat('src.pkg.m', o_custkey, '.nothing') end as symbol""")


_REQ = """(select distinct case o_orderkey % 6 when 0 then concat('pkg.m', o_custkey, '.C', o_custkey, '.run') when 1 then concat('C', o_custkey, '.save') when 2 then concat('helper', o_custkey % 12)
      when 3 then concat('pkg.m', o_custkey, '.Next') when 4 then concat('pkg.m', o_custkey, '.Far') else concat('src.pkg.m', o_custkey, '.nothing') end as symbol from orders)"""


@query("longest_module_prefix", "G03", f"""with m as ({_MODULES}), c as (select symbol, module, path from {_REQ} r join m on symbol = module or starts_with(symbol, module || '.')),
  b as (select symbol, arg_max(module, length(module)) as module, arg_max(path, length(module)) as module_path from c group by symbol)
  select symbol, coalesce(module, '') as module, module_path, case when module is null then symbol when module = symbol then '' else substr(symbol, length(module) + 2) end as remainder from {_REQ} left join b using (symbol)""")
def _(t):
    return graph.longest_module_prefix(_requests(t), graph.module_index(t.code))


def _graph(t):
    facts = cut_lineage(_facts(t))  # every use below reads the stored facts; no file is parsed twice
    modules = graph.module_index(t.code)
    edges = cut_lineage(graph.import_edges(pycode.import_targets(facts), modules, t.code.select("path")))
    return facts, modules, edges, pycode.definitions(facts)


# Next of module k is class C(k+1) of module k+1; Far is the Next of module k+2, so C(k+3) of module k+3.
@query("chase_reexports", "G04", """with g as (select k from v_code where not broken) select 'n' || g.k as request, 'src/pkg/m' || (g.k + 1) || '.py' as path, 'C' || (g.k + 1) as name, 4 as line, 1 as hops from g where g.k + 1 in (select k from g)
  union all select 'f' || g.k, 'src/pkg/m' || (g.k + 3) || '.py', 'C' || (g.k + 3), 4, 2 from g where g.k + 2 in (select k from g) and g.k + 3 in (select k from g)""")
def _(t):
    _, _, edges, defs = _graph(t)
    good = t.code.where("not broken")
    starts = good.selectExpr("concat('n', k) as request", "path", "'Next' as name").unionByName(good.selectExpr("concat('f', k) as request", "path", "'Far' as name"))
    return graph.chase_reexports(starts, edges, defs).select("request", "path", "name", "line", "hops")


# --- two repositories that share paths, modules, names and texts; b lacks every seventh file -------------------


def _two(t):
    both = t.code.withColumn("repo", F.lit("a")).unionByName(t.code.where("k % 7 <> 0").withColumn("repo", F.lit("b")))
    store = f"{shared_folder(t.spark).rstrip('/')}/facts-{uuid.uuid4().hex}"
    fact_store.add_contents(both, store)
    return both, cut_lineage(fact_store.facts_of(both, store, ["repo"]))


_IN_B = "try_cast(regexp_extract(path, 'm(\\d+)\\.py$', 1) as bigint) % 7 <> 0"


@query("python_symbols_by_repository", "X03", f"with s as ({_SYM}) select 'a' as repo, * from s union all select 'b', * from s where {_IN_B}")
def _(t):
    return pycode.symbols(_two(t)[1], ["repo"]).select("repo", "path", "name", "kind", "start_line")


@query("chase_reexports_by_repository", "G01 G02 G04", """with g as (select 'a' as repo, k from v_code where not broken union all select 'b', k from v_code where not broken and k % 7 <> 0)
  select repo, 'n' || k as request, 'src/pkg/m' || (k + 1) || '.py' as path, 'C' || (k + 1) as name, 4 as line, 1 as hops from g where (repo, k + 1) in (select (repo, k) from g)
  union all select repo, 'f' || k, 'src/pkg/m' || (k + 3) || '.py', 'C' || (k + 3), 4, 2 from g where (repo, k + 2) in (select (repo, k) from g) and (repo, k + 3) in (select (repo, k) from g)""")
def _(t):
    both, facts = _two(t)
    edges = graph.import_edges(pycode.import_targets(facts, ["repo"]), graph.module_index(both, ["repo"]), both.select("repo", "path"), ["repo"])
    good = both.where("not broken")
    starts = good.selectExpr("repo", "concat('n', k) as request", "path", "'Next' as name").unionByName(good.selectExpr("repo", "concat('f', k) as request", "path", "'Far' as name"))
    return graph.chase_reexports(starts, cut_lineage(edges), pycode.definitions(facts, ["repo"]), keys=["repo"]).select("repo", "request", "path", "name", "line", "hops")


def _first_named(word: str) -> str:
    return f"(select min('src/pkg/m' || k || '.py') from g where {word})"


_RESOLVED = f"""with g as (select k from v_code where not broken), p as (select symbol, try_cast(regexp_extract(symbol, '(?:m|^C)(\\d+)', 1) as bigint) as k from {_REQ}),
  a as (select symbol, 'src/pkg/m' || k || '.py' as path, 5 as line, 0 as stage from p where symbol like '%.run' and k in (select k from g)
    union all select symbol, {_first_named('true')}, 5, 2 from p where symbol like '%.run' and k not in (select k from g)
    union all select symbol, 'src/pkg/m' || k || '.py', 9, 1 from p where symbol like 'C%.save' and k in (select k from g) union all select symbol, {_first_named('true')}, 9, 2 from p where symbol like 'C%.save' and k not in (select k from g)
    union all select symbol, {_first_named("symbol = 'helper' || (k % 10)")}, 11, 2 from (select symbol from p where symbol like 'helper%') where regexp_matches(symbol, '^helper[0-9]$')
    union all select symbol, 'src/pkg/m' || (k + 1) || '.py', 4, 0 from p where symbol like '%.Next' and k in (select k from g) and k + 1 in (select k from g)
    union all select symbol, 'src/pkg/m' || (k + 3) || '.py', 4, 0 from p where symbol like '%.Far' and k in (select k from g) and k + 2 in (select k from g) and k + 3 in (select k from g))"""


@query("resolve_symbols", "G05 W13", f"{_RESOLVED} select symbol, path, line, stage from a")
def _(t):
    _, modules, edges, defs = _graph(t)
    return graph.resolve_symbols(_requests(t), modules, edges, defs).select("symbol", "path", "line", "stage")


@query("resolved_evidence", "G06 W15 F08")
def _(t):
    _, modules, edges, defs = _graph(t)
    return graph.resolved_evidence(graph.resolve_symbols(_requests(t), modules, edges, defs), _code_lines(t))


@query("callee_edges", "J10", f"""select path, 'run' as func, 6 as line, 'C' || k || '.save' as callee from {_GOOD} union all select path, 'run', 7, 'Base.run' from {_GOOD} union all select path, 'run', 8, 'helper' || (k % 10) from {_GOOD}
  union all select path, 'route' || k, 15, 'Next.run' from {_GOOD}""")
def _(t):
    facts = cut_lineage(_facts(t))
    return graph.callee_edges(pycode.calls(facts), pycode.definitions(facts)).select("path", "func", "line", "callee")


@query("caller_edges", "J11 Q4", "select path, 15 as line_no, 'run' as name from v_code union all select path, 10, 'put' from v_code")
def _(t):
    names = t.code.selectExpr("explode(array('run', 'put', concat('helper', k % 10), 'save')) as name")
    return graph.caller_edges(_code_lines(t), names).select("path", "line_no", "name")


@query("discover_callees", "G08", """with e as (select l_orderkey as query_id, concat('task_', l_partkey % 40) as task_id, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as seq, l_suppkey % 5 as s, l_partkey, l_suppkey from lineitem where l_orderkey % 6 in (3, 4)),
  f as (select query_id, task_id, seq, 0 as pos, 'callee' || (l_partkey % 9) as symbol from e where s = 3 union all select query_id, task_id, seq, 0, 'sym' || (l_suppkey % 40) from e where s = 1 union all select query_id, task_id, seq, 1, 'call' || (l_suppkey % 7) from e where s = 1),
  d as (select query_id, task_id, symbol, min((seq, pos)) as first from f where symbol not in ('call1', 'call2') group by all)
  select query_id, task_id, symbol, cast(row_number() over (partition by query_id, task_id order by first, symbol) as int) as rank from d qualify rank <= 3""")
def _(t):
    ev = t.task_evidence.join(t.lineitem.selectExpr("concat('ev_', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey) as ev_id", "concat('callee', l_partkey % 9) as symbol"), "ev_id")
    ev = ev.withColumn("question_type", F.expr("case query_id % 6 when 3 then 'trace' when 4 then 'impact' else 'locate' end"))
    known = t.orders.select(F.col("o_orderkey").alias("query_id"), F.explode(F.array(F.lit("call1"), F.lit("call2"))).alias("symbol"))
    return graph.discover_callees(ev, known)


@query("call_graph", "G09", """with e as (select distinct o_custkey as source, (o_orderkey * 7) % 1500 as target from orders), s as (select c_custkey as start from customer),
  a as (select distinct start, target as node from s join e on start = source where target <> start), b as (select distinct a.start, e.target as node from a join e on a.node = e.source where e.target <> a.start and (a.start, e.target) not in (select start, node from a))
  select start, node, 1 as depth from a union all select start, node, 2 from b""")
def _(t):
    edges = t.orders.selectExpr("o_custkey as source", "(o_orderkey * 7) % 1500 as target")
    return graph.call_graph(edges, t.customer.select(F.col("c_custkey").alias("start")), 2)
