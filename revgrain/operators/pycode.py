"""Facts of Python source files: symbols, imports, calls, routes and line kinds.

Only the parse itself runs in Python workers, one file at a time, in Arrow batches; it emits flat fact rows. Everything
derived from them (normalised callees, top modules, line kinds, listings) is DataFrame work.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType

from revgrain.functions import text as text_functions
from revgrain.functions.patterns import any_of
from revgrain.operators.ranking import top_per_key

FACTS = (
    "path string, fact string, name string, kind string, line int, end_line int, owner string, base string, "
    "receiver string, module string, level int, alias string, seq int, calls array<string>"
)
#: Facts that a Python worker holds before it gives them out.
FACT_ROWS = 4096
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD"]
# Modules of the standard library that newer interpreters no longer ship.
REMOVED_STDLIB = [
    "aifc", "asynchat", "asyncore", "audioop", "binhex", "cgi", "cgitb", "chunk", "crypt", "distutils", "imghdr", "imp",
    "lib2to3", "mailcap", "msilib", "nis", "nntplib", "ossaudiodev", "pipes", "smtpd", "sndhdr", "spwd", "sunau",
    "telnetlib", "test", "uu", "xdrlib",
]


def stdlib_modules() -> list[str]:
    return sorted({m for m in sys.stdlib_module_names if not m.startswith("_")} | set(REMOVED_STDLIB))


def _facts_of(path: str, source: str) -> Iterator[dict]:
    import ast

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        yield {"fact": "error", "name": "parse error — skipped"}
        return
    seq = 0
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def dotted(node) -> str:
        if isinstance(node, ast.Attribute):
            return f"{dotted(node.value)}.{node.attr}"
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            return node.func.id
        return node.id if isinstance(node, ast.Name) else ""

    # (node, innermost class, its first base, innermost function): breadth first, so outer definitions come first
    queue = [(tree, "", "", None)]
    for node, owner, base, function in queue:
        seq += 1
        inner = (owner, base, function)
        if isinstance(node, ast.ClassDef):
            bases = [dotted(b) for b in node.bases]
            yield {"fact": "symbol", "name": node.name, "kind": "class", "line": node.lineno, "end_line": node.end_lineno, "owner": owner, "seq": seq}
            inner = (node.name, bases[0] if bases else "", None)
        elif isinstance(node, functions):
            called = [c.func.id for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)]
            kind = "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
            yield {"fact": "symbol", "name": node.name, "kind": kind, "line": node.lineno, "end_line": node.end_lineno,
                   "owner": owner, "seq": seq, "calls": called}
            for mark in node.decorator_list:
                if isinstance(mark, ast.Call) and isinstance(mark.func, ast.Attribute) and mark.args:
                    first = mark.args[0]
                    if isinstance(first, ast.Constant) and isinstance(first.value, str):
                        yield {"fact": "route", "name": node.name, "kind": mark.func.attr.upper(), "module": first.value, "line": node.lineno, "seq": seq}
            inner = (owner, base, node.name)
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield {"fact": "import", "kind": "import", "module": a.name, "alias": a.asname or a.name, "line": node.lineno, "level": 0, "seq": seq}
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield {"fact": "import", "kind": "from_relative" if node.level else "from", "module": node.module, "name": a.name,
                       "alias": a.asname or a.name, "line": node.lineno, "level": node.level, "seq": seq}
        elif isinstance(node, ast.Call):
            target = node.func
            if isinstance(target, (ast.Name, ast.Attribute)):
                plain = isinstance(target, ast.Name)
                yield {"fact": "call", "name": target.id if plain else target.attr, "kind": "name" if plain else "attribute", "line": node.lineno,
                       "owner": owner, "base": base, "receiver": "" if plain else dotted(target.value), "alias": function, "seq": seq}
        body = set(map(id, node.body)) if isinstance(node, (*functions, ast.ClassDef)) else None
        for child in ast.iter_child_nodes(node):
            # decorators, defaults and bases belong to the scope around the definition
            scope = inner if body is None or id(child) in body else (owner, base, function)
            queue.append((child, *scope))


def fact_schema():
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(DataType.fromDDL(FACTS))


def fact_batches(texts: Iterable[tuple[str, str | None]], schema) -> Iterator:
    """Facts of (path, text) in Arrow batches of ``FACT_ROWS``: a full batch goes out before the parse goes on."""
    import pyarrow as pa

    rows: list[dict] = []
    for path, text in texts:
        for fact in _facts_of(path, text or ""):
            rows.append({"path": path, **fact})
            if len(rows) == FACT_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def python_facts(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Fact rows of each (path, text). Longer files are left out, as are files of other languages."""
    schema = fact_schema()

    def run(batches):
        for batch in batches:
            yield from fact_batches(((p.as_py(), s.as_py()) for p, s in zip(batch["path"], batch["text"])), schema)

    source = files.where(F.col("path").endswith(".py")).select("path", "text")
    if max_chars is not None:
        source = source.where(F.length("text") <= max_chars)
    return source.mapInArrow(run, FACTS)


def symbols(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Functions, classes and imported names with their lines, and the plain names each function calls."""
    defined = facts.where("fact = 'symbol'").select(
        *(keys or []), "path", "name", F.when(F.col("kind") == "class", "class").otherwise("function").alias("kind"),
        F.col("line").alias("start_line"), "end_line", F.coalesce("owner", F.lit("")).alias("parent"),
        F.coalesce("calls", F.array().cast("array<string>")).alias("calls"),
    )
    full = F.when(F.col("kind") == "import", F.col("module")).otherwise(F.concat(F.coalesce("module", F.lit("")), F.lit("."), "name"))
    imported = facts.where("fact = 'import'").select(
        *(keys or []), "path", full.alias("name"), F.lit("import").alias("kind"), F.col("line").alias("start_line"), F.col("line").alias("end_line"),
        F.lit("").alias("parent"), F.array().cast("array<string>").alias("calls"),
    )
    return defined.unionByName(imported)


def parse_evidence(facts: DataFrame) -> DataFrame:
    """One evidence row per file: how many symbols were found, or that it was skipped."""
    n = F.count_if(F.col("fact").isin("symbol", "import"))
    bad = F.bool_or(F.col("fact") == "error")
    shown = F.when(bad, "parse error — skipped").otherwise(F.concat(F.lit("parsed "), n.cast("string"), F.lit(" symbols")))
    return facts.groupBy("path").agg(shown.alias("snippet"))


def line_kinds(facts: DataFrame, keywords: list[str]) -> DataFrame:
    """What a parser says a line is, for search: a definition or call of a keyword, or an import."""
    low = F.lower("name")
    named = any_of([low.contains(k.lower()) for k in keywords if k])
    kind = (
        F.when((F.col("fact") == "symbol") & named, F.struct(F.lit(0).alias("rank"), F.lit("definition").alias("kind")))
        .when(F.col("fact") == "import", F.struct(F.lit(1).alias("rank"), F.lit("import").alias("kind")))
        .when((F.col("fact") == "call") & named, F.struct(F.lit(2).alias("rank"), F.lit("call").alias("kind")))
    )
    rows = facts.withColumn("k", kind).where(F.col("k").isNotNull())
    return rows.groupBy("path", F.col("line").alias("line_no")).agg(F.min("k")["kind"].alias("kind"))


def calls(facts: DataFrame) -> DataFrame:
    """Calls inside functions, with the receiver resolved to a class where it is self, cls or super()."""
    r, m = F.coalesce("receiver", F.lit("")), F.col("name")
    in_class = F.coalesce("owner", F.lit("")) != ""
    bound = r.isin("self", "cls") & in_class
    plain = F.col("kind") == "name"
    dotted = F.concat(r, F.lit("."), m)
    expr = F.when(plain, m).when(r == "super", F.concat(F.lit("super()."), m)).when(r == "", F.concat(F.lit("."), m)).otherwise(dotted)
    kind = F.when(plain | (r == ""), "bare").when(bound, r).when(r == "super", "super").otherwise("variable")
    callee = (
        F.when(plain | (r == ""), m)
        .when(bound, F.concat("owner", F.lit("."), m))
        .when(r == "super", F.when(F.coalesce("base", F.lit("")) != "", F.concat("base", F.lit("."), m)).otherwise(""))
        .otherwise(dotted)
    )
    return facts.where("fact = 'call' and alias is not null").select(
        "path", F.col("alias").alias("func"), F.coalesce("owner", F.lit("")).alias("owner"), "line", expr.alias("callee_expr"), kind.alias("receiver"), callee.alias("callee")
    )


def imports(facts: DataFrame) -> DataFrame:
    """Imported modules with their kind; absolute ones by their top module."""
    rows = facts.where("fact = 'import' and module is not null")
    top = F.when(F.col("kind") == "from_relative", F.col("module")).otherwise(F.substring_index("module", ".", 1))
    # one row per imported module: "from a import b, c" names its module once
    first = rows.groupBy("path", "seq", "kind", "line", "module").agg(F.count("*").alias("names"))
    return first.select("path", top.alias("module"), "line", "kind", F.when(F.col("kind") == "import", F.col("names")).otherwise(1).alias("times"))


def external_imports(imported: DataFrame, stdlib: list[str] | None = None) -> DataFrame:
    """Modules outside the standard library: one finding per file with its modules and first line."""
    known = stdlib_modules() if stdlib is None else stdlib
    rows = imported.where(~F.col("module").isin(known))
    per = rows.groupBy("path", "module").agg(F.min("line").alias("line"))
    return per.groupBy("path").agg(
        F.concat(F.lit("外部依赖引用: "), F.array_join(F.array_sort(F.collect_set("module")), ", ")).alias("message"),
        F.min("line").alias("start_line"), F.lit("low").alias("severity"), F.lit("EXTERNAL_IMPORT").alias("rule_id"),
    )


def import_evidence(imported: DataFrame, stdlib: list[str] | None = None) -> DataFrame:
    known = stdlib_modules() if stdlib is None else stdlib
    snippet = F.concat("kind", F.lit(" "), "module", F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))
    rows = imported.where(~F.col("module").isin(known))
    return rows.select(
        "path", "line", snippet.alias("snippet"), F.lit(0.8).alias("confidence"),
        text_functions.content_id("HEAD", F.col("path"), F.col("line"), F.col("line"), snippet).alias("ev_id"),
    )


def routes(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("fact") == "route").where(F.col("kind").isin(HTTP_METHODS)).select(
        "path", F.col("kind").alias("method"), F.col("module").alias("route"), F.col("name").alias("handler"), "line"
    )


def route_evidence(found: DataFrame, commit: str = "HEAD") -> DataFrame:
    """One evidence row per file with routes: its line range and one text line per route."""
    line = F.concat("method", F.lit(" "), "route", F.lit(" -> "), "handler")
    per = found.groupBy("path").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", line.alias("t")))), lambda x: x["t"]), "\n").alias("snippet"),
    )
    ev = text_functions.content_id(commit, F.col("path"), F.col("start_line"), F.col("end_line"), F.col("snippet"))
    return per.withColumn("ev_id", ev)


def route_listing(found: DataFrame, k: int | None = None) -> DataFrame:
    """Routes that start with a slash, as list lines in path order; ``k`` limits the files, as the answer does."""
    rows = found.where(F.col("route").startswith("/"))
    if k is not None:
        files = rows.groupBy("path").count().orderBy("path").limit(k).select("path")
        rows = rows.join(F.broadcast(files), "path")
    return rows.select("path", "line", F.concat(F.lit("- "), "method", F.lit(" "), "route", F.lit(" -> "), "handler").alias("item"))


def first_symbols(facts: DataFrame) -> DataFrame:
    """Entry point of each file for the code map: a symbol named after the pipeline, else its first symbol."""
    rows = facts.where("fact = 'symbol'").withColumn("_p", ~F.lower("name").contains("pipeline"))
    return top_per_key(rows, ["path"], [F.asc("_p"), F.asc("seq")], 1).select("path", "name", "line")


def symbol_names(facts: DataFrame) -> DataFrame:
    """path, symbols: the names a file defines, for ``map_select``."""
    return facts.where("fact = 'symbol'").groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("symbols"))


def definitions(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Defined names with their owner class, in the order a breadth-first walk meets them."""
    return facts.where("fact = 'symbol'").select(
        *(keys or []), "path", "name", "kind", "line", "end_line", F.coalesce("owner", F.lit("")).alias("owner"), "seq"
    )


def import_targets(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Imported names as (path, alias, original, module, level)."""
    return facts.where("fact = 'import' and module is not null").select(
        *(keys or []), "path", "alias", F.coalesce("name", "module").alias("original"), "module", "level", "seq"
    )


