"""Code graph: name and module indexes, re-export chase, symbol resolution, call edges and reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from revgrain import fixed
from revgrain.functions import paths, text
from revgrain.functions.patterns import UNICODE, last_part
from revgrain.operators.matching import BROADCAST_KEYS
from revgrain.operators.ranking import dedupe_first, top_per_key
from revgrain.session import cut_lineage, shuffled

ROOTS = ["src", "lib", "python"]
#: Pairs of a start and a node that one task makes distinct.
PAIRS = 1 << 20


def few_or_shuffled(keys: DataFrame) -> DataFrame:
    """Distinct keys for a semi join: a broadcast if they are counted to be few, which also spares hot keys a shuffle."""
    keys = cut_lineage(keys)
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else shuffled(keys)


def name_index(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct (name, path) of lines that define a function or class. ``keys``, here and below, keep repositories apart."""
    name = F.regexp_extract("line", UNICODE + r"^\s*(?:async\s+def|def|class)\s+(\w+)", 1)
    rows = lines.where(F.col("path").endswith(".py") & (F.col("line").contains("def") | F.col("line").contains("class")))
    return rows.select(*(keys or []), name.alias("name"), "path").where("name <> ''").distinct()


def module_index(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Dotted module to file. The repository root precedes src, lib and python; a module file precedes a package."""
    keys = keys or []
    own = files.where(F.col("path").endswith(".py")).select(*keys, "path").distinct()
    package = F.col("path").rlike(r"(^|/)__init__\.py$")
    top = F.substring_index("path", "/", 1)
    bare = F.regexp_replace("path", r"(/__init__)?\.py$", "")

    def option(root: int, name: Column) -> Column:
        return F.struct(F.translate(name, "/", ".").alias("module"), (F.lit(root * 2) + package.cast("int")).alias("rank"))

    under = [F.when(top == r, option(i + 1, F.regexp_replace(bare, f"^{r}/", ""))) for i, r in enumerate(ROOTS)]
    rows = own.select(*keys, "path", F.inline(F.array_compact(F.array(option(0, bare), *under))))
    return rows.groupBy(*keys, "module").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def longest_module_prefix(symbols: DataFrame, modules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Longest dotted prefix of each symbol that is a module, and what remains; '' where none is."""
    own = [*(keys or []), "symbol"]
    parts = F.split("symbol", r"\.")
    prefixes = symbols.select(*own).distinct().select(*own, parts.alias("parts")).select(
        *own, "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n")
    )
    prefixes = prefixes.withColumn("module", F.array_join(F.slice("parts", F.lit(1), F.col("n")), "."))
    found = prefixes.join(shuffled(modules), [*own[:-1], "module"]).groupBy(*own).agg(F.max_by(F.struct("module", "path", "n"), "n").alias("m"))
    rest = F.array_join(F.slice("parts", F.coalesce("m.n", F.lit(0)) + 1, F.size("parts")), ".")
    return symbols.select(*own).distinct().withColumn("parts", parts).join(shuffled(found), own, "left").select(
        *own, F.coalesce("m.module", F.lit("")).alias("module"), F.col("m.path").alias("module_path"), rest.alias("remainder")
    )


def import_edges(imports: DataFrame, modules: DataFrame, files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(path, alias) to the file the import names and the name it has there.

    An absolute import is looked up as a module; a relative one as a file below the importing file's folder, one folder
    up for each further dot.
    """
    keys = keys or []
    absolute = imports.where("level = 0").join(shuffled(modules.withColumnRenamed("path", "target")), [*keys, "module"]).select(
        *keys, "path", "alias", "original", "target", "seq"
    )
    folder = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split("path", "/")) - F.col("level")))
    base = F.concat_ws("/", F.array_join(folder, "/"), F.translate("module", ".", "/"))
    base = F.regexp_replace(base, "^/", "")
    places = F.array(F.struct(F.concat(base, F.lit(".py")).alias("target"), F.lit(0).alias("rank")),
                     F.struct(F.concat(base, F.lit("/__init__.py")).alias("target"), F.lit(1).alias("rank")))
    relative = imports.where("level > 0").select(*keys, "path", "alias", "original", "seq", F.inline(places))
    relative = relative.join(shuffled(files.select(*keys, F.col("path").alias("target")).distinct()), [*keys, "target"], "left_semi")
    relative = dedupe_first(relative, [*keys, "path", "alias", "seq"], [F.asc("rank")]).select(*keys, "path", "alias", "original", "target", "seq")
    return dedupe_first(absolute.unionByName(relative), [*keys, "path", "alias"], [F.asc("seq"), F.asc("target")]).drop("seq")


def reexport_jumps(edges: DataFrame, top: DataFrame, max_hops: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Where each imported name is defined in the end: (path, name, end_path, end_name, visited), by pointer doubling.

    A pointer that has met no definition yet takes over the pointer of the name it shows at, with the files that lie on
    its way, so the way doubles each round: a chain of n hops takes about log2(n) joins. A way that meets a file twice
    goes, which ends every cycle as soon as its way is longer than it.
    """
    own = [*(keys or []), "path", "name"]
    defined = top.select(*own)
    step = edges.where("target is not null").select(
        *own[:-1], F.col("alias").alias("name"), F.col("target").alias("end_path"), F.col("original").alias("end_name"), F.array("path", "target").alias("visited")
    )
    step = step.join(shuffled(defined), own, "left_anti").where("path <> end_path")
    ends = defined.withColumnsRenamed({"path": "end_path", "name": "end_name"}).withColumn("done", F.lit(True))
    jumps = cut_lineage(step.join(shuffled(ends), [*own[:-2], "end_path", "end_name"], "left").withColumn("done", F.coalesce("done", F.lit(False))))
    while not (moving := jumps.where("not done")).isEmpty():
        onward = jumps.select(
            *own[:-2], F.col("path").alias("end_path"), F.col("name").alias("end_name"), F.struct("end_path", "end_name", "visited", "done").alias("on")
        )
        way = F.concat("visited", F.slice("on.visited", 2, F.size("on.visited"))).alias("visited")
        moved = moving.join(shuffled(onward), [*own[:-2], "end_path", "end_name"]).select(*own, F.col("on.end_path"), F.col("on.end_name"), way, F.col("on.done"))
        moved = moved.where(F.size("visited") == F.size(F.array_distinct("visited")))
        if max_hops is not None:
            moved = moved.where(F.size("visited") <= F.lit(max_hops) + F.when(F.col("done"), 1).otherwise(0))
        jumps = cut_lineage(jumps.where("done").unionByName(moved))
    return jumps.drop("done")


def chase_reexports(starts: DataFrame, edges: DataFrame, defs: DataFrame, max_hops: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Follow each (request, path, name) through imports to its definition, however far unless the caller sets ``max_hops``.

    A definition in the current file wins over an import; a file already visited ends the chase. The ways of all imported
    names are found first (``reexport_jumps``), then each request takes one join, whatever its number of hops.
    """
    own = [*(keys or []), "path", "name"]
    top = cut_lineage(dedupe_first(defs, own, [F.asc("seq")]).select(*own, "kind", "line", "end_line"))
    jumps = reexport_jumps(edges, top, max_hops, keys)
    asked = starts.select("request", *own)
    here = asked.join(shuffled(top.select(*own)), own, "left_semi").withColumn("visited", F.array("path"))
    there = asked.join(shuffled(jumps), own).select("request", *own[:-2], F.col("end_path").alias("path"), F.col("end_name").alias("name"), "visited")
    met = here.unionByName(there).withColumn("hops", F.size("visited") - 1)
    if max_hops is not None:
        met = met.where(F.col("hops") <= max_hops)
    return met.join(shuffled(top), own).select("request", *own, "kind", "line", "end_line", "hops", "visited")


def resolve_symbols(
    requests: DataFrame, modules: DataFrame, edges: DataFrame, defs: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Place of each requested symbol: through its module, else as Owner.member, else by its bare name."""
    keys = keys or []
    wanted = requests.select(*keys, "symbol").distinct()
    split = longest_module_prefix(wanted, modules, keys).where("module <> '' and remainder <> ''")
    rest = F.split("remainder", r"\.")
    chain = split.select(*keys, "symbol", "module_path", "remainder", F.get(rest, F.lit(0)).alias("head"), F.get(rest, F.lit(1)).alias("member"))
    heads = chase_reexports(
        chain.select(*keys, F.col("symbol").alias("request"), F.col("module_path").alias("path"), F.col("head").alias("name")), edges, defs, keys=keys
    ).withColumnRenamed("request", "symbol")
    chained = chain.join(shuffled(heads.drop("visited", "hops")), [*keys, "symbol"])
    direct = chained.where("member is null").select(*keys, "symbol", "path", "kind", "line", "end_line", F.lit("").alias("owner"), "remainder")
    members = dedupe_first(defs.where("owner <> ''"), [*keys, "path", "owner", "name"], [F.asc("seq")])
    inside = chained.where("member is not null and kind = 'class'").select(*keys, "symbol", "path", "remainder", F.col("name").alias("owner"), F.col("member").alias("name"))
    inside = inside.join(shuffled(members.drop("seq")), [*keys, "path", "owner", "name"]).select(*keys, "symbol", "path", "kind", "line", "end_line", "owner", "remainder")
    canonical = F.concat(F.translate(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/", "."), F.lit("."), "remainder")
    by_module = direct.unionByName(inside).select(
        *keys, "symbol", canonical.alias("canonical_name"), "path", "line", "end_line", "kind", "owner", F.lit(0).alias("stage")
    )
    low = paths.in_dirs(F.lower("path"), fixed.NON_PRODUCTION_DIRS).cast("int")
    # The best place of a name does not depend on who asks, so it is found first: requests then meet one row per name,
    # however many files define it.
    place = F.min(F.struct(low.alias("low"), "path", "seq", "line", "end_line", "kind")).alias("b")
    best_member = members.groupBy(*keys, "owner", "name").agg(place)
    best_name = defs.groupBy(*keys, "name").agg(place)
    owned = wanted.where(F.col("symbol").contains(".")).select(
        *keys, "symbol", last_part(F.regexp_extract("symbol", r"^(.*)\.", 1)).alias("owner"), last_part("symbol").alias("name")
    )
    by_owner = owned.join(shuffled(best_member), [*keys, "owner", "name"]).select(
        *keys, "symbol", F.concat("owner", F.lit("."), "name").alias("canonical_name"), "b.path", "b.line", "b.end_line", "b.kind", "owner", F.lit(1).alias("stage")
    )
    by_name = wanted.select(*keys, "symbol", last_part("symbol").alias("name")).join(shuffled(best_name), [*keys, "name"]).select(
        *keys, "symbol", F.col("name").alias("canonical_name"), "b.path", "b.line", "b.end_line", "b.kind", F.lit("").alias("owner"), F.lit(2).alias("stage")
    )
    found = by_module.unionByName(by_owner).unionByName(by_name)
    best = found.groupBy(*keys, "symbol").agg(F.min(F.struct("stage", "path", "line", "end_line", "kind", "owner", "canonical_name")).alias("b"))
    return best.select(*keys, "symbol", "b.canonical_name", "b.path", "b.line", "b.end_line", "b.kind", "b.owner", "b.stage", F.lit(1.0).alias("confidence"))


def resolved_evidence(resolved: DataFrame, lines: DataFrame, before: int = 2, after: int = 5) -> DataFrame:
    """Evidence for resolved symbols: the definition with a few lines around it."""
    last = F.greatest("line", F.coalesce("end_line", F.col("line")))
    wanted = resolved.select(
        "symbol", "path", "line", last.alias("end_line"),
        F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - before), last + after)).alias("line_no"),
    )
    numbered = F.concat(F.col("line_no").cast("string"), F.lit("| "), "text")
    got = wanted.join(shuffled(lines.select("path", "line_no", F.col("line").alias("text"))), ["path", "line_no"])
    per = got.groupBy("symbol", "path", "line", "end_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", numbered.alias("t")))), lambda x: x["t"]), "\n").alias("snippet")
    )
    ev = text.content_id("HEAD", F.col("path"), F.col("line"), F.col("end_line"), F.col("snippet"))
    return per.select("symbol", "path", F.col("line").alias("start_line"), "end_line", "snippet", ev.alias("ev_id"), F.lit("resolve_symbol").alias("source"))


def callee_edges(calls: DataFrame, defs: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Calls whose callee is defined somewhere, by its last name part; ``expected`` (func, callee) keeps planned hops.

    The join is a semi join, so a name with many definitions does not multiply its calls.
    """
    known = few_or_shuffled(defs.select(F.col("name").alias("last")).distinct())
    edges = calls.where("callee <> ''").withColumn("last", last_part("callee")).join(known, "last", "left_semi")
    if expected is None:
        return edges.drop("last")
    plan = expected.select("func", F.col("callee").alias("wanted"), last_part("callee").alias("last")).distinct()
    joined = edges.join(plan, ["func", "last"])
    return joined.where(text.symbols_equivalent("callee", "wanted")).drop("last", "wanted").distinct()


def caller_edges(lines: DataFrame, names: DataFrame, radius: int = 5) -> DataFrame:
    """Call sites of each name in production files, leaving out places within ``radius`` lines of its definition."""
    source = lines.where(F.col("path").endswith(".py") & ~paths.hidden("path") & ~paths.in_dirs(F.lower("path"), fixed.NON_PRODUCTION_DIRS))
    source = source.where(F.col("line").contains("("))
    asked = few_or_shuffled(names.select("name").distinct())
    called = F.array_distinct(F.regexp_extract_all("line", F.lit(UNICODE + r"\b(\w+)\s*\("), F.lit(1)))
    sites = source.select("path", "line_no", "line", F.explode(called).alias("name")).join(asked, "name", "left_semi")
    defined = source.select("path", "line_no", F.regexp_extract("line", UNICODE + r"\bdef\s+(\w+)\s*\(", 1).alias("name")).where("name <> ''")
    # Sites and definitions of a name in a file meet in the order of their lines, each site with the nearest definition on either side.
    marks = sites.withColumn("at", F.lit(None).cast("int")).unionByName(
        defined.join(asked, "name", "left_semi").withColumn("at", F.col("line_no")), allowMissingColumns=True
    ).withColumn("site", F.col("at").isNull())
    place = Window.partitionBy("path", "name")
    before, after = F.last("at", True).over(place.orderBy("line_no")), F.last("at", True).over(place.orderBy(F.desc("line_no")))
    near = F.coalesce(F.col("line_no") - F.col("before") <= radius, F.lit(False)) | F.coalesce(F.col("after") - F.col("line_no") <= radius, F.lit(False))
    marks = marks.withColumn("before", before).withColumn("after", after)
    return marks.where(F.col("site") & ~near).select("name", "path", "line_no", "line")


def discover_callees(evidence: DataFrame, known: DataFrame, per_task: int = 3) -> DataFrame:
    """New names called in verified evidence of trace and impact questions, the first few of each task.

    evidence: query_id, task_id, question_type, target, source, symbol, snippet, seq. known: query_id, symbol.
    """
    graph = evidence.where(F.col("question_type").isin("trace", "impact"))
    found = F.when(F.col("source") == "verify_callees", F.array(F.trim(F.coalesce("symbol", F.lit(""))))).when(
        F.col("source") == "read_window",
        F.filter(
            F.array_distinct(F.regexp_extract_all(F.coalesce("snippet", F.lit("")), F.lit(UNICODE + r"\b([\w.]+)\s*\("), F.lit(1))),
            lambda c: ~c.isin(fixed.NON_CALLEES) & c.rlike(UNICODE + r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*$"),
        ),
    )
    rows = graph.select("query_id", "task_id", "target", "seq", F.posexplode(found).alias("pos", "symbol"))
    rows = rows.where((F.col("symbol") != "") & (F.col("symbol") != F.col("target")))
    rows = rows.groupBy("query_id", "task_id", "symbol").agg(F.min(F.struct("seq", "pos")).alias("first"))
    rows = rows.join(known.select("query_id", "symbol").distinct(), ["query_id", "symbol"], "left_anti")
    return top_per_key(rows, ["query_id", "task_id"], [F.asc("first.seq"), F.asc("first.pos"), F.asc("symbol")], per_task, "rank").drop("first")


def _tasks(frontier: DataFrame, links: DataFrame, seen: DataFrame) -> int:
    """Tasks for the pairs one step from ``frontier`` and those seen, so that none holds many more than ``PAIRS``."""
    ways = frontier.groupBy(F.col("node").alias("source")).agg(F.count("*").alias("n"))
    out = ways.join(links.groupBy("source").agg(F.count("*").alias("m")), "source").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    least = int(frontier.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(out + seen.count()) // PAIRS))


def call_graph(edges: DataFrame, starts: DataFrame, depth: int = 2, per_node: int | None = None) -> DataFrame:
    """Nodes reachable from each start within ``depth`` calls, with their smallest depth.

    edges: source, target. starts: start. Visited pairs keep their smaller depth in one aggregate with the new ones, and every
    level is written to the shared checkpoint folder, so a lost executor repeats one level at most. Tasks grow in number with
    the pairs, so their memory doesn't grow.
    """
    links = edges.select("source", "target").distinct()
    if per_node:
        links = top_per_key(links, ["source"], [F.asc("target")], per_node)
    seen = starts.select("start", F.col("start").alias("node")).distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.select("start", F.col("node").alias("source")).join(links, "source").select("start", F.col("target").alias("node"))
        met = step.withColumn("depth", F.lit(level)).unionByName(seen.where("node is not null"))
        met = met.repartition(_tasks(frontier, links, seen), "start", "node")
        frontier = cut_lineage(met.groupBy("start", "node").agg(F.min("depth").alias("depth")).where(F.col("depth") == level))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")
