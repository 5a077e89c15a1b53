import random

from pyspark.sql import functions as F

from revgrain.operators import graph, pycode

FILES = [(f"src/p/m{k}.py", f"from p.m{k + 1} import C{k + 1} as Next\nclass C{k}:\n    def run(self):\n        return Next().run()\n") for k in range(20)]


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_guessed_sizes_are_not_broadcast(spark):
    """Exploded and parsed rows were taken to be as small as the file they come from and sent to the driver whole."""
    files = spark.createDataFrame(FILES, "path string, text string")
    facts, modules = pycode.python_facts(files), graph.module_index(files)
    defs, edges = pycode.definitions(facts), graph.import_edges(pycode.import_targets(facts), modules, files.select("path"))
    starts = files.select(F.col("path").alias("request"), "path", F.lit("Next").alias("name"))
    asked = spark.range(30).selectExpr("concat('p.m', id, '.C', id, '.run') as symbol")
    chased, found = graph.chase_reexports(starts, edges, defs), graph.resolve_symbols(asked, modules, edges, defs)
    shown = graph.resolved_evidence(found, files.selectExpr("path", "posexplode(split(text, '\\n')) as (line_no, line)"))
    assert [broadcasts(df) for df in (edges, chased, found, shown)] == [0] * 4
    assert chased.count() == 19 and found.count() == 30


def test_caller_edges_like_a_loop(spark):
    rng, files = random.Random(3), {}
    for k in range(12):
        files[f"src/m{k}.py"] = [rng.choice(["def run(x):", "run(1)", "x = put(run(2))", "pass", "def put(y):", "other(3)"]) for _ in range(60)]
    rows = [(p, n + 1, line) for p, lines in files.items() for n, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "path string, line_no int, line string")
    names = spark.createDataFrame([("run",), ("put",), ("run",)], "name string")
    want = set()
    for p, n, line in rows:
        for name in ("run", "put"):
            defined = [m + 1 for m, other in enumerate(files[p]) if f"def {name}(" in other]
            if f"{name}(" in line and all(abs(m - n) > 5 for m in defined):
                want.add((p, n, name))
    got = graph.caller_edges(lines, names)
    assert [(r.path, r.line_no, r.name) for r in got.orderBy("path", "line_no", "name").collect()] == sorted(want) and want
    assert broadcasts(got) == 2  # the counted names, for sites and for definitions
