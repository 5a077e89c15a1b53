"""Re-export chains by pointer doubling, and two repositories that share paths, modules and names."""

import random

from revgrain.operators import graph

EDGE = "repo string, path string, alias string, original string, target string"
DEF = "repo string, path string, name string, kind string, line int, end_line int, seq int, owner string"


def walk(start, edges, defs, limit=None):
    """One hop after another: (path, name, visited) of the definition, if there is one."""
    (repo, path, name), visited = start, [start[1]]
    while (repo, path, name) not in defs:
        if (repo, path, name) not in edges or (limit is not None and len(visited) > limit):
            return None
        path, name = edges[repo, path, name]
        if path in visited:
            return None
        visited.append(path)
    return path, name, visited


def case(seed):
    draw = random.Random(seed)
    nodes = [(r, f"f{i}.py", n) for r in "ab" for i in range(9) for n in "xyz"]
    edges = {n: (f"f{draw.randrange(9)}.py", draw.choice("xyz")) for n in nodes if draw.random() < 0.85}
    return nodes, edges, {n for n in nodes if draw.random() < 0.1}


def test_ways_equal_a_walk_hop_by_hop(spark):
    for seed in (1, 2):
        nodes, edges, defs = case(seed)
        e = spark.createDataFrame([(*k, v[1], v[0]) for k, v in edges.items()], EDGE)
        d = spark.createDataFrame([(*k, "class", 1, 2, 0, "") for k in defs], DEF)
        s = spark.createDataFrame([("/".join(n), *n) for n in nodes], "request string, repo string, path string, name string")
        for limit in (None, 0, 1, 2, 3):
            got = {r.request: (r.path, r.name, r.visited) for r in graph.chase_reexports(s, e, d, limit, ["repo"]).collect()}
            want = {"/".join(n): w for n in nodes if (w := walk(n, edges, defs, limit))}
            assert got == want, (seed, limit)


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    cuts = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    rows = [("a", f"m{k}.py", "N", "N", f"m{k + 1}.py") for k in range(200)] + [("a", f"c{k}.py", "N", "N", f"c{(k + 1) % 30}.py") for k in range(30)]
    defs = spark.createDataFrame([("a", "m200.py", "N", "class", 3, 9, 0, "")], DEF).drop("repo")
    starts = spark.createDataFrame([("r", "m0.py", "N"), ("loop", "c3.py", "N")], "request string, path string, name string")
    got = graph.chase_reexports(starts, spark.createDataFrame(rows, EDGE).drop("repo"), defs).collect()
    assert [(r.request, r.path, r.hops) for r in got] == [("r", "m200.py", 200)] and got[0].visited[:2] == ["m0.py", "m1.py"]
    assert len(cuts) <= 11


def test_repositories_are_kept_apart(spark):
    files = spark.createDataFrame([("a", "src/p/m.py"), ("a", "src/p/n.py"), ("b", "src/p/m.py"), ("b", "p/m.py")], "repo string, path string")
    modules = graph.module_index(files, ["repo"])
    assert {(r.repo, r.module): r.path for r in modules.where("module = 'p.m'").collect()} == {("a", "p.m"): "src/p/m.py", ("b", "p.m"): "p/m.py"}
    imports = spark.createDataFrame(
        [("a", "src/p/m.py", "C", "C", "n", 1, 0), ("b", "p/m.py", "C", "C", "n", 1, 0)], "repo string, path string, alias string, original string, module string, level int, seq int"
    )
    edges = graph.import_edges(imports, modules, files, ["repo"])
    assert [(r.repo, r.target) for r in edges.collect()] == [("a", "src/p/n.py")]  # b has no such file
    defs = spark.createDataFrame([
        ("a", "src/p/n.py", "C", "class", 3, 9, 0, ""), ("a", "src/p/n.py", "go", "function", 4, 5, 1, "C"),
        ("b", "p/m.py", "D", "class", 1, 2, 0, ""), ("b", "src/p/m.py", "go", "function", 7, 8, 0, "E"),
    ], DEF)
    asked = spark.createDataFrame([(r, s) for r in "abc" for s in ("p.m.C", "p.m.C.go", "p.m.D", "go")], "repo string, symbol string")
    got = {(r.repo, r.symbol): (r.path, r.line, r.stage) for r in graph.resolve_symbols(asked, modules, edges, defs, ["repo"]).collect()}
    assert got == {
        ("a", "p.m.C"): ("src/p/n.py", 3, 0), ("a", "p.m.C.go"): ("src/p/n.py", 4, 0), ("a", "go"): ("src/p/n.py", 4, 2),
        ("b", "p.m.C.go"): ("src/p/m.py", 7, 2), ("b", "p.m.D"): ("p/m.py", 1, 0), ("b", "go"): ("src/p/m.py", 7, 2),
    }
    lines = spark.createDataFrame([("a", "x.py", "def f():"), ("b", "x.py", "class f:")], "repo string, path string, line string")
    assert sorted(map(tuple, graph.name_index(lines, ["repo"]).collect())) == [("a", "f", "x.py"), ("b", "f", "x.py")]
