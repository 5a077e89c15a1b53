"""Search, selection, contracts, code graph, output checks and ordered scans on small inputs."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from revgrain.functions import judging, questions, search, text
from revgrain.functions.patterns import python_strip, text_lines
from revgrain.operators import contracts, generate, graph, matching, ordering, pycode, ranking, tools
from revgrain.sources.corpus import explode_lines


def files(spark, items):
    return spark.createDataFrame(list(items.items()), "path string, text string")


def test_late_source_file_beats_many_documents(spark):
    repo = {f"docs/d{i:03}.md": "TargetThing is described" for i in range(200)} | {"zzz_source/main.py": "x = 1\nclass TargetThing:\n  pass"}
    got = ranking.search_topk(explode_lines(files(spark, repo), ["path"]), {"q": ["TargetThing"]}, 10).orderBy("rank").collect()
    assert (got[0]["path"], got[0]["hit_type"], got[0]["score"], got[0]["line_no"]) == ("zzz_source/main.py", "definition", 1350, 2)
    assert len(got) == 10 and len({r["path"] for r in got}) == 10


def test_noisy_file_keeps_one_row(spark):
    repo = {"src/noisy.py": "\n".join(f"needle({i})" for i in range(120))} | {f"src/f{i}.py": "needle" for i in range(101)}
    got = ranking.search_topk(explode_lines(files(spark, repo), ["path"]), {"q": ["needle"]}, 50)
    assert got.count() == 50 and got.where("path = 'src/noisy.py'").count() == 1


def test_parser_kind_overrides_text(spark):
    repo = files(spark, {"a.py": "def other():\n    return thing(1)\n"})
    kinds = pycode.line_kinds(pycode.python_facts(repo), ["thing"])
    got = ranking.search_topk(explode_lines(repo, ["path"]), {"q": ["thing"]}, 5, kinds).collect()
    assert [(r["line_no"], r["hit_type"]) for r in got] == [(2, "call")]


def test_reference_limits(spark):
    repo = {f"src/m{i:02}.py": "\n".join(["use name"] * 5) for i in range(25)} | {"tests/a.py": "name"}
    got = ranking.reference_search(explode_lines(files(spark, repo), ["path"]), {"q": ("x.name", "references")})
    per = defaultdict(int)
    for r in got.collect():
        per[r["path"]] += 1
    assert sum(per.values()) == 50 and max(per.values()) == 3 and "tests/a.py" not in per
    few = ranking.reference_search(explode_lines(files(spark, repo), ["path"]), {"q": ("x.name", "references")}, total=1000)
    assert few.count() == 19 * 3 + 1


def truncate_by_hand(evidence, most=18, other_files=5):
    """Direct reading of the selection rule on one sample, row by row."""
    if len(evidence) <= most:
        return [e["id"] for e in evidence]
    cited = [e for e in evidence if e["cited"]]
    expected = [e for e in evidence if not e["cited"] and e["exp"]]
    sure = [e for e in evidence if not e["cited"] and not e["exp"] and e["conf"] >= 0.9]
    rest = [e for e in evidence if not e["cited"] and not e["exp"] and e["conf"] < 0.9]
    chosen = cited + expected[:max(0, most - len(cited) - other_files)]
    chosen = chosen + sure[:most - len(chosen)]
    if most - len(chosen) > 0:
        chosen = chosen + rest[:most - len(chosen)]
    foreign = sum(not e["exp"] for e in chosen)
    if foreign < other_files and rest:
        inside = [e for e in chosen if e["exp"]][:-(other_files - foreign)]
        if inside:
            inside = inside[:-min(other_files, len(inside))]
            chosen = inside + rest[:most - len(inside)]
        else:
            chosen = []
    return [e["id"] for e in chosen[:most]]


def test_truncated_evidence_equals_the_rule_read_row_by_row(spark):
    rng, want, data = random.Random(3), {}, []
    for s in range(60):
        shape = (rng.random(), rng.random(), rng.random())
        sample = [{"id": f"e{s}_{i}", "cited": rng.random() < shape[0] * 0.6, "exp": rng.random() < shape[1] ** 0.3, "conf": 0.95 if rng.random() < shape[2] * 0.5 else 0.5} for i in range(rng.randint(5, 60))]
        want[s] = truncate_by_hand(sample)
        data += [(s, e["id"], i, e["conf"], e["cited"], e["exp"]) for i, e in enumerate(sample)]
    df = spark.createDataFrame(data, "sample_id int, ev_id string, seq long, confidence double, is_cited boolean, is_expected boolean")
    got = defaultdict(list)
    for r in ranking.truncate_evidence(df).orderBy("sample_id", "place").collect():
        got[r["sample_id"]].append(r["ev_id"])
    assert {s: got.get(s, []) for s in want} == want


def test_read_window_passes_over_long_lines_and_stops_at_statements(spark):
    source = "\n".join(["x" * 90] * 40 + ["", "tail", "def f(): " + "y" * 90, "z"])
    lines = explode_lines(files(spark, {"a.py": source}), ["path"])
    got = ranking.snippet_windows(lines.where("line_no = 5"), lines, 4, 60, 500).collect()[0]
    assert [line.split("|")[0] for line in got["snippet"].split("\n")] == ["1", "2", "3", "4", "5", "41", "42"]
    assert got["end_line"] == 7


def test_running_sum_and_previous_value_with_one_hot_key(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"k{i % 7}", i * 37 % 1000, i, rng.randint(-3, 3)) for i in range(1000)]
    df = spark.createDataFrame(data, "k string, t int, seq int, v int")
    total, sums = 0, {}
    for k, t, seq, v in sorted(data, key=lambda r: (r[1], r[2])):
        total += v
        sums[seq] = total
    assert {r["seq"]: r["s"] for r in ordering.running_sum(df, ["t", "seq"], "v", "s").collect()} == sums
    last, before = {}, {}
    for k, t, seq, v in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        before[seq] = last.get(k)
        last[k] = v
    assert {r["seq"]: r["p"] for r in ordering.previous_value(df, ["k"], ["t", "seq"], "v", "p").collect()} == before


def test_values_of_a_large_key_are_all_kept(spark):
    values = spark.range(2000).select(F.lit("q").alias("k"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("w"))
    text = spark.createDataFrame([("q", " ".join(f"w{n}" for n in range(2000)))], "k string, text string")
    got = matching.contained(text, values, ["k"], "text", "w").select("w").collect()
    assert len(got) == 2000 and len({r.w for r in got}) == 2000


def test_reexports_through_alias_and_cycle(spark):
    repo = files(spark, {
        "pkg/__init__.py": "from ._impl import Real as Public\nfrom .loop_a import Ghost\n", "pkg/_impl.py": "class Real:\n    def send(self):\n        return 1\n",
        "pkg/loop_a.py": "from .loop_b import Ghost\n", "pkg/loop_b.py": "from .loop_a import Ghost\n", "tests/t.py": "class Real:\n    pass\n",
    })
    facts = pycode.python_facts(repo)
    modules = graph.module_index(repo)
    edges = graph.import_edges(pycode.import_targets(facts), modules, repo)
    wanted = spark.createDataFrame([("pkg.Public",), ("pkg.Public.send",), ("pkg.Ghost",), ("Real.send",), ("Real",)], "symbol string")
    got = {r["symbol"]: (r["path"], r["line"], r["canonical_name"]) for r in graph.resolve_symbols(wanted, modules, edges, pycode.definitions(facts)).collect()}
    assert got == {
        "pkg.Public": ("pkg/_impl.py", 1, "pkg._impl.Public"), "pkg.Public.send": ("pkg/_impl.py", 2, "pkg._impl.Public.send"),
        "Real.send": ("pkg/_impl.py", 2, "Real.send"), "Real": ("pkg/_impl.py", 1, "Real"),
    }


def test_contract_of_a_trace_counts_edges_over_targets(spark):
    slots = spark.createDataFrame(
        [("q", "a", "verified_caller_edge", 0, 1, False), ("q", "b", "verified_callee_edge", 0, 1, False), ("p", "a", "verified_caller_edge", 5, 0, False)],
        "query_id string, symbol string, slot string, evidence int, verified int, blocked boolean")
    asked = spark.createDataFrame([("q", "trace"), ("p", "trace"), ("n", "locate")], "query_id string, question_type string")
    got = {r["query_id"]: (r["met"], r["reason"]) for r in contracts.minimum_contract(slots, asked).collect()}
    assert got == {"q": (True, "found 2 verified call edges"), "p": (False, "no verified call edges for trace"), "n": (False, "no targets")}


def test_questions_in_two_languages(spark):
    df = spark.createDataFrame([("UserService 在哪里定义",), ("谁调用 parse_config",), ("what does it do",), ("hello",)], "q string")
    got = [tuple(r) for r in df.select(questions.question_type("q"), questions.fallback_type("q")).collect()]
    assert got == [("locate", "locate"), ("trace", "trace"), ("explain", "locate"), ("locate", "locate")]


def test_words_beside_other_scripts(spark):
    df = spark.createDataFrame([("数据App类",), ("use App now",), ("use app now",), ("Apps",), ("none",)], "s string")
    assert [r[0] for r in df.select(search.match_precision("s", ["App"])).collect()] == [50, 300, 250, 50, 0]


def test_lines_and_strip(spark):
    df = spark.createDataFrame([("a\r\nb\n",), ("",), ("\n",), ("x\x0cy",)], "s string")
    assert [list(r[0]) for r in df.select(text_lines("s")).collect()] == [["a", "b"], [], [""], ["x", "y"]]
    blanks = spark.createDataFrame([("  a" + " " * 200_000 + "b　 ",)], "s string")
    assert blanks.select(F.length(python_strip("s"))).first()[0] == 200_002


def test_schema_errors(spark):
    good = '{"verdict": "correct", "score": 2, "answered_question": true, "uses_supported_evidence": true, "expected_file_coverage": "full", "reason": "", "missing_points": []}'
    bad = good.replace('"score": 2', '"score": "2"').replace('"correct"', '"odd"').replace('"reason": ""', '"reason": "", "extra": 1')
    df = spark.createDataFrame([(good,), (bad,), ("{}",)], "j string")
    got = [list(r[0]) for r in df.select(judging.schema_errors("j")).collect()]
    assert got[0] == [] and len(got[2]) == 7
    assert got[1][0].startswith("verdict: 'odd'") and got[1][1] == "score: 期望 integer，实际 str" and got[1][2] == "不允许的额外字段: 'extra'"


def test_planned_questions(spark):
    df = spark.createDataFrame([('{"question_type": "trace", "relations": [{"type": "trace_call_chain", "subjects": ["a", "b"]}]}',), ('{"question_type": "x", "relations": [3]}',), ("[]",)], "j string")
    got = [list(r[0]) for r in df.select(judging.planner_output_errors("j")).collect()]
    assert got[0] == [] and got[1][1:] == ["relations[0] is not an object"] and got[2] == ["output is not a dict"]


def test_batch_answer_rescue(spark):
    raw = 'x {"change_summary": "a", "ast_summary": "b"} y {"change_summary": bad, "ast_summary": "b"}'
    assert spark.range(1).select(F.size(judging.rescued_objects(F.lit(raw)))).first()[0] == 1


def test_failed_calls_become_rows(spark):
    def broken(batch):
        raise TimeoutError("late")

    prompts = spark.createDataFrame([("a", "p")], "id string, prompt string")
    assert tuple(tools.call_model(prompts, "id", broken, retries=2).first()) == ("a", None, 3, "late")


def test_matrix_is_whole_and_repeatable(spark):
    seeds = spark.range(5000).withColumnRenamed("id", "seed")
    rows = generate.review_ids(generate.coverage_matrix(seeds))
    first = rows.orderBy("seed").collect()
    assert len(first) == 550 and len({r["sample_id"] for r in first}) == 550 and len({r["stratum"] for r in first}) == 11
    assert first == generate.review_ids(generate.coverage_matrix(seeds.repartition(7))).orderBy("seed").collect()
    assert generate.risk_combos(spark).select("risk_signals").distinct().count() == 32


def test_file_then_line_phrase(spark):
    df = spark.createDataFrame([("a/b.py at line 12",), ("a/b.py\nline 12",), ("b.line 5",), ("x.py:3",)], "s string")
    assert [r[0] for r in df.select(text.has_citation("s")).collect()] == [True, False, False, True]


def test_no_knowledge_base_gives_no_rows(spark):
    asked = spark.createDataFrame([("q", "sql injection in python")], "query_id string, text string")
    rules = [{"content": f"c{k}", "source": "s", "tags": tags} for k, tags in enumerate((["security", "injection"], ["security", "sql", "injection"], ["style", "python"]))]
    assert ranking.no_knowledge(asked).count() == 0
    assert [r["rule"] for r in ranking.knowledge_topk(asked, rules, 2).orderBy("rank").collect()] == [1, 0]
