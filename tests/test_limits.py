"""Inputs beyond former limits, and answers that fall short."""

from revgrain.operators import filters, generate, pycode, tools
from revgrain.sources import corpus


def test_corpus_reads_any_bytes_and_opens_nothing_else(spark, tmp_path):
    (tmp_path / "a.PY").write_bytes(b"x = '\xff'\n")
    (tmp_path / "b.bin").write_bytes(b"\x00")
    (tmp_path / "big.py").write_text("y = 1\n" * 600_000)
    got = {r.path.rsplit("/", 1)[1]: r for r in corpus.read_corpus(spark, str(tmp_path), [".py"]).collect()}
    assert set(got) == {"a.PY", "big.py"} and got["a.PY"].text == "x = '�'\n" and got["big.py"].length == 3_600_000
    assert corpus.read_corpus(spark, str(tmp_path), [".py"], 1_000).count() == 1


def test_sixth_glob_counts(spark):
    files = spark.createDataFrame([(f"d{k}/a.py",) for k in range(7)], "path string")
    assert filters.match_pathspec(files, [f"d{k}" for k in range(7)]).count() == 7


def test_large_change_sets_keep_their_files(spark):
    row = [("s", [".py"], 250, 500, False, [])]
    params = spark.createDataFrame(row, "sample_id string, file_exts array<string>, python_file_count int, total_lines int, has_dep_files boolean, risk_signals array<string>")
    assert generate.fake_changesets(params).count() == 250


def test_long_python_files_give_facts(spark):
    text = "def first():\n    pass\n" + "# filler\n" * 150_000
    facts = pycode.python_facts(spark.createDataFrame([("a.py", text)], "path string, text string"))
    assert facts.where("name = 'first'").count() == 1


def test_every_prompt_gives_a_row(spark):
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(4)], "id long, prompt string").coalesce(1)
    short = {r.id: r for r in tools.call_model(prompts, "id", lambda texts: texts[:1], batch=4, retries=1).collect()}
    assert [short[k].raw for k in range(4)] == ["p0", "p1", None, None] and [short[k].attempts for k in range(4)] == [1, 2, 2, 2]
    assert short[3].error and tools.call_model(prompts, "id", lambda texts: [], batch=4).count() == 4


def test_upserts_of_two_batches_leave_one_state(spark, tmp_path):
    from revgrain.streaming import evaluation

    columns = "user_id long, conv_id long, title string, version int, op string"
    for k, rows in enumerate(([(1, 1, "b", 1, "save"), (2, 1, "n", 0, "save")], [(1, 1, "c", 2, "save"), (2, 1, "x", 5, "save")])):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    current = spark.createDataFrame([(1, 1, "a", 1)], "user_id long, conv_id long, title string, version int")
    got = {(r.user_id, r.conv_id): (r.outcome, r.title, r.version) for r in evaluation.upsert_stream(stream, current, str(tmp_path / "job")).collect()}
    assert len(got) == 2
    assert got in ({(1, 1): ("updated", "c", 3), (2, 1): ("conflict", "n", 1)}, {(1, 1): ("updated", "b", 2), (2, 1): ("inserted", "n", 0 + 1)})


def test_diffs_and_review_contexts_are_whole(spark):
    from revgrain.operators import joins
    from revgrain.sources import diffs

    long = "diff --git a/x.py b/x.py\n" + "+" + "y" * 9_000
    one = spark.createDataFrame([("r", "a", "b", long + "\n")], "repo_id string, base string, head string, diff string")
    assert diffs.split_file_patches(one).first().patch == long and len(diffs.split_file_patches(one, 6_000).first().patch) == 6_000
    sample = spark.createDataFrame([(1, "q", "s")], "sample_id long, question string, expected_answer_summary string")
    output = spark.createDataFrame([(1, long, "a")], "sample_id long, diff string, answer string")
    assert joins.judge_inputs(sample, output).first().diff == long
    assert joins.judge_inputs(sample, output, 10).first().diff == "diff --git\n... (diff truncated)"
    files = spark.createDataFrame([("r", f"f{k}", k) for k in range(12)], "run_id string, path string, seq int")
    findings = spark.createDataFrame([("r", "f11", f"R{k}", k, "m" * 150, k) for k in range(25)], "run_id string, path string, rule_id string, start_line int, message string, seq int")
    symbols = spark.createDataFrame([("r", "f11", "function", f"g{k}", k) for k in range(25)], "run_id string, path string, kind string, name string, start_line int")
    patches = spark.createDataFrame([("r", "f11", long)], "run_id string, path string, patch string")
    got = {r.path: r for r in joins.review_context(files, findings, symbols, patches).collect()}
    assert len(got) == 12 and got["f11"].patch == long
    assert got["f11"].findings.split("\n") == [f"- [R{k}] L{k}: " + "m" * 150 for k in range(25)] and len(got["f11"].symbols.split("\n")) == 25
    cut = joins.review_context(files, findings, symbols, patches, 1).collect()
    assert [r.path for r in cut] == ["f0"]
    assert [len(r.findings.split("\n")) for r in joins.review_context(files, findings, symbols, patches, max_findings=3).collect() if r.findings] == [3]


def test_long_reexport_chains_end_at_their_definition(spark):
    from revgrain.operators import graph

    edges = [(f"m{k}.py", f"N{k}", f"N{k + 1}", f"m{k + 1}.py") for k in range(12)] + [("a.py", "L", "L", "b.py"), ("b.py", "L", "L", "a.py")]
    edges = spark.createDataFrame(edges, "path string, alias string, original string, target string")
    defs = spark.createDataFrame([("m12.py", "N12", "class", 3, 9, 0, ""), ("b.py", "N12", "function", 1, 2, 1, "")], "path string, name string, kind string, line int, end_line int, seq int, owner string")
    starts = spark.createDataFrame([("r", "m0.py", "N0"), ("d", "m12.py", "N12"), ("loop", "a.py", "L"), ("none", "m0.py", "X")], "request string, path string, name string")
    got = {r.request: (r.path, r.name, r.line, r.hops) for r in graph.chase_reexports(starts, edges, defs).collect()}
    assert got == {"r": ("m12.py", "N12", 3, 12), "d": ("m12.py", "N12", 3, 0)}
    assert [r.request for r in graph.chase_reexports(starts, edges, defs, 5).collect()] == ["d"]
    assert graph.chase_reexports(starts.limit(0), edges, defs).count() == 0
    modules = spark.createDataFrame([(f"m{k}", f"m{k}.py") for k in range(13)], "module string, path string")
    wanted = spark.createDataFrame([("m0.N0",)], "symbol string")
    assert [(r.path, r.line, r.stage) for r in graph.resolve_symbols(wanted, modules, edges, defs).collect()] == [("m12.py", 3, 0)]
