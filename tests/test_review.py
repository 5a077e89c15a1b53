"""Diffs, plans, issues and reports on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from revgrain.functions import paths, review
from revgrain.operators import aggs, joins, tools
from revgrain.sources import diffs, knowledge, samples


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def findings(spark, *items):
    schema = "run_id string, file string, rule_id string, start_line int, message string, tool string, severity string, evidence_id string, seq int"
    return spark.createDataFrame([("r", *i, f"e{n}", n) for n, i in enumerate(items)], schema)


def test_same_place_merges_and_keeps_first_seen_order(spark):
    df = findings(
        spark, ("a.py", "F1", 7, "zulu", "ruff", "low"), ("a.py", "F1", 7, "alpha", "bandit", "high"),
        ("a.py", "F1", 7, "zulu", "ruff", "info"), ("a.py", "F1", 14, "zulu", "ruff", "info"), (None, "F1", None, "m", "ruff", "odd"),
    )
    got = rows(aggs.aggregate_findings(df).select("file", "line", "severity", "title", "reason", F.array_join("source", ","), "finding_count"), "file", "line")
    assert got == [
        ("", 0, "info", "[F1] m", "m", "ruff", 1), ("a.py", 7, "high", "[F1] zulu", "zulu; alpha", "ruff", 3),
        ("a.py", 14, "info", "[F1] zulu", "zulu", "ruff", 1),
    ]
    assert aggs.aggregate_findings(df.limit(0)).count() == 0


def test_plan_of_the_usual_change_set(spark):
    changes = spark.createDataFrame(
        [("c", "auth.py", "modified", 60, 15), ("c", "utils.py", "modified", 30, 5), ("c", "requirements.txt", "modified", 3, 1), ("d", "README.md", "added", 1, 0),
         ("e", "x.py", "modified", 1, 0), ("f", "gone.py", "deleted", 0, 9)],
        "run_id string, path string, change_type string, added int, deleted int",
    )
    got = {r["run_id"]: r for r in aggs.build_plans(changes).collect()}
    assert got["c"]["analyzers"] == ["git", "python_ast", "ruff", "bandit", "dependency"]
    assert got["c"]["reason_codes"] == ["auth_change", "dependency_change", "dependency_change"] and got["c"]["risk_level"] == "medium"
    assert (got["d"]["analyzers"], got["d"]["reason_codes"], got["d"]["risk_level"]) == (["git"], ["no_python_changes"], "low")
    assert got["e"]["analyzers"] == ["git", "python_ast", "ruff"] and got["e"]["reason_codes"] == ["bandit_skipped_low_risk"]
    assert got["f"]["reason_codes"] == ["no_python_changes"]


def test_file_classes(spark):
    names = {
        "docs_src/a.py": "documentation", "src/readme_gen.py": "documentation", "tests/a.py": "test", "src/conftest.py": "test", "examples/a.py": "example",
        "setup.py": "source", "Makefile": "build", ".gitignore": "build", "a/b.yml": "config", "src\\app.py": "source", "bin/tool": "other",
    }
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r[0]: r[1] for r in df.select("path", paths.classify_file("path")).collect()} == names


def test_hunks_and_renames(spark):
    text = "diff --git a/x.py b/x.py\n@@ -10,5 +10,6 @@ def f\n+a\n@@ -20 +21 @@\ndiff --git a/y.py b/y.py\n@@ -1,2 +0,0 @@\n"
    df = spark.createDataFrame([("r", "b", "h", "R90\told.py\tnew.py\nD\tz.py\n", "3\t1\told.py => new.py\n-\t-\tz.py\n", text)],
                               "repo_id string, base string, head string, name_status string, numstat string, diff string")
    got = rows(diffs.parse_hunks(df).select("path", "hunk", "old_start", "old_lines", "new_start", "new_lines"), "path", "hunk")
    assert got == [("x.py", 0, 10, 5, 10, 6), ("x.py", 1, 20, 1, 21, 1), ("y.py", 0, 1, 2, 0, 0)]
    files = diffs.status_join_numstat(diffs.parse_name_status(df), diffs.parse_numstat(df))
    assert rows(files.select("path", "change_type", "old_path", "added", "deleted"), "path") == [("new.py", "renamed", "old.py", 3, 1), ("z.py", "deleted", "", 0, 0)]


def test_grounding_cases(spark):
    answers = spark.createDataFrame([("in", "see app/x.py:296"), ("out", "see app/x.py:999"), ("file", "see b.py:1"), ("none", "nothing"), ("whole", "w.py:5 and w.py:5"), ("shown", "s.py:42"), ("mixed", "app/x.py:300 app/x.py:311")], "sample_id string, answer string")
    ev = spark.createDataFrame(
        [(s, f, a, b, t) for s in ("in", "out", "file", "none", "whole", "shown", "mixed") for f, a, b, t in
         [("app/x.py", 296, 310, ""), ("w.py", 0, 0, ""), ("s.py", 7, 0, " 41| a\n 42| b")]],
        "sample_id string, file string, start_line int, end_line int, snippet string",
    )
    grounded = joins.ground_citations(joins.answer_citations(answers), ev)
    got = {r["sample_id"]: (r["total_refs"], r["verified_refs"], r["grounded"], r["no_refs"]) for r in joins.grounding_summary(answers, grounded).collect()}
    assert got == {
        "in": (1, 1, True, False), "out": (1, 0, False, False), "file": (1, 0, False, False), "none": (0, 0, False, True), "whole": (2, 2, True, False),
        "shown": (1, 1, True, False), "mixed": (2, 1, False, False),
    }
    reasons = {r["sample_id"]: r["reason"] for r in grounded.where("not verified").collect()}
    assert reasons == {"out": "line out of evidence range", "file": "file not found in evidence", "mixed": "line out of evidence range"}


def test_plan_scores_for_empty_sets(spark):
    df = spark.createDataFrame([("a", ["git"], ["git", "ruff", "bandit"]), ("b", [], ["git"]), ("c", ["git"], [])], "sample_id string, analyzers array<string>, true_analyzers array<string>")
    df = df.selectExpr("*", "cast(array() as array<string>) as reason_codes", "array('sql_risk') as true_reason_codes", "'low' as risk_level", "'low' as true_risk_level")
    got = {r["sample_id"]: (r["analyzer_precision"], round(r["analyzer_recall"], 4)) for r in aggs.plan_scores(df).collect()}
    assert got == {"a": (1.0, 0.3333), "b": (0.0, 0.0), "c": (0.0, 1.0)}


def test_a_failing_tool_fails_its_file_only(spark):
    files = spark.createDataFrame([("a", "ok"), ("b", "boom")], "path string, text string")

    def tool(path, text):
        if text == "boom":
            raise RuntimeError("no")
        return {"findings": [{"rule_id": "X", "message": "m", "severity": "low", "start_line": 3}]}

    got = tools.run_tool(files, "t", tool)
    assert rows(got.select("path", "status", F.size("findings"), F.size("diagnostics")), "path") == [("a", "success", 1, 0), ("b", "failed", 0, 1)]


def test_upsert_outcomes(spark):
    old = spark.createDataFrame([(1, "a", "t", 2), (1, "b", "t", 1), (1, "d", "t", 4)], "user_id int, conv_id string, title string, version int")
    new = spark.createDataFrame([(1, "a", "n", 2, "save"), (1, "b", "n", 0, "save"), (1, "c", "n", 0, "save"), (1, "d", "", 4, "delete"), (1, "e", "n", 3, "save")], "user_id int, conv_id string, title string, version int, op string")
    got = rows(knowledge.versioned_upsert(old, new).select("conv_id", "outcome", "title", "version"), "conv_id")
    assert got == [("a", "updated", "n", 3), ("b", "conflict", "t", 1), ("c", "inserted", "n", 1), ("d", "deleted", None, None), ("e", "conflict", None, None)]


def test_a_frozen_baseline_is_never_overwritten(spark, tmp_path):
    records = spark.createDataFrame([("s", "a", "q", "locate", 1, ["x"])], "sample_id string, answer string, question string, question_type string, step_count int, labels array<string>")
    source = spark.createDataFrame([("s", "u", "c", "p")], "sample_id string, repo_url string, commit_sha string, project string")
    samples.freeze_baseline(records, source, "external_glm_v1", str(tmp_path))
    with pytest.raises(Exception):
        samples.freeze_baseline(records, source, "external_glm_v1", str(tmp_path))
    with pytest.raises(ValueError):
        samples.frozen_rows(records, source, "other")


def test_labels(spark):
    df = spark.createDataFrame([("success", 1250.0), ("tool_skipped", 0.0), ("failed", None)], "s string, d double")
    assert [tuple(r) for r in df.select(review.status_label("s"), review.latency_label("d")).collect()] == [("OK", "1.2s"), ("SKIP", "-"), ("FAIL", "-")]
