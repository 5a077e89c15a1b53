"""Line dedup by runs against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from revgrain.llm import line_runs
from tests.llm import brute

LONG = "this line is long enough to count as one that may repeat"


def result(df):
    rows = df.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    return sorted(map(tuple, rows), key=repr)


def samples():
    random.seed(7)
    pool = [f"{LONG} number {n}" for n in range(12)] + ["short", "", "x" * 39, "y" * 40, "É" * 40, "é" * 40]
    rows = []
    for i in range(60):
        some = [random.choice(pool) for _ in range(random.randint(0, 8))]
        some = [random.choice([x, x.upper(), f" \t{x}\x0b", x + "\r", "\xa0" + x]) for x in some]
        rows.append((i * 7 - 100, "\n".join(some)))
    return rows + [(None, f"{LONG} number 1\nonly here"), (None, None), (5_000, None), (5_001, ""), (5_002, "\n\n"), (5_003, (f"{LONG} number 2\n" * 4_000) + "end"), *[rows[3]] * 6]


@pytest.mark.parametrize("batches, fan", [(1, 2), (4, 2), (9, 3)])
def test_lines_that_go(docs, batches, fan):
    rows = samples()
    assert result(line_runs.dedup_lines(docs(rows), batches=batches, fan=fan)) == sorted(brute.lines(rows), key=repr)


def test_a_line_that_all_hold_and_null_ids(docs):
    rows = [(None, f"{LONG}\n{n}") for n in range(6)] + [(3, "other\n" + LONG.upper())] * 2
    assert result(line_runs.dedup_lines(docs(rows))) == sorted(brute.lines(rows), key=repr)
    rows = rows[:6]
    assert result(line_runs.dedup_lines(docs(rows))) == sorted(brute.lines(rows), key=repr)


def test_no_rows(docs):
    assert line_runs.dedup_lines(docs([])).count() == 0


def test_every_path_to_a_frequent_key(docs, monkeypatch):
    rows = samples()
    for hot in (1, 10**9):  # every key is joined, every key is sent to the tasks
        monkeypatch.setattr(line_runs, "HOT_KEYS", hot)
        assert result(line_runs.dedup_lines(docs(rows))) == sorted(brute.lines(rows), key=repr)


def test_levels(spark):
    """A key stands in one run, known keys come back from a batch, and runs are merged as they get many."""
    store = line_runs.Runs(spark, fan=2)
    known = []
    for n in range(5):
        keys = spark.range(10 * n, 10 * n + 20).select(F.lit(n).cast("long").alias("id"), F.col("id").alias("k1"), F.col("id").alias("k2"))
        known.append({r.k1 for r in store.add(keys).collect()})
    assert known == [set()] + [set(range(10 * n, 10 * n + 10)) for n in range(1, 5)]
    assert [len(level) for level in store.levels] == [1, 0, 1]
    runs = [r for level in store.levels for r in level]
    held = [r.k1 for run in runs for r in spark.table(run).collect()]
    assert sorted(held) == list(range(60))
    assert {(r.k1, r.n_docs, r["last"]) for r in store.frequent(2).collect()} == {(k, 2, k // 10) for k in range(10, 50)}
    plan = spark.table(runs[0]).join(spark.table(runs[1]).select(*line_runs.KEY).hint("merge"), line_runs.KEY, "left_anti")._jdf.queryExecution().toString()
    assert "Exchange" not in plan  # runs share buckets
    store.drop()
