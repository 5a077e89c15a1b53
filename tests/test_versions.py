"""Several updates of one key, against a loop over them."""

import random

import pytest

from revgrain.sources import knowledge
from revgrain.streaming import evaluation, jobs


def loop(current, updates):
    state = {(u, c): (t, v) for u, c, t, v in current}
    out = []
    for u, c, seq, title, version, op in sorted(updates, key=lambda x: x[2]):
        old = state.get((u, c))
        if old and version == old[1]:
            state[u, c] = (title, version + 1)
            outcome = "updated"
            if op == "delete":
                del state[u, c]
                outcome = "deleted"
        elif old is None and version == 0 and op != "delete":
            state[u, c] = (title, 1)
            outcome = "inserted"
        else:
            outcome = "conflict"
        out.append((u, c, seq, title if outcome in ("inserted", "updated") else None, outcome, state.get((u, c), (None, None))[1]))
    return out, {(u, c, *s) for (u, c), s in state.items()}


UPDATE = "user_id long, conv_id long, seq long, title string, version long, op string"
STATE = "user_id long, conv_id long, title string, version long"


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart, so a busy key stands in several."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def samples():
    random.seed(4)
    current = [(u, 0, "old", 1 + u % 3) for u in range(30)] + [(99, 9, "never touched", 7)]
    updates = [(1, 0, n, f"busy {n}", random.choice([0, 1, 2, 3, n % 50, None, -1]), random.choice(["save"] * 5 + ["delete"])) for n in range(0, 4_000, 2)]
    updates += [(random.randrange(40), random.randrange(2), n, f"t{n}", random.randrange(4), random.choice(["save", "save", "delete"])) for n in range(1, 2_000, 2)]
    chain = [(500, 0, 10_000 + n, f"c{n}", n, "save") for n in range(600)]
    updates += chain
    random.shuffle(updates)
    return current, updates


def test_a_busy_key_and_many_quiet_ones(spark, many_ranges):
    current, updates = samples()
    state, new = spark.createDataFrame(current, STATE), spark.createDataFrame(updates, UPDATE)
    ranges = knowledge.ordering.ranged(new, [*knowledge.KEYS, "seq"])
    assert ranges.where("user_id = 1").select("_pid").distinct().count() > 1
    applied = knowledge.apply_updates(state, new.repartition(7))
    rows, after = loop(current, updates)
    assert sorted(map(tuple, applied.collect()), key=repr) == sorted(rows, key=repr)
    assert {tuple(r) for r in knowledge.state_after(state, applied).collect()} == after
    assert (500, 0, "c599", 600) in after


def test_no_updates(spark):
    state, none = spark.createDataFrame([(1, 1, "x", 1)], STATE), spark.createDataFrame([], UPDATE)
    applied = knowledge.apply_updates(state, none)
    assert applied.count() == 0 and knowledge.state_after(state, applied).count() == 1


def stream_of(spark, tmp_path, parts, schema):
    """A file stream that takes one part in each batch."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={n}"))
    return spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "false").parquet(str(tmp_path / "in"))


def test_updates_in_several_batches(spark, tmp_path):
    current, updates = samples()
    updates = sorted(updates, key=lambda x: x[2])
    parts = [updates[:700], updates[700:1_500], updates[1_500:2_200], updates[2_200:]]
    applied, state = evaluation.update_stream(stream_of(spark, tmp_path, parts, UPDATE).drop("part"), spark.createDataFrame(current, STATE), str(tmp_path / "job"))
    rows, after = loop(current, updates)
    assert sorted(map(tuple, applied.collect()), key=repr) == sorted(rows, key=repr)
    assert {tuple(r) for r in state.collect()} == after


def test_log_of_jobs_over_batches(spark, tmp_path):
    event = "job_id string, seq long, event string, data double"
    parts = [
        [("a", 1, "queued", 0.0), ("b", 2, "queued", 0.0), ("open", 3, "queued", 0.0), ("c", 5, "end", 0.0), ("c", 4, "queued", 0.0)],
        [("a", 9, "end", 1.0), ("a", 8, "end", 1.0), ("a", 7, "plan", 1.0), ("open", 6, "plan", 1.0), ("c", 10, "late", 1.0)],
        [("b", 11, "result", 2.0), ("a", 12, "late", 2.0), ("c", 13, "end", 2.0)],
        [("b", 14, "end", 3.0), ("open", 15, "plan", 3.0)],
    ]
    got = jobs.job_event_log_stream(stream_of(spark, tmp_path, parts, event).drop("part"), str(tmp_path / "job"))
    every = spark.createDataFrame([r for p in parts for r in p], event)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.job_event_log(every).select(*got.columns).collect()))
    assert {r.job_id for r in got.collect()} == {"a", "b", "c"}


def test_records_are_judged_once(spark, tmp_path):
    parts = [[(1, "x"), (2, "x"), (2, "x")], [(2, "x"), (3, "x")], [(1, "x"), (4, "x"), (3, "x")]]
    stream = stream_of(spark, tmp_path, parts, "sample_id long, answer string").drop("part")
    got = evaluation.judge_stream(stream, lambda df: df.selectExpr("sample_id", "'correct' as verdict"), str(tmp_path / "job"))
    assert sorted(r.sample_id for r in got.collect()) == [1, 2, 3, 4]
