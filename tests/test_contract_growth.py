import random

from revgrain.functions import questions
from revgrain.operators import contracts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_is_sent_to_its_task_once(spark):
    """Evidence was made distinct and joined with the matches a second time, by another key."""
    rng = random.Random(4)
    sources = ["resolve_symbol", "read_window", "verify_callsite", "verify_callees", "search_references", "other", None]
    tasks = [(q, f"t{k}" if k else None, rng.choice(["app.sym1", "app.sym2", "sym", None])) for q in (1, 2, None) for k in range(5)] * 2
    evidence = [(rng.choice([1, 2, None]), f"t{rng.randint(1, 5)}", f"e{rng.randint(0, 20)}", rng.choice(sources)) for _ in range(80)]
    targets = [(rng.choice([1, 2, None]), rng.choice(["sym1", "sym2", "app.sym1", "x.app.sym2", None])) for _ in range(30)]
    e = spark.createDataFrame(evidence, "query_id long, task_id string, ev_id string, source string")
    slots = {r.source: r.slot for r in e.select("source", questions.source_slot("source").alias("slot")).distinct().collect()}
    got = contracts.fill_slots(spark.createDataFrame(tasks, "query_id long, task_id string, target string"), e, spark.createDataFrame(targets, "query_id long, symbol string"))
    want = {(q, s, slots[src], ev, slots[src] not in contracts.EDGE_SLOTS) for q, t, ev, src in evidence for q2, t2, target in tasks for q3, s in targets
            if q is not None and q == q2 == q3 and t == t2 and slots[src] and target and s and (s in target or target in s)}
    assert want and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert plan(got).count("Join") == 2
