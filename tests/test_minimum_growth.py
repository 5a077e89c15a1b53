import random

from pyspark.sql import functions as F

from revgrain.operators import contracts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_targets_meet_themselves_in_no_join(spark):
    """The state of every slot was joined with the edges of its target, with both sides sorted in memory."""
    rng = random.Random(6)
    names = [*contracts.PLAIN_SLOTS, *contracts.EDGE_SLOTS, "candidate_reference", None]
    rows = [(rng.choice([*range(60), None]), rng.choice(["a", "b", "c", None]), rng.choice(names), rng.choice([0, 0, 1, 3]), rng.choice([0, 0, 0, 1, 2]), False) for _ in range(400)]
    slots = spark.createDataFrame(rows, "query_id long, symbol string, slot string, evidence long, verified long, blocked boolean")
    kinds = ["locate", "grep", "explain", "trace", "impact", "compare", "any"]
    asked = spark.createDataFrame([(q, kinds[q % 7]) for q in range(65)], "query_id long, question_type string")
    status = contracts.slot_status(slots)
    closed = {(q, s): None for q, s, *_ in rows if q is not None and s is not None}
    for r in status.collect():
        if r.closed is not None:
            closed[r.query_id, r.symbol] = bool(closed[r.query_id, r.symbol]) or r.closed
    flags = {}
    for (q, s), c in closed.items():
        mine = [r for r in rows if r[:2] == (q, s)]
        d, i, r, ref, caller = (any(x[2] == n and f(x) for x in mine) for n, f in [
            ("definition", lambda x: x[3] + x[4] > 0), ("implementation", lambda x: x[3] + x[4] > 0), ("candidate_reference", lambda x: x[3] + x[4] > 0),
            ("candidate_reference", lambda x: x[3] > 0), ("verified_caller_edge", lambda x: x[4] > 0)])
        flags.setdefault(q, []).append((d, i, r, ref, caller, sum(x[4] for x in mine if x[2] in contracts.EDGE_SLOTS), c))
    tests = {"locate": lambda g: any(x[0] for x in g), "grep": lambda g: any(x[2] for x in g), "explain": lambda g: any(x[0] and x[1] for x in g),
             "trace": lambda g: sum(x[5] for x in g) >= 2, "impact": lambda g: any(x[0] and (x[4] or x[3]) for x in g),
             "compare": lambda g: sum(x[0] and x[1] for x in g) >= 2, "any": lambda g: any(x[6] for x in g)}
    got = contracts.minimum_contract(slots, asked)
    for r in got.collect():
        g = flags.get(r.query_id, [])
        if all(x[6] is None for x in g):
            assert not r.met and r.reason == "no targets"
        else:
            assert bool(r.met) == tests[r.question_type](g), r
    assert plan(got).count("Join") == 1
    claims = spark.createDataFrame([(q, 0, q % 2 == 0) for q in range(30)], "query_id long, claim_index int, covered boolean")
    assert contracts.minimum_contract(slots, asked, claims).where(F.col("reason").contains("claims")).count() > 0
