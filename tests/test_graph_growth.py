import random
import re

from revgrain.operators import graph


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_levels_meet_the_visited_in_one_aggregate(spark, monkeypatch):
    """A level was made distinct, then sorted with all visited pairs for an anti join in the same task."""
    rng, plans = random.Random(8), []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: plans.append(plan(df)) or cut(df))
    edges = [(rng.randint(0, 15), rng.choice([*range(15), None])) for _ in range(40)] * 2 + [(None, 3), (4, 4)]
    starts = [*range(12), 3, None]
    got = graph.call_graph(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame([(s,) for s in starts], "start long"), 3)
    want = []
    for s in set(starts):
        seen, now = {s}, {s}
        for depth in (1, 2, 3):
            step = {t for n in now for a, t in edges if a == n and n is not None}
            now = step - {n for n in seen if n is not None}
            want += [(s, n, depth) for n in now]
            seen |= now
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert len(plans) == 3 and not any("LeftAnti" in p for p in plans)
    monkeypatch.setattr(graph, "PAIRS", 3)
    again = graph.call_graph(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame([(s,) for s in starts], "start long"), 3)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(want, key=repr)
    assert max(int(n) for p in plans for n in re.findall(r"RepartitionByExpression \[.*?\], (\d+)", p)) > 20
