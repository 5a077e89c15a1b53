import random

from revgrain.operators import joins


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_citations_meet_their_places_without_a_sort(spark):
    """Citations and places were aggregated, sorted and joined in the same task."""
    rng = random.Random(9)
    some = lambda *x: rng.choice([*x, None])
    samples = [(s,) for s in [1, 2, 3, 4, 5, 5, None]]
    citations = [(some(1, 2, 3, 4), some("a.py", "b.py"), some(1, 2), 1) for _ in range(14)] + [(1, "a.py", 1, 2)] * 2 + [(5, "a.py", 2, 1)]
    evidence = [(some(1, 2, 3), some("a.py", "b.py"), some(1, 2), 9) for _ in range(30)] + [(5, "a.py", 2, 4)]
    want = [(s, any(c[0] == s for c in citations) and s is not None and all(None not in c[:3] and c[:3] in {e[:3] for e in evidence} for c in citations if c[0] == s)) for s in {s for s, in samples}]
    got = joins.citations_strict(spark.createDataFrame(samples, "sample_id long"), spark.createDataFrame(citations, "sample_id long, file string, line long, times long"),
                                 spark.createDataFrame(evidence, "sample_id long, file string, start_line long, end_line long"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert plan(got).count("Join") == 0
