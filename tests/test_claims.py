import random

import pytest

from revgrain.operators import joins


@pytest.mark.parametrize("few, most", [(128, 1 << 16), (2, 1 << 16), (128, 40), (0, 0)])
def test_claims_are_sent_once(spark, monkeypatch, few, most):
    """Claims went through five shuffles, three of them a row a word, and were cut into words three times."""
    monkeypatch.setattr(joins, "FEW", few)
    monkeypatch.setattr(joins, "FEW_BYTES", most)
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "42", "x", "delta"]
    claims = [(rng.choice([1, 2, 3, 4, None]), f"c{i}" if i % 9 else None, " ".join(rng.sample(words, 2)) if i % 7 else None) for i in range(80)]
    claims += claims[:5]
    evidence = [(rng.choice([1, 2, 2, 2, 5, None]), rng.choice(["def ALPHA()", "has beta", "nothing", None, "42 x"])) for _ in range(12)]
    held = lambda q, c: any(w.lower() in (s or "").lower() for p, s in evidence if q is not None and p == q for w in (c or "").split() if w not in ("42", "x"))
    want = sorted(((q, i, c, i is not None and held(q, c)) for q, i, c in claims), key=repr)
    got = joins.claims_covered(spark.createDataFrame(claims, "query_id long, claim_index string, claim string"), spark.createDataFrame(evidence, "query_id long, snippet string"))
    assert sorted(map(tuple, got.collect()), key=repr) == want
    if few == 128 and most > 40:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "Generate" not in plan
