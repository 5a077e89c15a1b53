"""Substring joins against every pair."""

import random

import pytest

from revgrain.operators import matching


def rows_and_values():
    random.seed(2)
    say = lambda n: "".join(random.choices("ab é", k=n))
    rows = [(random.choice([1, 1, 1, 2, 3]), i, say(random.randint(0, 30))) for i in range(400)] + [(None, 900, "ab"), (1, 901, None), (9, 902, "ab"), (4, 903, "ab"), (1, 904, "ab" * 5_000)]
    values = [(random.choice([1, 1, 2, 3, 5]), say(random.randint(1, 5))) for _ in range(120)] + [(None, "a"), (1, None), (4, ""), (2, "a"), (2, "a")]
    return rows, values


@pytest.mark.parametrize("texts, block, few", [(20_000, 10_000, 128), (25, 10, 0), (25, 10, 30), (20_000, 10_000, 20)])
def test_every_match_once(spark, monkeypatch, texts, block, few):
    for name, n in (("RUN_TEXTS", texts), ("BLOCK_VALUES", block), ("FEW", few)):
        monkeypatch.setattr(matching, name, n)
    rows, values = rows_and_values()
    left, right = spark.createDataFrame(rows, "k long, i long, t string"), spark.createDataFrame(values, "k long, v string")
    want = {(k, i, v) for k, i, t in rows for q, v in values if k is not None and k == q and t is not None and v is not None and v in t}
    got = [(r.k, r.i, r.v) for r in matching.contained(left, right, ["k"], "t", "v").collect()]
    assert len(got) == len(want) and set(got) == want
    some = [(r.k, r.i, r.v) for r in matching.contained(left, right, ["k"], "t", "v", once="value").collect()]
    assert set(some) <= want and {(k, v) for k, _, v in some} == {(k, v) for k, _, v in want}
    some = [(r.k, r.i, r.v) for r in matching.contained(left, right, ["k"], "t", "v", once="row").collect()]
    assert set(some) <= want and {i for _, i, _ in some} == {i for _, i, _ in want}


    either = {(k, i, v) for k, i, t in rows for q, v in values if k is not None and k == q and t is not None and v is not None and (v in t or t in v)}
    got = [(r.k, r.i, r.v) for r in matching.contained(left, right, ["k"], "t", "v", both=True).collect()]
    assert len(got) == len(either) and set(got) == either


def test_nothing_to_match(spark):
    none = spark.createDataFrame([], "k long, t string"), spark.createDataFrame([], "k long, v string")
    assert matching.contained(*none, ["k"], "t", "v").count() == 0
