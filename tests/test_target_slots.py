from revgrain import fixed
from revgrain.operators import contracts


def test_target_slots_send_one_row_a_symbol(spark):
    """Each slot of a symbol went through the shuffle as a row, for each relation."""
    rows = [(q, kind, ["a", "b", None if q == 3 else "c"]) for q, kind in [
        (1, "trace_call_chain"), (1, "impact_change"), (1, "impact_change"), (2, "enumerate_usages"), (3, "no such type"), (None, "compare_behavior"), (4, None)]]
    relations = spark.createDataFrame(rows, "query_id long, type string, subjects array<string>")
    alone = spark.createDataFrame([(1, "z"), (2, "a")], "query_id long, symbol string")
    want = {(q, s, slot) for q, kind, names in rows for s in names
            for slot in (fixed.NODE_SLOTS if kind == "trace_call_chain" else fixed.RELATION_SLOTS.get(kind, ["definition"]))}
    got = contracts.target_slots(relations)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    both = contracts.target_slots(relations, alone)
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(want | {(q, s, slot) for q, s in [(1, "z"), (2, "a")] for slot in fixed.NODE_SLOTS}, key=repr)
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = next(i for i, line in enumerate(lines) if "Generate" in line)
    assert any("Aggregate" in line for line in lines[last:])  # slots become rows behind the aggregate


def test_every_slot_has_a_place_in_the_order():
    assert {s for slots in [*fixed.RELATION_SLOTS.values(), fixed.NODE_SLOTS] for s in slots} <= set(fixed.SLOT_ORDER)
