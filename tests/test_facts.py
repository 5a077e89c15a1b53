from revgrain.operators import pycode


def test_facts_go_out_in_bounded_batches(spark):
    """All facts of a batch of files were held at once."""
    body = "".join(f"def f{n}(x):\n    return g{n}(x)\n" for n in range(3000))
    rows = [(f"m{k}.py", body) for k in range(4)] + [("bad.py", "def ("), ("none.py", None), ("n.txt", "x")]
    facts = pycode.python_facts(spark.createDataFrame(rows, "path string, text string").coalesce(1))
    assert facts.where("fact = 'symbol'").count() == 4 * 3000 and facts.where("fact = 'error'").count() == 1
    row = facts.where("path = 'm0.py' and name = 'f7'").first()
    assert (row.kind, row.line, row.end_line, row.calls, row.alias) == ("function", 15, 16, ["g7"], None)
    batches = list(pycode.fact_batches([("a.py", body), ("b.py", body)], pycode.fact_schema()))
    assert max(b.num_rows for b in batches) == pycode.FACT_ROWS and sum(b.num_rows for b in batches) == 4 * 3000
