"""Facts kept by content: equal to a parse of every file, and no text parsed twice."""

import tempfile

from revgrain.operators import fact_store, pycode

FILES = "repo string, path string, text string"
SHARED = "class A:\n    def go(self):\n        return go(1)\n"


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_texts_are_parsed_once(spark):
    store = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/store"
    first = spark.createDataFrame([("a", "x.py", SHARED), ("a", "y.py", SHARED), ("a", "bad.py", "def ("), ("a", "n.py", None), ("a", "n.md", "# no")], FILES)
    assert fact_store.add_contents(first, store).count() == 3
    second = spark.createDataFrame([("b", "x.py", SHARED), ("b", "y.py", "import os\n"), ("b", "e.py", "")], FILES)
    assert fact_store.add_contents(second, store).count() == 1
    assert fact_store.add_contents(second, store).count() == 0
    both = first.unionByName(second)
    got = fact_store.facts_of(both, store, ["repo"])
    for repo in "ab":
        mine = both.where(f"repo = '{repo}'").select("path", "text")
        assert rows(got.where(f"repo = '{repo}'").drop("repo")) == rows(pycode.python_facts(mine))
    # What a run that died has left is read by nobody, and its text is parsed again.
    spark.read.parquet(f"{store}/facts").drop("run").write.parquet(f"{store}/facts/run=died")
    assert rows(fact_store.facts_of(both, store, ["repo"])) == rows(got)


def test_nothing_to_store(spark):
    store = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/store"
    none = spark.createDataFrame([], FILES)
    assert fact_store.facts_of(none, store).count() == 0 and fact_store.add_contents(none, store).count() == 0
