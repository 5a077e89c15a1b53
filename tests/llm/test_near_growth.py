import glob

import pytest
from revgrain.llm import minhash
from revgrain.llm.common import tidied
from revgrain.llm.graph import components


@pytest.fixture
def wide(spark):
    """Shuffles of many partitions that nothing joins."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components_of_a_small_graph_take_few_partitions(wide):
    edges = wide.range(60).selectExpr("id as a", "id + 1 as b").filter("a % 20 <> 19")
    found = components(edges)
    assert found.rdd.getNumPartitions() <= 2
    assert {(r.id, r.component) for r in found.collect()} == {(i, i // 20 * 20) for i in range(60)}


def test_rounds_go_on_with_open_buckets_alone(spark, monkeypatch):
    met = []
    plain = minhash._open

    def seen(rows, labels):
        met.append(sorted(r.id for r in rows.collect()))
        return plain(rows, labels)

    monkeypatch.setattr(minhash, "_open", seen)
    search = minhash.Search(None, None, 85)
    linked = spark.createDataFrame([(1, 1), (2, 1)], "id long, component long")

    def test(pairs):
        search.labels = linked
        return len(met) < 3

    search.test = test
    rows = spark.createDataFrame([(7, 1), (7, 2), (8, 3), (8, 4)], "key long, id long")
    left = search.centres(rows)
    assert met == [[1, 2, 3, 4], [1, 2, 3, 4], [3, 4]]
    assert sorted(r.id for r in left.collect()) == [3, 4]


def test_shuffle_files_of_a_step_go_with_it(spark, tmp_path):
    def shuffles():
        folders = {p.rsplit("/", 1)[0] for p in glob.glob("/tmp/blockmgr-*/*")}
        return {f for p in folders for f in glob.glob(f"{p}/*/shuffle_*")}

    before = shuffles()
    frame = spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count()
    with tidied(spark):
        frame.select("*").write.parquet(f"{tmp_path}/a")
    assert not shuffles() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert spark.read.parquet(f"{tmp_path}/a").count() == 7


def test_a_centre_of_many_pairs_is_looked_up_once(spark):
    pairs = spark.range(1, 2001).selectExpr("0L as a", "id as b").unionByName(spark.range(2, 2001).selectExpr("1L as a", "id as b"))
    met = minhash._met(spark.range(3000).selectExpr("id", "id as n"), pairs)
    assert sorted(r.id for r in met.collect()) == list(range(2001))
    assert "Generate" not in met._jdf.queryExecution().executedPlan().toString()
    assert minhash._ids(pairs).count() == 2001
