"""The pipeline's stages against plain versions."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from revgrain.llm import queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "minhash near-dedup", "secret scans", "best-fit packing"]
    toxic = {r.doc_id for r in queries.QUERIES["op3_toxicity"](spark, SF).filter("predicted = 1").collect()}
    clean = corpus_pipeline.clean(spark, docs, SF).cache()
    assert {i for i, _ in texts(clean)} == {i for i, _ in texts(docs)} - toxic
    once = corpus_pipeline.different(spark, clean, SF).cache()
    assert sorted(i for i, _ in texts(once)) == sorted(r[0] for r in brute.exact(texts(clean)) if r[3])
    unlike = corpus_pipeline.unlike(spark, once, SF).cache()
    assert sorted(i for i, _ in texts(unlike)) == sorted(i for i, (_, c) in brute.near(texts(once)).items() if c == i)
    safe = corpus_pipeline.redacted(spark, unlike, SF).cache()
    assert not [t for _, t in texts(safe) if brute.secrets(t)]
    assert {i for i, _ in texts(safe)} == {i for i, _ in texts(unlike)}
    untouched = {i: t for i, t in texts(unlike) if not brute.secrets(t)}
    assert all(t == untouched[i] for i, t in texts(safe) if i in untouched)
    for df in (clean, once, unlike, safe):
        assert df.columns == docs.columns and df.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert safe.filter(F.length("text") != F.col("n_chars")).count() == 0
    out = corpus_pipeline.packed(spark, safe, SF)
    sums = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 1024 for r in sums)
    assert out.select("doc_id").distinct().count() == len(texts(safe))


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, SF).count() >= 1


def test_hard_rows_pass_every_stage(spark, docs):
    rows = docs([(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "token=abcdefghijkl"), (None, "other"), (4, "w " * 40_000)], extra=False)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
    # Nothing but blanks is one group of copies, the repeated row is one, and rows without an id keep their texts.
    assert sorted(i or 0 for i, _ in texts(rows)) == [0, 0, 1, 3, 4]
    assert corpus_pipeline.packed(spark, rows, SF).filter("doc_id = 4").agg(F.max("piece")).first()[0] > 10
    nothing = docs([], extra=False)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, SF)
    assert nothing.count() == 0


def test_sql_agrees_where_there_is_some(spark):
    from checks.compare import connect, plain

    con = connect(SF)
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        cursor = con.execute(f"select {', '.join(columns)} from ({sql})")
        assert got == sorted(tuple(plain(v) for v in r) for r in cursor.fetchall()), name
    assert isinstance(con, duckdb.DuckDBPyConnection)
