import pytest

from revgrain.streaming import evaluation
from revgrain.streaming.runner import drain, table_stream


@pytest.mark.parametrize("files", [0, 3])
def test_table_is_one_file_or_a_folder(spark, tmp_path, files):
    """A stream of a table that is a folder found no file, so nothing was written and reading it back failed."""
    rows = spark.range(60).selectExpr("id as sample_id", "cast(id % 2 as int) as quality")
    if files:
        rows.repartition(files).write.parquet(str(tmp_path / "labels.parquet"))
    else:
        rows.toPandas().to_parquet(tmp_path / "labels.parquet")
    spark.range(5).write.parquet(str(tmp_path / "more_labels.parquet"))  # another table beside it
    stream = table_stream(spark, str(tmp_path), "labels")
    assert drain(stream, str(tmp_path / "a")).count() == 60
    got = evaluation.judge_stream(stream, lambda df: df.selectExpr("sample_id", "quality > 0 as good"), str(tmp_path / "b"))
    assert {(r.sample_id, r.good) for r in got.collect()} == {(n, n % 2 > 0) for n in range(60)}
