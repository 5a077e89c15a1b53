from pyspark.sql import functions as F

from revgrain.functions import search
from revgrain.functions.patterns import python_strip
from revgrain.operators import token_index


def test_the_vocabulary_is_made_once(spark, monkeypatch):
    """The substring join read the tokens of all lines three times, each time from the texts."""
    cut, made = token_index.cut_lineage, []
    monkeypatch.setattr(token_index, "cut_lineage", lambda df: made.append(df.columns) or cut(df))
    seen = []
    shards = token_index._in_shards
    monkeypatch.setattr(token_index, "_in_shards", lambda texts, *rest: seen.append(texts._jdf.queryExecution().optimizedPlan().toString()) or shards(texts, *rest))
    lines = spark.createDataFrame([("a.py", 1, "def load_rows(x):"), ("a.py", 2, "other"), ("b.py", 1, "LOAD it")], "path string, line_no int, line string")
    queries = spark.createDataFrame([("q", ["load", "rows"])], "query_id string, words array<string>")
    got = token_index.search_topk(lines, queries, 5, ["path"])
    assert sorted((r.path, r.line_no, r.matched_terms) for r in got.collect()) == [("a.py", 1, "load,rows"), ("b.py", 1, "load")]
    assert ["token"] in made and len(seen) == 1 and "Generate" not in seen[0]


def test_strip_takes_what_the_pattern_takes(spark):
    """The pattern looked at every character of a text, several times a hit."""
    texts = [("x",), ("",), (None,), (" \t\n",), ("  a  b \r\n",), ("\u0085é 　",), ("a\nb\n \n",), ("𝒳 ",)] + [(f"{chr(c)}{chr(c)}x{chr(c)}y{chr(c)}",) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame(texts, "t string").withColumn("old", F.regexp_replace("t", r"(?U)^\s++|(?<!\s)\s++$", "")).withColumn("new", python_strip("t"))
    assert rows.where(~F.col("old").eqNullSafe(F.col("new"))).count() == 0
    assert "regexp_replace" not in rows.select(python_strip("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_precision_by_word(spark):
    rows = [("a load b", "load", 300), ("a Load b", "load", 250), ("a loads b", "load", 50), ("loads Load", "load", 250), ("a b", "load", 0), ("a.b", "a.b", 300), ("axb", "a.b", 0)]
    got = spark.createDataFrame(rows, "t string, w string, want int").select(search.word_precision("t", F.col("w")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
