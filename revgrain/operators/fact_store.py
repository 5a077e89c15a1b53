"""Facts of source files kept by content: each different text is parsed once, whatever the files, repositories and runs that hold it.

A store is a folder with ``facts`` and ``contents``, a Parquet part a run each. A run writes its facts first and its contents
last, so facts of a run that died are read by nobody and their texts are parsed again. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from revgrain.operators import pycode
from revgrain.session import shuffled

_FACT_COLUMNS = [c.split()[0] for c in pycode.FACTS.split(", ") if not c.startswith("path ")]
_FACTS = pycode.FACTS.replace("path string", "content string") + ", run string"
_CONTENTS = "content string, run string"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        spark.read.parquet(folder).columns
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def _sources(files: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return files.where(F.col("path").endswith(".py")).withColumns({"text": text, "content": F.sha2(text, 256)})


def add_contents(files: DataFrame, store: str) -> DataFrame:
    """Parse the texts of ``files`` that the store hasn't seen and add them; returns the contents added.

    Equal texts meet in each task before the shuffle, so a file that stands in every repository is sent once a task.
    """
    spark, run = files.sparkSession, uuid.uuid4().hex
    seen = _read(spark, f"{store}/contents", _CONTENTS).select("content")
    texts = _sources(files).groupBy("content").agg(F.first("text").alias("text")).join(shuffled(seen), "content", "left_anti")
    texts.write.parquet(f"{store}/texts/run={run}")
    # Read back, so that the parse and the list of contents see the same rows.
    texts = spark.read.schema("content string, text string").parquet(f"{store}/texts/run={run}")
    facts = pycode.python_facts(texts.select(F.concat("content", F.lit(".py")).alias("path"), "text"))
    facts.select(F.substring("path", 1, 64).alias("content"), *_FACT_COLUMNS).write.parquet(f"{store}/facts/run={run}")
    texts.select("content").write.parquet(f"{store}/contents/run={run}")
    return spark.read.schema("content string").parquet(f"{store}/contents/run={run}")


def facts_of(files: DataFrame, store: str, keys: list[str] | None = None) -> DataFrame:
    """The stored facts of each file: (*keys, path, fact columns), as ``pycode.python_facts`` gives them."""
    spark = files.sparkSession
    done = F.broadcast(_read(spark, f"{store}/contents", _CONTENTS).select("run").distinct())  # one row a run
    facts = _read(spark, f"{store}/facts", _FACTS).join(done, "run", "left_semi").drop("run")
    places = _sources(files.select(*(keys or []), "path", "text")).drop("text")
    return places.join(shuffled(facts), "content").select(*(keys or []), "path", *_FACT_COLUMNS)
