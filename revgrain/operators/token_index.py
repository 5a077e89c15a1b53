"""Line search with the queries as a table, by an inverted index of tokens.

``postings`` is the index: a caller who searches often writes it once, here it is made on the way. A search matches the
longest token run of each query word against the index's vocabulary, as a substring, by ``matching.contained``; that gives the tokens whose
postings can hold the word, and only their lines are read and tested. Words of several runs are tested whole on these lines;
words without any letter, digit or underscore have no postings and are looked for in all lines. Patterns run once for each
(line, word), however many queries share the word, and the plan's size doesn't grow with the number of queries.

Defined cases: null and empty words and repeated words of a query count as absent; a query without hits has no rows; null lines
hold nothing; an empty table gives an empty result. ``keys`` name a file, such as ``["repo", "path"]``: files of equal path in
different repositories stay apart, and each repository has its own ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from revgrain.functions import paths, search
from revgrain.operators import matching, ranking
from revgrain.session import cut_lineage

TOKEN = r"[\p{L}\p{N}\p{M}_]+"
#: Parts that a token's postings are dealt over when the tokens are too many for a broadcast.
PARTS = 16


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def postings(lines: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """One row (token, file keys, line_no) for each different lower-cased token of a line."""
    return lines.select(F.explode(F.array_distinct(_runs(F.col("line")))).alias("token"), *keys, "line_no")


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, place, word, low, root) of queries (query_id, words); ``root`` is the longest token run, null if there is none."""
    words = F.array_distinct(F.filter("words", lambda w: w != ""))
    rows = queries.select("query_id", F.posexplode(words).alias("place", "word")).withColumn("low", F.lower("word"))
    longest = F.array_max(F.transform(_runs(F.col("word")), lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))
    return rows.withColumn("root", longest["run"])


def _in_shards(texts: DataFrame, text: str, values: DataFrame, value: str) -> DataFrame:
    """Texts and values that they contain; texts are dealt over shards, each with all values."""
    shards = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.withColumn("_shard", F.pmod(F.xxhash64(text), F.lit(shards)))
    copied = values.select(value, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("_shard"))
    return matching.contained(dealt, copied, ["_shard"], text, value).drop("_shard")


def _lines_of(index: DataFrame, tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct (file keys, line_no, root) of the postings of ``tokens`` (token, root)."""
    tokens = cut_lineage(tokens)
    if tokens.limit(matching.BROADCAST_KEYS + 1).count() <= matching.BROADCAST_KEYS:
        met = index.join(F.broadcast(tokens), "token")
    else:  # a token may stand in a large part of all lines
        part = F.pmod(F.xxhash64(*keys, "line_no"), F.lit(PARTS))
        copied = tokens.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        met = index.withColumn("_part", part).join(copied, ["token", "_part"])
    return met.select(*keys, "line_no", "root").distinct()


def word_hits(lines: DataFrame, words: DataFrame, keys: Sequence[str] = ("path",), index: DataFrame | None = None) -> DataFrame:
    """(file keys, line_no, line, word, low) of every line and each different word of ``words`` in it, in any case."""
    index = postings(lines, keys) if index is None else index
    words = cut_lineage(words.select("word", "low", "root").distinct())
    rooted, bare = words.where("root is not null"), words.where("root is null")
    vocabulary = cut_lineage(index.select("token").distinct())  # the join reads it several times
    tokens = _in_shards(vocabulary, "token", rooted.select("root").distinct(), "root")
    found = _lines_of(index, tokens, keys).join(rooted, "root").drop("root")
    texts = lines.select(*keys, "line_no", "line")
    hits = texts.join(found, [*keys, "line_no"]).where(F.lower("line").contains(F.col("low")))
    if bare.isEmpty():
        return hits
    said = _in_shards(texts.withColumn("_said", F.lower("line")), "_said", bare.select("low").distinct(), "low").drop("_said")
    return hits.unionByName(said.join(bare.drop("root"), "low"))


def search_hits(
    lines: DataFrame, queries: DataFrame, keys: Sequence[str] = ("path",), line_kinds: DataFrame | None = None, index: DataFrame | None = None
) -> DataFrame:
    """Scored hits of all queries, as ``ranking.search_hits`` gives them for queries in the plan.

    ``line_kinds`` (file keys, line_no, kind), where given, overrides the textual hit type.
    """
    words = query_words(queries)
    hits = word_hits(lines, words, keys, index).withColumn("snippet", search.snippet("line")).where(F.col("snippet") != "").drop("line")
    hits = hits.withColumn("inside", F.lower("snippet").contains(F.col("low"))).withColumn("precision", search.word_precision("snippet", F.col("word")))
    hits = hits.withColumn("defines", F.coalesce(F.lower(search.defined_name("snippet")) == F.col("low"), F.lit(False)))
    asked = hits.join(words.select("query_id", "place", "word"), "word")
    term = F.when(F.col("inside"), F.struct("place", "word"))
    rows = asked.groupBy("query_id", *keys, "line_no", "snippet").agg(
        F.max("precision").alias("precision"), F.count_if("inside").alias("covered"), F.max("defines").alias("defines"), F.collect_list(term).alias("terms"),
    )
    if line_kinds is not None:
        rows = rows.join(line_kinds.select(*keys, "line_no", "kind"), [*keys, "line_no"], "left")
    kind = search.hit_kind("snippet", F.col("defines"), F.col("kind") if line_kinds is not None else None)
    rows = rows.withColumn("hit_type", kind).withColumn("file_type", paths.classify_file("path"))
    score = paths.file_type_score("file_type") + search.hit_type_score("hit_type") + F.col("precision") + search.coverage_score(F.col("covered"))
    terms = F.array_join(F.transform(F.array_sort("terms"), lambda x: x["word"]), ",")
    return rows.select(
        *keys, "line_no", "snippet", "file_type", "query_id", "hit_type", terms.alias("matched_terms"), score.cast("int").alias("score"),
    )


def search_topk(
    lines: DataFrame, queries: DataFrame, k: int = 50, keys: Sequence[str] = ("path",), line_kinds: DataFrame | None = None, index: DataFrame | None = None
) -> DataFrame:
    """The k best files of each query and repository, each with its best line; ``queries`` has (query_id, words)."""
    return ranking.rank_hits(ranking.best_hits(search_hits(lines, queries, keys, line_kinds, index), keys), k, keys)
