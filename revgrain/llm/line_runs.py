"""Line dedup by levelled sorted runs of line keys.

A line's key is a 128-bit hash of the line in its compared form. The store holds runs: tables of different keys, bucketed and
sorted by key, each with the number of documents and the greatest document of the key. A batch of documents is first
combined to one sorted run of its own keys. A merge join with every run of the store parts it: keys that no run has are added as a run
of level 0 (the anti-join), what the batch says of known keys goes to a list of sightings. So each key stands in one run. ``FAN``
runs of a level are merged into one of the next level, which bounds the runs a batch has to meet by
``FAN`` times the logarithm of the batches. Runs and batches share buckets, so their merge joins shuffle nothing.

Sums over sightings give the keys of at least ``least`` documents with the document that keeps them. Keys so
frequent that at most ``HOT_KEYS`` of them can exist are sent to all tasks; the others are joined by key. The places to drop
then meet the texts, which are shuffled once, if any line goes.

Defined cases: a null or empty text is one empty line; a document counts once for a key, repeated rows count each; of rows
that share the greatest id all keep the line; a null id ranks below all others; an empty table gives an empty result; a text of any
length is cut whole. Only the id and the text column are read, others may have any name.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revgrain.llm.common import scratch_path, text_of, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_POINTS, LEAST_DOCS = 40, 5
#: Batches of the query, runs of a level that are merged, and the most frequent keys that may exist.
BATCHES, FAN, HOT_KEYS = 4, 2, 10_000
KEY = ["k1", "k2"]


def compared(text: Column) -> Column:
    """The lines of a text in their compared form: stripped, A-Z in lower case."""
    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)))


def key_of(line: str) -> list[Column]:
    return [F.xxhash64(F.lit(n), F.col(line)).alias(k) for n, k in enumerate(KEY)]


def document_keys(docs: DataFrame, id_col: str, text_col: str, least_points: int) -> DataFrame:
    """(id, k1, k2) for each different long line of a row."""
    lines = F.array_distinct(F.filter(compared(F.col(text_col)), lambda x: F.length(x) >= least_points))
    return docs.select(F.col(id_col).alias("id"), F.explode(lines).alias("line")).select("id", *key_of("line"))


class Runs:
    """The store: levels of sorted runs and the sightings of keys met again, below one shared folder."""

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan, self.folder = spark, fan, scratch_path(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.sightings: list[str] = []
        self.all: list[str] = []

    def _table(self, rows: DataFrame, name: str) -> str:
        name = f"{name}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        self.all.append(name)
        return name

    def _rows(self, names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.table(n) for n in names])

    def add(self, keys: DataFrame) -> DataFrame:
        """Add a batch of (id, k1, k2); returns its keys that the store knew before: (k1, k2, n_docs, last)."""
        own = self._table(keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("last")), "batch")
        fresh, known = self.spark.table(own), []
        for run in [r for level in self.levels for r in level]:
            known.append(fresh.join(self.spark.table(run).select(*KEY), KEY, "left_semi"))
            fresh = fresh.join(self.spark.table(run).select(*KEY), KEY, "left_anti")
        if known:
            self.sightings.append(self._table(reduce(DataFrame.unionByName, known), "seen"))
        self._push(self._table(fresh, "run") if known else own, 0)
        return self.spark.table(self.sightings[-1]) if known else self.spark.table(own).limit(0)

    def _push(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            merged = self._table(self._rows(self.levels[level]).repartition(self.buckets, *KEY), "run")
            self.levels[level] = []
            self._push(merged, level + 1)

    def frequent(self, least_docs: int) -> DataFrame:
        """(k1, k2, n_docs, last) of the keys of at least so many documents."""
        runs = [r for level in self.levels for r in level]
        if not self.sightings:
            return self._rows(runs).filter(F.col("n_docs") >= least_docs)
        again = self._rows(self.sightings).groupBy(*KEY).agg(F.sum("n_docs").alias("more"), F.max("last").alias("later"))
        total = F.col("n_docs") + F.coalesce("more", F.lit(0))
        joined = [self.spark.table(r).join(again, KEY, "left").select(*KEY, total.alias("n_docs"), F.greatest("last", "later").alias("last")) for r in runs]
        return reduce(DataFrame.unionByName, joined).filter(F.col("n_docs") >= least_docs)

    def drop(self) -> None:
        """Take the tables out of the catalog; their files stay in the shared folder, which the cluster clears."""
        for name in self.all:
            self.spark.sql(f"drop table if exists {name}")


def frequent_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """(k1, k2, n_docs, last) of the long lines in at least ``least_docs`` rows, the table taken in batches of id ranges."""
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    span = max(1, (high or 0) - (low or 0) + 1)
    batch = F.coalesce(F.floor((F.col("id") - F.lit(low or 0)) * batches / F.lit(span)), F.lit(0)).cast("int")
    keys = written(document_keys(docs, id_col, text_col, least_points).withColumn("batch", batch), "line-keys", "batch")
    store = Runs(docs.sparkSession, fan)
    for n in range(batches):
        store.add(keys.filter(F.col("batch") == n).drop("batch"))
    found = written(store.frequent(least_docs), "line-frequent")
    store.drop()
    return found


def dropped_places(docs: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS) -> DataFrame:
    """(id, mark, places) of the rows that lose lines: the row's id, a hash of its text, and the places in order."""
    mark = F.xxhash64(text_col)
    rows = docs.select(F.col(id_col).alias("id"), mark.alias("mark"), F.posexplode(compared(F.col(text_col))).alias("place", "line"))
    lines = rows.filter(F.length("line") >= least_points).select("id", "mark", "place", *key_of("line"))
    total = frequent.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.col("n_docs") > total // HOT_KEYS  # so there are fewer than HOT_KEYS of them
    common = frequent.filter(hot).select(*KEY, F.struct("last").alias("hot"))
    # One pass over the texts: lines of hot keys are settled at once, the others wait for their keys.
    tagged = lines.join(F.broadcast(common), KEY, "left").filter("hot is null or not (hot.last <=> id)")
    tagged = written(tagged.select("id", "mark", "place", *KEY, F.col("hot").isNotNull().alias("goes")), "line-places")
    others = frequent.filter(~hot).select(*KEY, "last")
    rest = tagged.filter("not goes").join(others, KEY).filter("not (last <=> id)")
    gone = tagged.filter("goes").select("id", "mark", "place").unionByName(rest.select("id", "mark", "place"))
    return gone.groupBy("id", "mark").agg(F.array_sort(F.collect_set("place")).alias("places"))


def _kept(lines: Column, places: Column) -> Column:
    """``lines`` without those at ``places``, which are in order: a string of marks, one a line, says which stay."""
    gap = F.transform(places, lambda p, i: F.concat(F.repeat(F.lit("1"), p - F.when(i > 0, F.get(places, i - 1)).otherwise(F.lit(-1)) - 1), F.lit("0")))
    marks = F.split(F.rpad(F.array_join(gap, ""), F.size(lines), "1"), "")
    return F.transform(F.filter(F.arrays_zip(lines.alias("line"), marks.alias("mark")), lambda x: x["mark"] == "1"), lambda x: x["line"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """The rows of ``docs`` as ``row.*`` with ``kept`` (the text without repeated lines), ``n_lines`` and ``n_dropped``."""
    found = frequent_keys(docs, id_col, text_col, **limits)
    places = dropped_places(docs, found, id_col, text_col, limits.get("least_points", LEAST_POINTS))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    marked = docs.select(row, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))
    same = [marked["id"].eqNullSafe(places["id"]), marked["mark"] == places["mark"]]
    joined = marked.join(places, same, "left").select("row", "places")
    lines = F.split(text_of(f"row.{text_col}"), "\n", -1)
    kept = F.when(F.col("places").isNull(), text_of(f"row.{text_col}")).otherwise(F.array_join(_kept(lines, F.col("places")), "\n"))
    return joined.select("row", kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))
