"""Secret scans over content-addressed versions with an incremental ledger.

Every historical version of a path is addressed by the SHA-256 of its text (its blob). The ledger in a shared folder
says which (blob, rule, rule version) pairs have been scanned and what was found; a run scans the unseen pairs alone and
appends one row a blob. Findings are joined back to all paths that ever held the blob. One ledger row holds both the pairs
and the findings, so a run that is lost half-way leaves no pair without its findings, and a repeated run does the rest.

Spans are stored as gaps and lengths in code points, in text order; adding them up gives the places. Everything is SQL:
``split`` and ``regexp_extract_all`` see the same leftmost, non-overlapping matches.

Defined cases: a null text counts as empty; empty texts give no finding; equal texts are scanned once and reported for each
row; an empty table gives an empty result; a text of any length is scanned whole.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revgrain.llm.common import scratch_path, text_of


class Rule(NamedTuple):
    """A kind of secret. A match counts if its group has ``least`` code points; the span is the whole match."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1
    base: bool = False


#: The base kinds first, in the order that breaks ties of the start; then kinds the ledger adds.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 18, base=True),  # a maximal run of the class, so the length may stand in the pattern
    Rule("hex", r"[0-9a-f]{16,}", 16, base=True),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 1),
]
LEDGER = "blob string, run string, scanned array<struct<kind:string,version:int>>, hits array<struct<kind:string,version:int,nth:int,gap:int,size:int,inner:int>>"


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def _hits(rule: Rule) -> Column:
    """Matches of one rule in ``text`` as an array of (nth, gap before, size, size of the tested group)."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split("text", rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length)
    inner = F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.length)
    rows = F.transform(
        F.arrays_zip(gaps, sizes, inner),
        lambda x, i: F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), i.alias("nth"),
            x["0"].alias("gap"), x["1"].alias("size"), x["2"].alias("inner"),
        ),
    )
    rows = F.filter(rows, lambda x: x["size"].isNotNull())  # the part after the last match has no match of its own
    nothing = F.array().cast("array<struct<kind:string,version:int,nth:int,gap:int,size:int,inner:int>>")
    wanted = F.array_contains("todo", rule.kind) & F.col("text").rlike(rule.pattern)
    return F.when(wanted, rows).otherwise(nothing)


def scan_unseen(versions: DataFrame, ledger: str, rules: list[Rule] = RULES, text_col: str = "text") -> None:
    """Scan every (blob, rule, version) pair the ledger at ``ledger`` doesn't have, and append the outcome to it."""
    spark = versions.sparkSession
    text = text_of(text_col)
    blobs = versions.select(blob_of(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    pairs = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    empty = spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in LEDGER.split(", "))])
    empty.write.mode("append").parquet(ledger)
    seen = _ledger(spark, ledger)
    if seen.isEmpty():
        todo = blobs.withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    else:
        done = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))  # at most runs x rules a blob
        left = F.array_except(pairs, F.coalesce("done", F.array().cast("array<struct<kind:string,version:int>>")))
        todo = blobs.join(done, "blob", "left").withColumn("todo", F.transform(left, lambda x: x["kind"])).filter(F.size("todo") > 0)
    scanned = F.filter(pairs, lambda x: F.array_contains("todo", x["kind"]))
    found = todo.select("blob", F.lit(uuid.uuid4().hex).alias("run"), scanned.alias("scanned"), F.concat(*[_hits(r) for r in rules]).alias("hits"))
    found.write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: list[Rule] = RULES) -> DataFrame:
    """Findings of the current rule versions in all blobs: (blob, kind, kind_no, start, end), end exclusive."""
    hits = _ledger(spark, ledger).filter(F.size("hits") > 0).select("blob", "run", F.explode("hits").alias("hit")).select("blob", "run", "hit.*")
    upto = Window.partitionBy("blob", "run", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    kinds = F.lit(None)
    for no, rule in enumerate(rules):
        kinds = F.when((F.col("kind") == rule.kind) & (F.col("version") == rule.version) & (F.col("inner") >= rule.least), no).otherwise(kinds)
    return placed.withColumn("kind_no", kinds).filter("kind_no is not null").select("blob", "kind", "kind_no", "start", "end").distinct()


def spans_by_blob(found: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Per blob: counts of the base kinds and the spans in order, base ones and all, as texts, and as an array."""
    item = F.struct("start", "kind_no", "end", F.concat_ws(":", "kind", "start", "end").alias("said"))
    base = [no for no, r in enumerate(rules) if r.base]
    spans = found.groupBy("blob").agg(
        F.sort_array(F.collect_list(item)).alias("spans"),
        *[F.sum((F.col("kind_no") == no).cast("long")).alias(f"n_{rules[no].kind}") for no in base],
    )
    said = lambda xs: F.array_join(F.transform(xs, lambda x: x["said"]), ",")
    return spans.select("*", said(F.filter("spans", lambda x: x["kind_no"].isin(base))).alias("base"), said(F.col("spans")).alias("every"))


def scan_paths(versions: DataFrame, ledger: str | None = None, rules: list[Rule] = RULES, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``versions`` beside what its blob holds: its columns (or ``keep``) as ``path.*``, counts, ``base``, ``every``, ``spans``."""
    spark = versions.sparkSession
    ledger = ledger or scratch_path(spark, "secret-ledger")
    scan_unseen(versions, ledger, rules, text_col)
    paths = versions.select(F.struct(*[F.col(c) for c in keep or versions.columns]).alias("path"), blob_of(text_of(text_col)).alias("blob"))
    spans = spans_by_blob(findings(spark, ledger, rules), rules)
    return paths.join(spans, "blob", "left")


def redact(versions: DataFrame, ledger: str | None = None, rules: list[Rule] = RULES, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows with each found span replaced by ``mark``; overlapping spans are replaced as one. Columns stay as they are."""
    scanned = scan_paths(versions, ledger, rules, text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(f"path.{text_col}")

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.col("spans").isNull(), text).otherwise(whole)
    return scanned.select(*[clean.alias(c) if c == text_col else F.col("path")[c].alias(c) for c in versions.columns])
