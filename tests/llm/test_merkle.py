"""Proofs by pointer jumping against a plain tree."""

import random

from pyspark.sql import functions as F

from revgrain.llm import merkle
from tests.llm import brute

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def held(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' as idx", "'x' as key", "'x' as tree", "'x' as hash", "'x' as part")
    lower = merkle.leaf([F.lower("text") if f == "text" else F.col(f) for f in merkle.FIELDS])
    made = merkle.manifest(df, other=F.when(F.col("doc_id") % 2 == 0, lower))
    got = merkle.with_subroots(made).select("id", merkle.digest(F.col("leaf")).alias("leaf"), "subroot", merkle.siblings(F.col("segment")).alias("said"), merkle.fold(merkle.digest(F.coalesce("other", "leaf")), F.col("segment")).alias("folded")).collect()
    root, want = brute.merkle(rows, 2, 0)
    changed = [brute.leaf((*r[:4], r[4].lower() if r[4] is not None and r[0] is not None and r[0] % 2 == 0 else r[4])) for r in rows]
    wanted = [(r[0], leaf, sub, "".join(h for left, right in proof for h in left + right), brute.fold(c, proof)) for r, c, (leaf, sub, proof) in zip(rows, changed, want)]
    assert made.root == root
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
    return {(r.id, r.folded == root) for r in got}


def test_keys_of_many_sizes(spark):
    random.seed(5)
    sizes = {"en": 700, "de": 65, "é": 64, "fr": 9, "es": 8, None: 2, "": 1, "z": 1, "Z": 1}
    rows = [(random.randrange(10**6), random.choice(["a", None]), lang, random.choice([3, None]), random.choice(["Text", "low", "", None, "Ä" * 5_000])) for lang, n in sizes.items() for _ in range(n)]
    rows += [(None, "a", "fr", 1, "x"), (7, "a", "fr", 1, "X"), (7, "a", "fr", 1, "x"), (7, "a", "fr", 1, "x")]
    random.shuffle(rows)
    verified = held(spark, rows)
    assert {v for _, v in verified} == {True, False}


def test_one_row_one_key_no_rows(spark):
    held(spark, [(1, "a", "en", 1, "x")])
    held(spark, [(1, "a", None, 1, None)])
    held(spark, [(n, "a", "en", 1, "x") for n in range(20)])
    held(spark, [(1, "a", "en", 1, "x"), (1, "a", "de", 1, "x")])
    made = merkle.manifest(spark.createDataFrame([], COLUMNS))
    assert made.root is None and made.proofs.count() == 0


def test_many_keys(spark):
    held(spark, [(n, "a", f"k{n % 90}", 1, "x") for n in range(300)])
