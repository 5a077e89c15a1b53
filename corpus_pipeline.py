"""From raw documents to packed training sequences: each stage takes the rows that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgrain.llm import exact_dedup, minhash, packing, secrets, toxicity
from revgrain.llm.common import bounded_batches, written
from revgrain.llm.queries import TOKENIZERS, TOXIC, toxicity_model


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic; texts that are null or empty stay."""
    bounded_batches(spark)
    return docs.filter(toxicity.score_of(toxicity_model(spark, docs, sf_dir))("text") < TOXIC)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies; a repeated row stays once."""
    kept = exact_dedup.exact_duplicates(docs).filter("kept").select(F.struct("id", "digest").alias("key"))
    key = F.struct(F.col("doc_id").alias("id"), F.sha2(exact_dedup.normalised(F.coalesce("text", F.lit(""))), 256).alias("digest"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; rows that only share an id are told apart, rows without an id stay."""
    bounded_batches(spark)
    return minhash.keep_one(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark."""
    rows = secrets.redact(docs)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    bounded_batches(spark)
    rows = packing.pack(packing.pieces(docs, f"{TOKENIZERS}/byte_bpe_50k.json", False, 2))
    return rows.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", clean), ("exact dedup", different), ("minhash near-dedup", unlike), ("secret scans", redacted), ("best-fit packing", packed)]
#: The scores of the first stage and the tokens of the last are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
