"""Source files: reading them, dropping excluded folders, cutting them into lines."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revgrain import fixed
from revgrain.functions import paths
from revgrain.functions.patterns import text_lines

#: Name of the file of rows without a name, as Spark's writer calls it.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def _any_case(extension: str) -> str:
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def read_corpus(spark: SparkSession, path: str, extensions: list[str], max_bytes: int | None = None) -> DataFrame:
    """Files below ``path`` with an allowed extension, in any case, and at most ``max_bytes``, if given: path, length, text.

    Both tests run on the file listing, so other files are never opened. Bytes that aren't UTF-8 become U+FFFD.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{" + ",".join(_any_case(e) for e in extensions) + "}")
        .load(path)
    )
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return files.select("path", "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def write_files(files: DataFrame, folder: str) -> None:
    """Plain files below ``folder`` of (name, text), one a name and partition; each text stands before an end mark, a zero byte.

    In a folder of the local or a mounted file system tasks write to the places where the files stay, one folder a partition:
    Spark's own writer, which other file systems get, takes a folder, check sums and moves for every file. A task that is run
    again writes the same files again.
    """
    url = urlsplit(folder)
    if url.scheme not in ("", "file"):
        files.select("name", "text").write.partitionBy("name").option("lineSep", chr(0)).text(folder)
        return
    root = unquote(url.path) if url.scheme else folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, last, out = f"{root}/{TaskContext.get().partitionId()}", None, None
        os.makedirs(place, exist_ok=True)
        for batch in batches:
            for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist()):
                if out is None or name != last:
                    if out is not None:
                        out.close()
                    last, out = name, open(f"{place}/name={NO_NAME if name is None else name}.txt", "wb")
                out.write((text or "").encode() + b"\0")
        if out is not None:
            out.close()
        yield from ()

    files.select("name", "text").sortWithinPartitions("name").mapInArrow(write, "n long").count()


def file_name(path: Column | str) -> Column:
    """The name that ``write_files`` gave a file."""
    return F.regexp_extract(path, r"name=([^/]*?)(?:/part-[^/]*)?\.txt$", 1)


def exclude_dirs(files: DataFrame, dirs: list[str], hidden: bool = False, any_case: bool = True) -> DataFrame:
    """Drop files with an excluded folder (or, on request, a hidden one) in their path."""
    path = F.lower("path") if any_case else F.col("path")
    drop = paths.in_dirs(path, dirs)
    return files.where(~(drop | paths.hidden("path")) if hidden else ~drop)


def exclude_environments(files: DataFrame) -> DataFrame:
    return exclude_dirs(files, fixed.ENVIRONMENT_DIRS, any_case=False)


def exclude_non_production(files: DataFrame) -> DataFrame:
    return exclude_dirs(files, fixed.NON_PRODUCTION_DIRS)


def explode_lines(files: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per line, numbered from 1. Only ``keep`` travels along, never the whole text."""
    return files.select(*keep, F.posexplode(text_lines(text)).alias("pos", "line")).select(
        *keep, (F.col("pos") + 1).alias("line_no"), "line"
    )


def corpus_size(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files and bytes per group, without the repository's own folder."""
    return (
        files.where(~paths.in_dirs("path", [".git"]))
        .groupBy(*keys)
        .agg(F.count("*").alias("file_count"), F.sum(F.octet_length("text").cast("bigint")).alias("total_bytes"))
    )
