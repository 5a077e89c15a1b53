"""Diff texts to changed files, line counts, patches and hunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revgrain import fixed
from revgrain.functions.patterns import lookup

KEYS = ["repo_id", "base", "head"]


def _rows(df: DataFrame, column: str) -> DataFrame:
    lines = F.filter(F.split(F.coalesce(column, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return df.select(*KEYS, F.posexplode(lines).alias("pos", "line"))


def parse_name_status(diffs: DataFrame) -> DataFrame:
    """One row per changed file: change_type, path, and old_path for renames."""
    cells = F.split("line", "\t")
    rows = _rows(diffs, "name_status").withColumn("cells", cells).where(F.size("cells") >= 2)
    kind = lookup(F.substring(F.get("cells", F.lit(0)), 1, 1), fixed.GIT_STATUS, "modified")
    rows = rows.withColumn("change_type", kind)
    old = F.when((F.col("change_type") == "renamed") & (F.size("cells") >= 3), F.get("cells", F.lit(1))).otherwise("")
    return rows.select(*KEYS, "pos", "change_type", F.element_at("cells", -1).alias("path"), old.alias("old_path"))


def _renamed_to(path: Column) -> Column:
    """New path of git's short rename notation, a/{b => c}/d or b => c."""
    braced = F.regexp_replace(path, r"\{.* => (.*)\}", "$1")
    return F.replace(F.regexp_replace(braced, r"^.* => ", ""), F.lit("//"), F.lit("/"))


def parse_numstat(diffs: DataFrame) -> DataFrame:
    """Added and deleted lines per file; a dash (binary) or unreadable pair counts as 0."""
    rows = _rows(diffs, "numstat").withColumn("cells", F.split("line", "\t")).where(F.size("cells") >= 3)

    def number(i: int) -> Column:
        c = F.get("cells", F.lit(i))
        return F.when(c == "-", F.lit(0)).otherwise(c.try_cast("int"))

    added, deleted = number(0), number(1)
    return rows.select(
        *KEYS, _renamed_to(F.element_at("cells", -1)).alias("path"),
        F.coalesce(added, F.lit(0)).alias("added"),
        F.when(added.isNull(), 0).otherwise(F.coalesce(deleted, F.lit(0))).alias("deleted"),
    )


def status_join_numstat(status: DataFrame, numstat: DataFrame) -> DataFrame:
    """Changed files with their line counts, joined by path rather than by row position."""
    joined = status.join(numstat, [*KEYS, "path"], "left")
    return joined.select(
        *KEYS, "path", "change_type", "old_path",
        F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("deleted", F.lit(0)).alias("deleted"),
    )


def split_file_patches(diffs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One row per file section of a unified diff, in order, whole unless the caller sets ``max_chars``."""
    parts = F.filter(F.split("diff", r"(?m)^(?=diff --git )"), lambda p: p.startswith("diff --git "))
    rows = diffs.select(*KEYS, F.posexplode(parts).alias("pos", "patch"))
    patch = F.regexp_replace("patch", r"\n$", "")
    return rows.select(
        *KEYS, "pos", F.regexp_extract("patch", r"^diff --git a/.* b/([^\n]*)", 1).alias("path"),
        (F.substring(patch, 1, max_chars) if max_chars is not None else patch).alias("patch"),
    )


def parse_hunks(diffs: DataFrame) -> DataFrame:
    """Line ranges of every hunk, under its file; a missing count means one line."""
    head = r"^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@"
    patches = split_file_patches(diffs)
    found = F.regexp_extract_all("patch", F.lit("(?m)" + head), F.lit(0))
    rows = patches.select(*KEYS, "path", F.posexplode(found).alias("hunk", "header"))

    def number(group: int) -> Column:
        text = F.regexp_extract("header", head, group)
        return F.coalesce(F.nullif(text, F.lit("")), F.lit("1")).cast("int")

    return rows.select(
        *KEYS, "path", "hunk", number(1).alias("old_start"), number(2).alias("old_lines"),
        number(3).alias("new_start"), number(4).alias("new_lines"),
    )
