"""Citations, claims, ids and other text functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from revgrain import fixed
from revgrain.functions.patterns import UNICODE, col
from revgrain.functions.paths import norm_path

# Same language as the second traceable pattern; the atomic group tries one start per line, so it stays linear.
_FILE_THEN_LINE = r"(?dm)^(?>.*?[\w./-]\.\w).*line\s*\d"
_CLAIM_BREAK = r'[，。！？、：；"（）()\[\]【】\s]+'


def content_id(commit: Column | str, file: Column, start: Column, end: Column, snippet: Column) -> Column:
    """Same place and same text give the same evidence id."""
    commit = F.lit(commit) if isinstance(commit, str) else commit
    raw = F.concat_ws("|", commit, file, start.cast("string"), end.cast("string"), snippet)
    return F.concat(F.lit("ev_"), F.substring(F.md5(raw), 1, 8))


def citations(answer: Column | str) -> Column:
    """array<struct<file,line>> of every file:line reference, repeats included."""
    refs = F.regexp_extract_all(norm_path(F.coalesce(col(answer), F.lit(""))), F.lit(fixed.CITATION), F.lit(0))
    return F.transform(
        refs,
        lambda r: F.struct(
            F.substring_index(r, ":", 1).alias("file"),
            F.substring_index(r, ":", -1).try_cast("bigint").alias("line"),
        ),
    )


def has_citation(answer: Column | str) -> Column:
    text = norm_path(F.coalesce(col(answer), F.lit("")))
    return text.rlike(fixed.TRACEABLE[0]) | (text.contains("line") & text.rlike(_FILE_THEN_LINE))


def cited_ids(answer: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(col(answer), F.lit("")), F.lit(UNICODE + r"\[(ev_\w+)\]"), F.lit(1))


def sentences(answer: Column | str) -> Column:
    """Cut after a full stop, exclamation mark, question mark or line break; the mark stays."""
    return F.filter(F.split(col(answer), r"(?<=[。！？\n])"), lambda s: s != "")


def claim_keywords(claim: Column | str) -> Column:
    words = F.split(F.coalesce(col(claim), F.lit("")), UNICODE + _CLAIM_BREAK)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\p{Nd}+$")))


def estimate_tokens(n_chars: Column | str) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(col(n_chars) / 4).cast("bigint"))


def symbols_equivalent(a: Column | str, b: Column | str) -> Column:
    """Equal, or one is the dotted suffix of the other."""
    a, b = (F.regexp_replace(F.trim(col(x)), r"^\.+", "") for x in (a, b))
    suffix = a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))
    return (a != "") & (b != "") & ((a == b) | suffix)


def sample_id(n_files: Column, n_lines: Column, language: Column, canonical_json: Column) -> Column:
    """r{files}_{lines}_{first four letters}_{six hash digits}."""
    return F.concat(
        F.lit("r"), n_files.cast("string"), F.lit("_"), n_lines.cast("string"), F.lit("_"),
        F.substring(language, 1, 4), F.lit("_"), F.substring(F.md5(canonical_json), 1, 6),
    )
