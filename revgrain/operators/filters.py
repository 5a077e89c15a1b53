"""Filters and evidence checks."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, functions as F

from revgrain.functions import questions, review, search
from revgrain.functions.patterns import UNICODE, any_of, last_part, literal, literal_col, python_strip
from revgrain.functions.text import symbols_equivalent


def changed_python(files: DataFrame) -> DataFrame:
    return files.where(review.is_changed_python("path", "change_type"))


def reviewable(files: DataFrame) -> DataFrame:
    return files.where(review.is_reviewable("path"))


def pathspec(path: Column | str, globs: list[str]) -> Column:
    """Any of the globs. As in git, ``*`` also crosses folder borders and a plain folder name covers its files."""
    path = F.col(path) if isinstance(path, str) else path
    tests = []
    for g in globs:
        if any(ch in g for ch in "*?["):
            tests.append(path.rlike("^" + fnmatch.translate(g).replace(r"\z", "$").replace(r"\Z", "$")))
        else:
            tests.append((path == g) | path.startswith(g.rstrip("/") + "/"))
    return any_of(tests)


def match_pathspec(files: DataFrame, globs: list[str]) -> DataFrame:
    return files.where(pathspec("path", globs)) if globs else files


def grep(lines: DataFrame, patterns: list[str]) -> DataFrame:
    """Non-blank lines that match any pattern in any case, with a trimmed snippet of at most 200 characters."""
    hits = lines.where(search.grep_match("line", patterns)).where(python_strip("line") != "")
    return hits.withColumn("snippet", search.snippet("line"))


def reference_pattern(term: Column, kind: Column) -> Column:
    """Pattern by which a term's references are found: decorator, literal text, call, or bare name."""
    name = literal_col(last_part(term))
    return (
        F.when(term.startswith("@"), F.concat(F.lit(UNICODE + "@"), literal_col(F.regexp_replace(term, "^@+", "")), F.lit(r"\b")))
        .when(kind == "literal", literal_col(term))
        .when(kind == "callers", F.concat(F.lit(UNICODE + r"\b"), name, F.lit(r"\s*\(")))
        .otherwise(F.concat(F.lit(UNICODE + r"\b"), name, F.lit(r"\b")))
    )


def reference_match(line: Column, term: str, kind: str) -> Column:
    """Same test for one term known in advance; the pattern is then a constant."""
    name = term.rsplit(".", 1)[-1]
    if term.startswith("@"):
        return line.rlike(UNICODE + "@" + literal(term.lstrip("@")) + r"\b")
    if kind == "literal":
        return line.contains(term)
    if kind == "callers":
        return line.contains(name) & line.rlike(UNICODE + r"\b" + literal(name) + r"\s*\(")
    return line.contains(name) & line.rlike(UNICODE + r"\b" + literal(name) + r"\b")


def valid_judgments(judgments: DataFrame) -> DataFrame:
    return judgments.where(F.col("judge_error_type").isNull())


def blank_summaries(samples: DataFrame, column: str = "summary") -> DataFrame:
    """Samples whose summary has to be written again."""
    return samples.where(python_strip(F.coalesce(F.col(column), F.lit(""))) == "")


def edge_cases(samples: DataFrame) -> DataFrame:
    return samples.where((F.col("files") == 0) | (F.col("files") > 50))


def _call(name: Column, text: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(UNICODE + r"\b"), literal_col(name), F.lit(r"\s*\(")))


def _own_def(name: Column, text: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(UNICODE + r"\bdef\s+"), literal_col(name), F.lit(r"\s*\(")))


def judge_evidence(evidence: DataFrame) -> DataFrame:
    """Adds ``ok`` and ``reason`` to evidence that carries its work order's target and counterpart."""
    name = last_part("target")
    snippet, symbol = F.coalesce("snippet", F.lit("")), F.trim(F.coalesce("symbol", F.lit("")))
    call = _call(name, snippet) & ~_own_def(name, snippet)
    counterpart = F.coalesce("counterpart", F.lit(""))
    reason = (
        F.when(snippet == "", "empty evidence")
        .when(F.coalesce("file", F.lit("")) == "", "no location")
        .when(F.col("source") == "resolve_symbol", F.lit(None))
        .when(F.col("source") == "verify_callsite", F.when(~call, F.concat(F.lit("no call expression for "), "target")))
        .when(
            F.col("source") == "verify_callees",
            F.when(symbol == "", "no callee symbol").when(
                (counterpart != "") & ~symbols_equivalent(symbol, counterpart),
                F.concat(F.lit("verified "), symbol, F.lit(", expected directed callee "), counterpart),
            ),
        )
    )
    return evidence.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def split_verified(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted evidence, and the rest with the reason why not."""
    judged = judge_evidence(evidence)
    return judged.where("ok").drop("ok", "reason"), judged.where("not ok").drop("ok")


def definition_verified(source: Column, snippet: Column, symbol: Column) -> Column:
    name = literal_col(F.lower(last_part(symbol)))
    found = F.regexp_like(F.lower(snippet), F.concat(F.lit(UNICODE + r"\b(?:class|def)\s+"), name, F.lit(r"\b")))
    return (source == "resolve_symbol") | (source.isin("read_window", "search_references") & found)


def implementation_verified(snippet: Column, symbol: Column, is_member: Column) -> Column:
    m = literal_col(last_part(symbol))
    declared = F.concat(F.lit(UNICODE + r"\b(?:async\s+def|def|class)\s+"), m, F.lit(r"\b"))
    member = F.concat(
        F.lit(UNICODE + r"\b(?:async\s+)?def\s+"), m, F.lit(r"\s*\(|\b(?:self|cls)\."), m,
        F.lit(r"\b|\b"), m, F.lit(r"\s*[:=]|\."), m, F.lit(r"\s*[:=]"),
    )
    return F.when(is_member, F.regexp_like(snippet, member)).otherwise(F.regexp_like(snippet, declared))


def caller_edge_verified(
    snippet: Column, symbol: Column, is_member: Column, same_place: Column
) -> Column:
    """A call of the symbol that is neither its own definition nor within two lines of it."""
    name = last_part(symbol)
    attribute = F.regexp_like(snippet, F.concat(F.lit(UNICODE + r"\."), literal_col(name), F.lit(r"\s*\(")))
    call = _call(name, snippet) | attribute
    return ~same_place & call & (is_member | ~_own_def(name, snippet))


def verify_slots(evidence: DataFrame, definitions: DataFrame) -> DataFrame:
    """Adds ``definition_ok``, ``implementation_ok``, ``caller_ok``, ``callee_ok``, ``reference_ok``.

    ``definitions`` has one row per symbol (symbol, def_file, def_line).
    """
    kind = questions.classify_target("symbol")["kind"]
    near = (F.col("file") == F.col("def_file")) & (F.abs(F.col("start_line") - F.col("def_line")) <= 2)
    near = F.coalesce(near, F.lit(False))
    snippet, symbol = F.coalesce("snippet", F.lit("")), F.col("symbol")
    member = kind == "member"
    return evidence.join(definitions, "symbol", "left").select(
        *evidence.columns,
        definition_verified(F.col("source"), snippet, symbol).alias("definition_ok"),
        implementation_verified(snippet, symbol, member).alias("implementation_ok"),
        caller_edge_verified(snippet, symbol, member, near).alias("caller_ok"),
        (F.trim(F.coalesce(symbol, F.lit(""))) != "").alias("callee_ok"),
        F.lit(True).alias("reference_ok"),
    )
