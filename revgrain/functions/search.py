"""Scoring of search hits: what kind of line it is and how well it matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from revgrain import fixed
from revgrain.functions.patterns import UNICODE, any_of, col, literal, literal_col, lookup, python_strip

_DEFINED = (
    UNICODE + r"(?:(?:class|def|async\s+def)\s+|\bfn\s+|\bfunc\s+(?:\s*\([^)]*\)\s+)?|\bfunction\s+"
    r"|\b(?:public|private|protected)?\s*(?:static\s+)?(?:class|interface|enum)\s+)(\w+)"
)


_DEFINING_WORDS = ["class", "def", "fn", "func", "interface", "enum"]


def distinct_keywords(keywords: list[str] | str) -> list[str]:
    words = [keywords] if isinstance(keywords, str) else keywords
    return list(dict.fromkeys(str(w) for w in words if w))


def snippet(text: Column | str) -> Column:
    return F.substring(python_strip(text), 1, 200)


def mentions(text: Column | str, keywords: list[str]) -> Column:
    """Any keyword occurs, in any case."""
    low = F.lower(col(text))
    return any_of([low.contains(k.lower()) for k in keywords])


def grep_match(text: Column | str, patterns: list[str]) -> Column:
    """Patterns are regular expressions, matched in any case; plain words take the substring test."""
    text = col(text)
    tests = []
    for p in patterns:
        plain = all(ch.isalnum() or ch in "_ " for ch in p)
        tests.append(F.lower(text).contains(p.lower()) if plain else text.rlike("(?iu)" + p))
    return any_of(tests)


def defined_name(text: Column | str) -> Column:
    """Name that a stripped line defines; the costly pattern only runs on lines with one of its words."""
    text = col(text)
    candidate = any_of([text.contains(w) for w in _DEFINING_WORDS])
    return F.nullif(F.when(candidate, F.regexp_extract(text, _DEFINED, 1)), F.lit(""))


def match_precision(text: Column | str, keywords: list[str]) -> Column:
    """Best of exact word, any-case word and substring over all keywords."""
    text = col(text)
    scores = [F.lit(0)]
    for k in keywords:
        word = rf"\b{literal(k)}\b"
        scores.append(
            F.when(~F.lower(text).contains(k.lower()), 0)
            .when(text.rlike(UNICODE + word), fixed.PRECISION_EXACT)
            .when(text.rlike("(?iuU)" + word), fixed.PRECISION_ANY_CASE)
            .otherwise(fixed.PRECISION_SUBSTRING)
        )
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def word_precision(text: Column | str, word: Column) -> Column:
    """The same for one word that is a column."""
    text, edge = col(text), F.lit(r"\b")
    pattern = F.concat(edge, literal_col(word), edge)
    return (
        F.when(~F.lower(text).contains(F.lower(word)), 0)
        .when(text.contains(word) & F.rlike(text, F.concat(F.lit(UNICODE), pattern)), fixed.PRECISION_EXACT)
        .when(F.rlike(text, F.concat(F.lit("(?iuU)"), pattern)), fixed.PRECISION_ANY_CASE)
        .otherwise(fixed.PRECISION_SUBSTRING)
    )


def coverage_score(matched: Column) -> Column:
    return matched * fixed.COVERAGE_PER_KEYWORD


def query_coverage(text: Column | str, keywords: list[str]) -> Column:
    low = F.lower(col(text))
    hits = [F.when(low.contains(k.lower()), 1).otherwise(0) for k in keywords]
    return coverage_score(reduce(lambda a, b: a + b, hits, F.lit(0)))


def matched_terms(text: Column | str, keywords: list[str]) -> Column:
    low = F.lower(col(text))
    return F.array_compact(F.array(*[F.when(low.contains(k.lower()), F.lit(k)) for k in keywords]))


def classify_hit(text: Column | str, keywords: list[str], parsed_kind: Column | None = None) -> Column:
    """Kind of a stripped line, given the words that it is a hit of."""
    return hit_kind(text, F.lower(defined_name(text)).isin([k.lower() for k in keywords]), parsed_kind)


def hit_kind(text: Column | str, defines: Column, parsed_kind: Column | None = None) -> Column:
    """Kind of a stripped line: comment, then what a parser says, then definition / import / call / reference."""
    line = col(text)
    kind = F.when(line.startswith("#") | line.startswith("//") | line.startswith("--"), "comment")
    if parsed_kind is not None:
        kind = kind.when(parsed_kind.isNotNull(), parsed_kind)
    return (
        kind.when(defines, "definition")
        .when(line.startswith("import ") | line.startswith("from "), "import")
        .when(line.contains("("), "call")
        .otherwise("reference")
    )


def hit_type_score(hit_type: Column | str) -> Column:
    return lookup(hit_type, fixed.HIT_TYPE_SCORES, 100)


def hit_confidence(hit_type: Column | str) -> Column:
    return lookup(hit_type, fixed.HIT_CONFIDENCE, 0.80)
