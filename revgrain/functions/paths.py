"""Path functions: file class and score, base names, exclusions, safety."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from revgrain import fixed
from revgrain.functions.patterns import any_of, col, contains_any, ends_with_any, lookup, strings


def norm_path(path: Column | str) -> Column:
    return F.translate(col(path), "\\", "/")


def base_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def stem(path: Column | str) -> Column:
    """Base name without its last extension; leading dots belong to the name."""
    name = base_name(path)
    cut = F.regexp_extract(name, r"^(\.*[^.].*)\.[^.]*$", 1)
    return F.when(cut == "", name).otherwise(cut)


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def segments(path: Column | str) -> Column:
    return F.split(col(path), "/")


def in_dirs(path: Column | str, dirs: list[str]) -> Column:
    """A path segment equals one of ``dirs``."""
    return F.arrays_overlap(segments(path), strings(dirs))


def hidden(path: Column | str) -> Column:
    return F.exists(segments(path), lambda s: s.startswith(".") | (s == "__pycache__"))


def classify_file(path: Column | str) -> Column:
    """documentation, test, example, build, config, source or other; the first rule that holds wins."""
    path = norm_path(path)
    lowered = F.lower(path)
    name, stem_ = base_name(lowered), stem(lowered)
    return (
        F.when(in_dirs(lowered, fixed.DOC_DIRS), "documentation")
        .when(contains_any(stem_, fixed.DOC_STEMS) | ends_with_any(name, fixed.DOC_EXTENSIONS), "documentation")
        .when(in_dirs(lowered, fixed.TEST_DIRS), "test")
        .when(
            any_of([stem_.startswith(p) for p in fixed.TEST_PREFIXES])
            | ends_with_any(stem_, fixed.TEST_SUFFIXES)
            | (stem_ == "conftest"),
            "test",
        )
        .when(in_dirs(lowered, fixed.EXAMPLE_DIRS), "example")
        .when(stem_.isin(fixed.BUILD_NAMES), "build")
        .when(ends_with_any(name, fixed.CONFIG_EXTENSIONS), "config")
        .when(extension(lowered).isin(fixed.SOURCE_EXTENSIONS), "source")
        .otherwise("other")
    )


def file_type_score(file_type: Column | str) -> Column:
    return lookup(file_type, fixed.FILE_TYPE_SCORES, 10)


def manifest_changed(path: Column | str) -> Column:
    return base_name(path).isin(fixed.MANIFESTS)


def safe_path(path: Column | str) -> Column:
    """Given, relative, and without a parent reference."""
    p = norm_path(path)
    return (p != "") & ~p.startswith("/") & ~F.array_contains(segments(p), "..")


def module_name(path: Column | str, roots: tuple[str, ...] = ("src/", "lib/", "python/")) -> Column:
    """Dotted module name of a Python file, with a leading source root removed."""
    p = F.regexp_replace(norm_path(path), "^(" + "|".join(roots) + ")", "")
    return F.translate(F.regexp_replace(p, r"(/__init__)?\.py$", ""), "/", ".")
