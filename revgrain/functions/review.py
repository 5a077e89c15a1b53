"""Review functions: risk signals, severities, change evidence, validity checks, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from revgrain import fixed
from revgrain.functions.patterns import col, contains_any, ends_with_any, lookup
from revgrain.functions.paths import base_name


def is_changed_python(path: Column | str, change_type: Column | str) -> Column:
    return col(path).endswith(".py") & (F.coalesce(col(change_type), F.lit("")) != "deleted")


def is_reviewable(path: Column | str) -> Column:
    path = col(path)
    return ends_with_any(path, fixed.REVIEW_SUFFIXES) & ~base_name(path).isin(fixed.LOCK_FILES)


def content_signals(path: Column | str, content: Column | str) -> Column:
    """Signals of one changed Python file: families in its text, manifest names in its path."""
    low, name = F.lower(F.coalesce(col(content), F.lit(""))), F.lower(col(path))
    found = []
    for signal, words in sorted(fixed.RISK_KEYWORDS.items()):
        test = contains_any(low, words)
        if signal == "dependency_change":
            test = test | contains_any(name, words)
        found.append(F.when(test, F.lit(signal)))
    return F.array_compact(F.array(*found))


def path_signals(path: Column | str) -> Column:
    """Signals the path alone gives."""
    name = F.lower(col(path))
    found = [F.when(contains_any(name, words), F.lit(s)) for s, words in sorted(fixed.RISK_KEYWORDS.items())]
    return F.array_compact(F.array(*found))


def risk_level(signal_count: Column) -> Column:
    return F.when(signal_count >= 3, "high").when(signal_count >= 1, "medium").otherwise("low")


def severity_rank(severity: Column | str, unknown: int = -1) -> Column:
    return lookup(severity, fixed.SEVERITY_RANK, unknown)


def severity_name(rank: Column) -> Column:
    return lookup(rank, {v: k for k, v in fixed.SEVERITY_RANK.items()}, "info")


def bandit_severity(level: Column | str) -> Column:
    return lookup(level, fixed.BANDIT_SEVERITY, "info")


def bandit_rule(test_id: Column | str) -> Column:
    """Rule id with one leading B, whether or not the report already has it."""
    t = F.coalesce(col(test_id), F.lit("???"))
    return F.when(t.startswith("B"), t).otherwise(F.concat(F.lit("B"), t))


def downgrade_low_confidence(severity: Column | str, confidence: Column | str) -> Column:
    return F.when(F.coalesce(col(confidence), F.lit(0.5)) < 0.6, "info").otherwise(col(severity))


def change_snippet(change_type: Column, path: Column, added: Column, deleted: Column) -> Column:
    return F.format_string("%s: %s (+%d/-%d)", change_type, path, added, deleted)


def status_label(status: Column | str) -> Column:
    return F.when(col(status) == "success", "OK").when(col(status).contains("skipped"), "SKIP").otherwise("FAIL")


def latency_label(duration_ms: Column | str) -> Column:
    d = col(duration_ms)
    return F.when(d != 0, F.format_string("%.1fs", F.bround(d / 1000, 1))).otherwise("-")


def valid_conversation(messages: Column | str) -> Column:
    """At most 200 messages of known roles, none over 16,000 characters."""
    m = col(messages)
    return (F.size(m) <= 200) & F.forall(
        m, lambda x: F.coalesce(x["role"].isin("user", "agent"), F.lit(False)) & (F.length(x["text"]) <= 16000)
    )


def first_finding_error(item: Column, unknown_id: Column) -> Column:
    """First fault of a model finding (struct with location, reason, suggestion), or null if it holds.

    ``unknown_id`` is an evidence id the finding names but that does not exist, or null.
    """

    def blank(name: str) -> Column:
        return F.coalesce(item[name], F.lit("")) == ""

    fault = F.when(item.isNull(), "not a dict")
    for name in ("location", "reason", "suggestion"):
        fault = fault.when(blank(name), f"missing field '{name}'")
    return fault.when(unknown_id.isNotNull(), F.concat(F.lit("evidence_id '"), unknown_id, F.lit("' not found in pool")))
