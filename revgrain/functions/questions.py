"""Question functions: type, requirements, target words, target kind, slots, stop reason."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from revgrain import fixed
from revgrain.functions.patterns import UNICODE, any_of, col, last_part, lookup, strings

_FLAGS = "(?dU)"
_TIERS = [
    (r"""["']([^"']+)["']""", 1),
    (r"\b([A-Z][a-zA-Z0-9_]*\.[a-z_][a-zA-Z0-9_]*)\b", 1),
    (r"\b([A-Z][a-zA-Z0-9_]*|[a-z]+_[a-z_]+|[a-z][a-z0-9_]{2,})\b", 1),
    (r"[a-zA-Z_][a-zA-Z0-9_]{2,}", 0),
]


def question_type(question: Column | str) -> Column:
    low = F.lower(col(question))
    out = None
    for name, pattern in fixed.QUESTION_TYPE_PATTERNS:
        test = low.rlike(_FLAGS + pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("locate")


def requirements(question: Column | str) -> Column:
    low = F.lower(col(question))
    found = F.array_compact(
        F.array(*[
            F.when(low.rlike(_FLAGS + pattern), F.lit(name))
            for names, pattern in fixed.REQUIREMENT_PATTERNS
            for name in names
        ])
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("LOCATE_SYMBOL")))


def relation_type(question: Column | str) -> Column:
    return lookup(F.get(requirements(question), 0), fixed.REQUIREMENT_RELATION, "definition_location")


def fallback_type(question: Column | str) -> Column:
    """Type by the first requirement; it differs from ``question_type`` where that requirement has no type."""
    return lookup(F.get(requirements(question), 0), fixed.REQUIREMENT_TYPE, "locate")


def _target_word(raw: Column) -> Column:
    word = F.regexp_replace(F.trim(raw), r"""^[`'"()\[\]{} ]+|[`'"()\[\]{} ]+$""", "")
    sep = F.when(word.contains("::"), "::").when(word.contains("."), ".")
    owner = F.trim(
        F.when(sep == "::", F.regexp_extract(word, r"^(.*)::", 1))
        .when(sep == ".", F.regexp_extract(word, r"^(.*)\.", 1))
        .otherwise("")
    )
    member = F.trim(
        F.when(sep == "::", last_part(word, "::")).when(sep == ".", last_part(word, ".")).otherwise(word)
    )
    known = ~F.lower(member).isin(fixed.KEYWORD_STOP_WORDS + fixed.GENERIC_TERMS)
    first = F.substring(member, 1, 1)
    return F.when(
        member.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & known,
        F.struct(
            F.when((owner != "") | word.contains("."), word).otherwise(member).alias("symbol"),
            F.when(owner != "", owner).otherwise(member).alias("owner"),
            member.alias("member"),
            F.when(first.rlike("[A-Z]"), "class").when(member.contains("_"), "variable").otherwise("method").alias("kind"),
        ),
    )


def question_keywords(question: Column | str) -> Column:
    """First three target words of the first tier (quoted, Class.method, identifiers, words) that yields any."""
    q = col(question)
    tiers = []
    for pattern, group in _TIERS:
        words = F.regexp_extract_all(q, F.lit(UNICODE + pattern), F.lit(group))
        kept = F.slice(F.array_distinct(F.array_compact(F.transform(words, _target_word))), 1, 3)
        tiers.append(kept)
    out = F.when(F.size(tiers[0]) > 0, tiers[0])
    for tier in tiers[1:-1]:
        out = out.when(F.size(tier) > 0, tier)
    return out.otherwise(tiers[-1])


def classify_target(raw: Column | str) -> Column:
    """struct<kind, owner, member>; owner holds the symbol itself for everything but members."""
    s = F.trim(col(raw))
    bare = F.regexp_replace(s, ":+$", "")
    member = last_part(s)
    owner = F.regexp_extract(s, r"^(.*)\.", 1)
    module = s.isin(fixed.KNOWN_MODULES) | any_of([s.startswith(m + ".") for m in fixed.KNOWN_MODULES])
    class_like = r"(?U)^_*[A-Z]\w*$"

    def of(kind: str, first: Column, second: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), first.alias("owner"), (F.lit("") if second is None else second).alias("member")
        )

    return (
        F.when(s == "", of("text_pattern", s))
        .when(s.startswith("@"), of("decorator", F.regexp_replace(s, "^@+", "")))
        .when(bare.isin(fixed.SYNTAX_WORDS), of("syntax_pattern", bare))
        .when(module, of("module", s))
        .when(s.contains(".") & member.rlike(class_like), of("symbol", s))
        .when(s.contains("."), of("member", owner, member))
        .when(s.rlike(class_like) | s.rlike(r"(?U)^[a-z_]\w*$"), of("symbol", s))
        .otherwise(of("text_pattern", s))
    )


def scope_for(kind: Column | str) -> Column:
    k = col(kind)

    def limits(files: int, per_file: int, total: int) -> Column:
        return F.struct(
            F.lit(files).alias("max_files"), F.lit(per_file).alias("max_hits_per_file"),
            F.lit(total).alias("max_total"),
        )

    return (
        F.when(k.isin("symbol", "member"), limits(20, 3, 50))
        .when(k == "module", limits(30, 2, 60))
        .otherwise(limits(15, 2, 30))
    )


def expand_relation(relation: Column | str) -> Column:
    c = col(relation)
    out = None
    for name, slots in fixed.RELATION_SLOTS.items():
        out = F.when(c == name, strings(slots)) if out is None else out.when(c == name, strings(slots))
    return out.otherwise(strings(["definition"]))


def slot_tool(slot: Column | str) -> Column:
    return lookup(slot, {k: v[0] for k, v in fixed.SLOT_TOOL.items()}, "resolve_symbol")


def slot_search_kind(slot: Column | str) -> Column:
    return lookup(slot, {k: v[1] for k, v in fixed.SLOT_TOOL.items()}, "definition")


def source_slot(source: Column | str) -> Column:
    return lookup(source, fixed.SOURCE_SLOT)


def is_structural(question: Column | str) -> Column:
    low = F.lower(col(question))
    return any_of([low.contains(w) for w in fixed.STRUCTURE_WORDS])


def stop_reason(met: Column, retool_used: Column, steps_used: Column, max_steps: Column, pending: Column) -> Column:
    return (
        F.when(met & retool_used, "COMPLETE_AFTER_RETOOL")
        .when(met, "COMPLETE")
        .when(steps_used >= max_steps, "STOP_MAIN_BUDGET")
        .when(pending <= 0, "STOP_NO_PENDING")
        .otherwise("PARTIAL")
    )


def task_status(verified: Column, attempts: Column) -> Column:
    return F.when(verified > 0, "verified").when(attempts > 0, "no_evidence").otherwise("failed")
