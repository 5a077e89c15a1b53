"""Recovering JSON from model output and checking its shape."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from revgrain import fixed
from revgrain.functions.patterns import col, python_strip, strings

_FENCE_OPEN, _FENCE_CLOSE = r"^```(?:json)?\s*\n?", r"```\s*$"


_MARKS = np.isin(np.arange(256), np.frombuffer(b'{}"\\', dtype=np.uint8))


def _balanced(texts: pa.Array) -> list[str | None]:
    """First brace-balanced object of each text, null where there is none; braces inside strings do not count.

    All texts are scanned as one byte buffer. Only braces, quotes and backslashes are looked at: a mark behind an odd run of
    backslashes is escaped, one behind an odd number of quotes is inside a string, and depths are sums of the braces left.
    """
    texts = texts.cast(pa.large_string())
    null = texts.is_null().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    bounds = np.concatenate(([0], ends))
    data = np.frombuffer(b"".join(pc.fill_null(texts.cast(pa.large_binary()), b"").to_pylist()), dtype=np.uint8)
    at = np.flatnonzero(_MARKS[data])
    mark, k = data[at], np.arange(len(at))
    # The first opening brace of each text, by its number among the marks; none: len(at).
    opening = np.flatnonzero(mark == ord("{"))
    first = np.append(opening, len(at))[np.searchsorted(at[opening], bounds[:-1])]
    last = np.searchsorted(at, bounds[1:])
    behind = np.zeros(len(at), dtype=bool)
    behind[1:] = (mark[:-1] == ord("\\")) & (np.diff(at) == 1)
    escaped = (k - np.maximum.accumulate(np.where(behind, 0, k)) if len(k) else k) % 2 == 1
    escaped[first[first < last]] = False
    quotes = np.concatenate(([0], np.cumsum((mark == ord('"')) & ~escaped)))
    found: list[str | None] = [None] * len(texts)
    here = np.flatnonzero(~null & (first < last))
    if not len(here):
        return found
    # Marks ahead of a text's first brace belong to no object; the rest take the text they lie in.
    owner = np.repeat(here, last[here] - first[here])
    marks = np.concatenate([np.arange(a, b) for a, b in zip(first[here].tolist(), last[here].tolist())])
    outside = ~escaped[marks] & ((quotes[marks] - quotes[first[owner]]) % 2 == 0)
    step = np.where(outside, (mark[marks] == ord("{")).astype(np.int64) - (mark[marks] == ord("}")), 0)
    depth = np.cumsum(step)
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    depth -= np.repeat(depth[begin] - step[begin], np.diff(np.append(begin, len(owner))))
    closed = np.flatnonzero((step < 0) & (depth == 0))
    rows, nearest = np.unique(owner[closed], return_index=True)
    for row, c in zip(rows.tolist(), closed[nearest].tolist()):
        found[row] = data[at[first[row]]:at[marks[c]] + 1].tobytes().decode()
    return found


#: Texts of about so many bytes are scanned together.
_SCAN_BYTES = 1 << 22


@arrow_udf(StringType())
def balanced_object(texts: pa.Array) -> pa.Array:
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // _SCAN_BYTES)) + 1
    found: list[str | None] = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        found += _balanced(texts.slice(a, b - a))
    return pa.array(found, pa.string())


def strip_fence(text: Column | str) -> Column:
    t = python_strip(text)
    return python_strip(F.regexp_replace(F.regexp_replace(t, _FENCE_OPEN, ""), _FENCE_CLOSE, ""))


def _readable(text: Column) -> Column:
    """The text if it is one JSON value and nothing else. The parser stops behind a first value, so the text is put between
    brackets, which must hold that value alone, and between braces, since the text itself might close the brackets."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    single = F.try_variant_get(alone, "$[0]", "variant").isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull()
    return F.when(single & held.isNotNull(), text)


def recover_json(raw: Column | str) -> Column:
    """JSON text inside a model's answer: the answer itself, without its code fence, or its first balanced object.

    The scan for balanced braces runs in Python, and only for texts the first two steps cannot read; a second time where
    a code fence is taken off.
    """
    text = python_strip(raw)
    direct = F.coalesce(_readable(text), _readable(strip_fence(text)))
    rest, bare = F.when(direct.isNull(), text), strip_fence(text)
    fenced = F.when(direct.isNull() & (bare != text), bare)
    return F.coalesce(direct, _readable(balanced_object(rest)), _readable(balanced_object(fenced)))


def rescued_objects(raw: Column | str) -> Column:
    """Single flat objects that hold both texts of a batch answer, as an array of JSON texts."""
    pattern = r'(?s)\{[^{}]*"change_summary"[^{}]*"ast_summary"[^{}]*\}'
    return F.filter(F.regexp_extract_all(col(raw), F.lit(pattern), F.lit(0)), lambda o: F.try_parse_json(o).isNotNull())


# --- shape checks ---------------------------------------------------------------------------------


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _kind(v: Column) -> Column:
    """string, integer, number, boolean, array, object or null; SQL null if the field is missing."""
    return _once(F.schema_of_variant(v), lambda s: (
        F.when(s == "STRING", "string").when(s == "BIGINT", "integer").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
        .when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(s.isNotNull(), "number")
    ))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` refers to it; nothing else shares work inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parsed(json_text: Column | str, check) -> Column:
    """``check`` of the parsed text. The lambda variable stands for one parse, however often the check refers to it."""
    return F.get(F.transform(F.array(F.try_parse_json(col(json_text))), check), F.lit(0))


_PYTHON_NAME = {"string": "str", "integer": "int", "number": "float", "boolean": "bool", "null": "NoneType", "array": "list", "object": "dict"}
_JUDGMENT_FIELDS = {
    "verdict": "string", "score": "integer", "answered_question": "boolean", "uses_supported_evidence": "boolean",
    "expected_file_coverage": "string", "reason": "string", "missing_points": "array",
}
_ENUMS = {"verdict": fixed.VERDICTS, "expected_file_coverage": fixed.COVERAGE_LEVELS}


def _name(kind: Column) -> Column:
    out = None
    for k, v in _PYTHON_NAME.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def schema_errors(json_text: Column | str) -> Column:
    """Faults of a judgment: missing fields alone, else wrong types, values out of range and extra fields."""
    keys = F.coalesce(F.json_object_keys(col(json_text)), strings([]))
    extra = F.transform(F.array_except(keys, strings(list(_JUDGMENT_FIELDS))), lambda k: F.concat(F.lit("不允许的额外字段: '"), k, F.lit("'")))
    return _parsed(json_text, lambda v: _judgment_faults(v, extra))


def _judgment_faults(v: Column, extra: Column) -> Column:
    missing = F.array_compact(F.array(*[F.when(_get(v, f).isNull(), F.lit(f"缺少必需字段: {f}")) for f in _JUDGMENT_FIELDS]))
    faults = [_field_faults(v, f, want) for f, want in _JUDGMENT_FIELDS.items()]
    return F.when(F.size(missing) > 0, missing).otherwise(F.concat(F.array_compact(F.concat(*faults)), extra))


def _field_faults(v: Column, f: str, want: str) -> Column:
    return _once(_kind(_get(v, f)), lambda got: F.array(*_kind_faults(v, f, want, got)))


def _kind_faults(v: Column, f: str, want: str, got: Column) -> list[Column]:
    fits = (got == want) | ((got == "boolean") if want == "integer" else F.lit(False))
    message = F.concat(F.lit(f"{f}: 期望 {want}，实际 "), _name(got))
    if want == "boolean":
        shown = F.when(got == "string", F.concat(F.lit("'"), F.try_variant_get(v, f"$.{f}", "string"), F.lit("'"))).otherwise(F.try_variant_get(v, f"$.{f}", "string"))
        message = F.concat(message, F.lit("（当前值: "), F.substring(F.coalesce(shown, F.lit("None")), 1, 80), F.lit("）"))
    found = [F.when(~fits, message)]
    if f in _ENUMS:
        value = F.try_variant_get(v, f"$.{f}", "string")
        found.append(F.when((got == "string") & ~value.isin(_ENUMS[f]), F.concat(F.lit(f"{f}: '"), value, F.lit(f"' 不在合法值 {_ENUMS[f]} 中"))))
    if want == "integer":
        number = F.try_variant_get(v, f"$.{f}", "double")
        numeric = got.isin("integer", "number")
        text = F.try_variant_get(v, f"$.{f}", "string")
        found.append(F.when(numeric & (number < 0), F.concat(F.lit(f"{f}: "), text, F.lit(" < 最小值 0"))))
        found.append(F.when(numeric & (number > 2), F.concat(F.lit(f"{f}: "), text, F.lit(" > 最大值 2"))))
    return found


def _elements(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))


def _string(v: Column, path: str) -> Column:
    return F.when(_kind(_get(v, path)) == "string", F.try_variant_get(v, f"$.{path}", "string"))


def _each(v: Column, path: str, faults) -> Column:
    """Faults of every element of an array; ``faults(element, index_text)`` gives an array of nullable texts."""
    def one(x: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))
        return F.when(_kind(x) != "object", F.array(F.concat(at, F.lit(" is not an object")))).otherwise(F.array_compact(faults(x, at)))

    return F.flatten(F.transform(_elements(v, path), one))


def _not_in(value: Column, at: Column | str, name: str, allowed: list[str], missing: str = "") -> Column:
    at = F.lit(at) if isinstance(at, str) else at
    shown = F.coalesce(value, F.lit(missing))
    return F.when(~shown.isin(allowed), F.concat(at, F.lit(f"{name}='"), shown, F.lit(f"' not in {sorted(allowed)}")))


def _blank(s: Column) -> Column:
    return F.trim(F.coalesce(s, F.lit(""))) == ""


def planner_output_errors(json_text: Column | str) -> Column:
    """Faults of a planned question: type, relations with subjects, single targets, claims."""
    return _parsed(json_text, _planner_faults)


def _planner_faults(v: Column) -> Column:
    types = ["locate", "explain", "trace", "compare", "impact", "grep"]
    relation_kind, target_kind = _kind(_get(v, "relations")), _kind(_get(v, "standalone_targets"))
    empty = (F.size(_elements(v, "relations")) == 0) & (F.size(_elements(v, "standalone_targets")) == 0)
    head = F.array_compact(F.array(
        _not_in(_string(v, "question_type"), "", "question_type", types),
        F.when(F.coalesce(relation_kind, F.lit("array")) != "array", "relations must be array"),
        F.when(F.coalesce(target_kind, F.lit("array")) != "array", "standalone_targets must be array"),
        F.when(empty, "at least one relation or standalone_target is required"),
    ))

    def relation(x: Column, at: Column) -> Column:
        kind, subjects = F.coalesce(_string(x, "type"), F.lit("")), _elements(x, "subjects")
        known = kind.isin(list(fixed.RELATION_SLOTS))
        bad = F.exists(subjects, lambda s: (_kind(s) != "string") | _blank(F.try_variant_get(s, "$", "string")))
        return F.array(
            F.when(~known, F.concat(at, F.lit(".type='"), kind, F.lit("' not a valid RelationType"))),
            F.when(F.size(subjects) == 0, F.concat(at, F.lit(".subjects must be non-empty array"))),
            F.when(bad, F.concat(at, F.lit(".subjects must hold non-empty strings"))),
        )

    def target(x: Column, at: Column) -> Column:
        return F.array(F.when(_blank(_string(x, "symbol")), F.concat(at, F.lit(".symbol must be non-empty string"))))

    claims = _get(v, "required_claims")
    claim_kind = _kind(claims)
    bad_claim = F.exists(_elements(v, "required_claims"), lambda s: (_kind(s) != "string") | _blank(F.try_variant_get(s, "$", "string")))
    tail = F.array_compact(F.array(
        F.when(~F.coalesce(claim_kind, F.lit("null")).isin("null", "array"), "required_claims must be array"),
        F.when(F.coalesce(bad_claim, F.lit(False)), "required_claims must hold non-empty strings"),
    ))
    checked = F.concat(head, _each(v, "relations", relation), _each(v, "standalone_targets", target), tail)
    return F.when(F.coalesce(_kind(v), F.lit("null")) != "object", strings(["output is not a dict"])).otherwise(checked)


_IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_.]*$"
_SEARCH_KINDS = ["definition", "references", "literal", "callers"]
_NEEDS = ["method_body", "caller_edge", "dependency_relation", "literal_usage", "implementation", "definition"]
_ACTION_TOOLS = ["resolve_symbol", "read_window", "search_references", "dependency"]
_ORDER_TOOLS = ["resolve_symbol", "read_window", "search_references", "dependency", "search", "search_filename", "python_ast", "git", "knowledge", ""]


def _identifier(s: Column) -> Column:
    return F.coalesce(s, F.lit("")).rlike(_IDENTIFIER)


def _required(v: Column, names: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(_get(v, n).isNull(), F.lit(f"missing required key: {n}")) for n in names]))


def sufficiency_errors(json_text: Column | str) -> Column:
    """Faults of a sufficiency verdict: its flag, reason, missing requirements and suggested actions."""
    return _parsed(json_text, _sufficiency_faults)


def _sufficiency_faults(v: Column) -> Column:
    missing = _required(v, ["sufficient", "missing_requirements", "suggested_actions", "reason"])

    def typed(name: str, want: str, word: str, optional: bool = False) -> Column:
        kind = _kind(_get(v, name))
        return F.when((kind != want) if not optional else (F.coalesce(kind, F.lit(want)) != want), f"{name} must be {word}")

    head = F.array_compact(F.array(
        typed("replan_requested", "boolean", "boolean", True), typed("replan_rationale", "string", "string", True),
        typed("sufficient", "boolean", "boolean"), typed("reason", "string", "string"),
        typed("missing_requirements", "array", "array"), typed("suggested_actions", "array", "array"),
    ))

    def need(x: Column, at: Column) -> Column:
        symbol = _string(x, "symbol")
        return F.array(
            _not_in(_string(x, "type"), at, ".type", _NEEDS),
            F.when(~_identifier(symbol), F.concat(at, F.lit(".symbol='"), F.coalesce(symbol, F.lit("")), F.lit("' is not a valid code identifier"))),
        )

    def action(x: Column, at: Column) -> Column:
        symbol, kind = _string(x, "symbol"), F.coalesce(_string(x, "search_kind"), F.lit(""))
        line = _kind(_get(x, "line"))
        bad_line = (F.coalesce(line, F.lit("integer")) != "integer") | (F.coalesce(F.try_variant_get(x, "$.line", "bigint"), F.lit(0)) < 0)
        hint = _kind(_get(x, "file_hint"))
        return F.array(
            _not_in(_string(x, "tool"), at, ".tool", _ACTION_TOOLS),
            F.when(~_identifier(symbol), F.concat(at, F.lit(".symbol='"), F.coalesce(symbol, F.lit("")), F.lit("' is not a valid code identifier"))),
            _not_in(_string(x, "search_kind"), at, ".search_kind", _SEARCH_KINDS),
            F.when((kind != "literal") & ~_identifier(symbol), F.concat(at, F.lit(": non-literal search requires valid code identifier symbol"))),
            F.when(bad_line, F.concat(at, F.lit(".line must be non-negative integer"))),
            F.when(~F.coalesce(hint, F.lit("null")).isin("null", "string"), F.concat(at, F.lit(".file_hint must be string or null"))),
        )

    checked = F.concat(head, _each(v, "missing_requirements", need), _each(v, "suggested_actions", action))
    return (
        F.when(F.coalesce(_kind(v), F.lit("null")) != "object", strings(["output is not a dict"]))
        .when(F.size(missing) > 0, missing).otherwise(checked)
    )


def state_decision_errors(json_text: Column | str) -> Column:
    """Faults of a step decision: its action and the work orders that go with it."""
    return _parsed(json_text, _decision_faults)


def _decision_faults(v: Column) -> Column:
    missing = _required(v, ["action", "reason", "work_orders"])
    action = F.coalesce(_string(v, "action"), F.lit(""))
    is_list = _kind(_get(v, "work_orders")) == "array"
    count = F.size(_elements(v, "work_orders"))
    head = F.array_compact(F.array(
        F.when(~action.isin("continue", "answer"), F.concat(F.lit("action must be 'continue' or 'answer', got '"), action, F.lit("'"))),
        F.when((action == "answer") & is_list & (count > 0), "work_orders must be empty when action=answer"),
        F.when((action != "answer") & (~is_list | (count == 0)), "work_orders must be non-empty when action=continue"),
    ))

    def order(x: Column, at: Column) -> Column:
        target, kind = _string(x, "target"), F.coalesce(_string(x, "search_kind"), F.lit("definition"))
        return F.array(
            F.when(_blank(target), F.concat(at, F.lit(".target is empty"))),
            _not_in(_string(x, "tool_hint"), at, ".tool_hint", _ORDER_TOOLS),
            _not_in(kind, at, ".search_kind", _SEARCH_KINDS),
            F.when((kind != "literal") & ~_identifier(target), F.concat(at, F.lit(".target='"), F.coalesce(target, F.lit("")), F.lit("' is not a valid code identifier"))),
        )

    return (
        F.when(F.coalesce(_kind(v), F.lit("null")) != "object", strings(["output is not a dict"]))
        .when(F.size(missing) > 0, missing).otherwise(F.concat(head, _each(v, "work_orders", order)))
    )


def any_error(errors: Column) -> Column:
    return F.size(errors) > 0


