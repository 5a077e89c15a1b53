"""The scan for balanced objects against a walk over the characters."""

import random

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from revgrain.functions import judging


def walk(text):
    if text is None or "{" not in text:
        return None
    start, depth, quoted, skip = text.index("{"), 0, False, False
    for i, ch in enumerate(text[start:], start):
        if skip:
            skip = False
        elif ch == "\\":
            skip = True
        elif ch == '"':
            quoted = not quoted
        elif ch in "{}" and not quoted:
            depth += 1 if ch == "{" else -1
            if not depth:
                return text[start:i + 1]
    return None


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet='{}"\\aé\U0001f642 ', max_size=30)), max_size=8))
def test_scan_equals_the_walk(texts):
    assert judging._balanced(pa.array(texts, pa.string())) == [walk(t) for t in texts]


def test_slices_and_long_texts():
    draw = random.Random(5)
    texts = ["".join(draw.choices('{}"\\a', k=draw.randint(0, 40))) for _ in range(3_000)] + ["x" * 100_000 + '{"a": "}"} }', None, ""]
    array = pa.array(texts, pa.string())
    assert judging._balanced(array.slice(7)) == [walk(t) for t in texts[7:]]


def test_recovery_with_and_without_a_fence(spark):
    raw = ['say {"a": 1} now', '```json\n{"a": {"b": "}"}} tail\n```', "none", None, "", '{"open": 1', 'x {bad} {"a": 1}', '{"a": 1}]', '{"a": 1}} x', '{"a": 1}, {"b": 2}', '[1, 2]', "null"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    got = {r.i: r.j for r in df.select("i", judging.recover_json("raw").alias("j")).collect()}
    assert got == {0: '{"a": 1}', 1: '{"a": {"b": "}"}}', 2: None, 3: None, 4: None, 5: None, 6: None, 7: '{"a": 1}', 8: '{"a": 1}', 9: '{"a": 1}', 10: "[1, 2]", 11: "null"}
