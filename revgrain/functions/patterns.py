"""Small building blocks shared by the column functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

# Python's regular expressions are Unicode-aware unless told otherwise; (?U) makes Java's so as well.
UNICODE = "(?U)"
_META = r"([\\.\[\]{}()*+?^$|#&~-])"
#: Every character that (?U)\s matches.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def lookup(c: Column | str, table: dict, default=None) -> Column:
    """Value of ``table`` for a key column; a CASE, so it stays in generated code."""
    c = col(c)
    out = None
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default))


def literal(text: str) -> str:
    return re.escape(text)


def literal_col(c: Column | str) -> Column:
    """Escape a column's text for use inside a pattern."""
    return F.regexp_replace(col(c), _META, r"\\$1")


def contains_any(c: Column, words: list[str]) -> Column:
    return any_of([c.contains(w) for w in words])


def ends_with_any(c: Column, suffixes: list[str]) -> Column:
    return any_of([c.endswith(s) for s in suffixes])


def last_part(c: Column | str, sep: str = ".") -> Column:
    return F.substring_index(col(c), sep, -1)


def strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def text_lines(c: Column | str) -> Column:
    """Lines of a text; a closing line break opens no further line, and an empty text has none."""
    c = F.coalesce(col(c), F.lit(""))
    whole = F.regexp_replace(c, f"(?:{LINE_BREAK})\\z", "")
    return F.when(c == "", strings([])).otherwise(F.split(whole, LINE_BREAK))


def python_strip(c: Column | str) -> Column:
    """Strip every whitespace character at both ends, not only blanks; only the ends of the text are looked at."""
    return F.btrim(col(c), F.lit(WHITE))
