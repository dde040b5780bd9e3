"""Filter (F0-F9): keep items whose field text satisfies an operator.

The field is a dotted path; its value is compared as canonical text
(``<nil>`` when missing). Non-object items are always dropped. An empty
field or operator passes everything through; an unknown operator keeps
every object. A bad regex matches nothing (no error).

Where the column type allows, the predicate is written so that Parquet
pushdown still works: ``equals`` on a string column is ``col = v``, and on
a numeric column it becomes a numeric equality (the shortest text of a
double identifies it uniquely), so the scan filters row groups.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..feed import Feed
from ..functions.regex import RegexError, compile_re2
from ..functions.values import (INTEGRAL_TYPES, NIL_TEXT, canonical_text, resolve_path, simple_lower,
                                simple_lower_text)

_INT_TEXT = re.compile(r"-?(0|[1-9][0-9]*)")


def _go_float_text(x: float) -> str:
    """Python mirror of the column expression (used to test a literal)."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "+Inf" if x > 0 else "-Inf"
    r = repr(x)
    mant, _, exp = r.partition("e")
    sign = "-" if mant.startswith("-") else ""
    mant = mant.lstrip("-")
    ip, _, fp = mant.partition(".")
    raw = ip + fp
    stripped = raw.lstrip("0")
    digits = stripped.rstrip("0")
    if not digits:
        return sign + "0"
    dp = len(ip) - (len(raw) - len(stripped)) + (int(exp) if exp else 0)
    e10 = dp - 1
    if e10 < -4 or e10 >= 6:
        m = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
        return f"{sign}{m}e{'-' if e10 < 0 else '+'}{abs(e10):02d}"
    if dp <= 0:
        return sign + "0." + "0" * (-dp) + digits
    if dp >= len(digits):
        return sign + digits + "0" * (dp - len(digits))
    return sign + digits[:dp] + "." + digits[dp:]


def _equals(x: Column, dtype: T.DataType, value: str, negate: bool = False) -> Column:
    """``canonical_text(x) == value`` (or ``!=``) as a NULL-free predicate.

    Written as plain comparisons plus ``IS NULL`` so that Parquet pushdown
    applies: a NULL ``x`` prints ``<nil>``, so it equals only ``<nil>``.
    """
    def eq(lit_value):
        return (x.isNull() | (x != lit_value)) if negate else (x == lit_value)

    def is_nil():
        return x.isNotNull() if negate else x.isNull()

    def never():
        return F.lit(negate)

    if isinstance(dtype, T.NullType):
        return F.lit((value == NIL_TEXT) != negate)
    if isinstance(dtype, T.StringType):
        if value == NIL_TEXT:
            both = x.isNull() | (x == F.lit(value))
            return ~both if negate else both
        return eq(F.lit(value))
    if isinstance(dtype, INTEGRAL_TYPES):
        if value == NIL_TEXT:
            return is_nil()
        if not _INT_TEXT.fullmatch(value) or abs(int(value)) >= 2 ** 63:
            return never()
        return eq(F.lit(int(value)).cast(dtype))
    if isinstance(dtype, T.DoubleType):
        if value == NIL_TEXT:
            return is_nil()
        try:
            num = float(value)
        except ValueError:
            num = None
        if num is not None and num == num and _go_float_text(num) == value:
            # the shortest text of a double identifies it uniquely; only the two
            # zeros are equal as numbers and differ as texts
            if num != 0:
                return eq(F.lit(num))
    text = canonical_text(x, dtype)
    return (text != F.lit(value)) if negate else (text == F.lit(value))


def predicate(feed: Feed, field: str, operator: str, value: str, spark=None) -> Column:
    x, dtype = resolve_path(feed.df.schema, field)
    if operator == "contains":
        if value == "":
            cond = F.lit(True)
        else:
            cond = simple_lower(canonical_text(x, dtype), value).contains(F.lit(simple_lower_text(value)))
    elif operator == "equals":
        cond = _equals(x, dtype, value)
    elif operator == "not-equals":
        cond = _equals(x, dtype, value, negate=True)
    elif operator == "regex":
        try:
            t = compile_re2(value, spark)
            cond = canonical_text(x, dtype).rlike(t.pattern)
        except RegexError:
            cond = F.lit(False)
    else:
        cond = F.lit(True)
    return cond


def filter_items(feed: Feed, field: str = "", operator: str = "", value: str = "",
                 spark=None) -> Feed:
    if not field or not operator:
        return feed
    cond = predicate(feed, field, operator, value, spark)
    if feed.has_non_objects:
        cond = feed.is_object() & cond
    return feed.with_df(feed.df.where(cond))

