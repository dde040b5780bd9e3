"""JSON text of items as the reference's JSON writer spells it.

The reference renders outputs with Go's ``encoding/json``: object keys
sorted, ``<``, ``>``, ``&``, U+2028 and U+2029 escaped as ``\\u003c`` and
so on, control characters as ``\\n``/``\\r``/``\\t`` or ``\\u00xx``, floats in
plain notation between 1e-6 and 1e21 (shortest digits, no ``.0``) and as
``1e+21``/``1.5e-7`` outside, and -- for the saved JSON document -- two
space indentation. The renderer is generated on the driver from the
schema (one expression per field, recursing into structs, arrays and
maps) and runs as JVM expressions; Spark's ``to_json`` supplies the basic
string escaping, which is then adjusted to the fixed rules below.

A text appears once in the expression of its object: whether an object is empty
is told from its fields, not from their text, so expressions grow with the
schema and not with a power of its depth.

NULL fields are left out (a missing key and a JSON null are both NULL in
columns; missing is the common case). VARIANT values (mixed-type fields)
are rendered compactly by ``to_json`` without these adjustments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import INTEGRAL_TYPES, NUMERIC_TYPES

# Escapes that differ from the base JSON writer -- characters
# escaped for HTML safety, and control characters the base writer spells
# differently (short forms \b and \f, upper-case hex digits).
HTML_ESCAPES = [("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"),
                ("\u2028", "\\u2028"), ("\u2029", "\\u2029")]
CONTROL_RESPELL = [("b", "u0008"), ("f", "u000c"), ("u000B", "u000b"), ("u000E", "u000e"),
                   ("u000F", "u000f"), ("u001A", "u001a"), ("u001B", "u001b"), ("u001C", "u001c"),
                   ("u001D", "u001d"), ("u001E", "u001e"), ("u001F", "u001f")]
# an escape is real only after an even number of backslashes
_ESCAPE_PREFIX = r"(?<!\\)(?<lead>(?:\\\\)*)\\"


#: Texts without these are their own JSON text; of the others, only those with RARE need respelling.
_SPECIAL = r"[\x00-\x1F\"\\<>&\u2028\u2029]"
_RARE = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def apart(x: Column, f) -> Column:
    """``f(x)`` as a higher-order step: it is evaluated outside the generated
    code of its row, which stays small enough to be compiled, and binds ``x``
    once. For branches that few rows take."""
    return F.element_at(F.transform(F.array(x), f), 1)


def json_string(x: Column) -> Column:
    """A string as a JSON string literal (``null`` for NULL). Most texts hold
    nothing special: one search spares them the rest."""
    return F.when(x.isNull(), F.lit("null")).when(~x.rlike(_SPECIAL), F.concat(F.lit('"'), x, F.lit('"'))) \
        .otherwise(apart(x, _any_string))


def _any_string(x: Column) -> Column:
    arr = F.to_json(F.array(x))                       # ["..."], base escaping
    s = F.regexp_replace(arr, r"^\[|\]$", "")         # the array's brackets, made and read once
    for a, b in HTML_ESCAPES:
        s = F.replace(s, F.lit(a), F.lit(b))
    respelled = s
    for a, b in CONTROL_RESPELL:
        respelled = F.regexp_replace(respelled, _ESCAPE_PREFIX + a, "${lead}\\\\" + b)
    return F.when(~x.rlike(_RARE), s).otherwise(respelled)


def json_key(name: str) -> str:
    """Python side of the same string rules, for field names."""
    out = ['"']
    for ch in name:
        o = ord(ch)
        if ch in '"\\':
            out.append("\\" + ch)
        elif ch == "\n":
            out.append("\\n")
        elif ch == "\r":
            out.append("\\r")
        elif ch == "\t":
            out.append("\\t")
        elif o < 0x20 or ch in "<>&\u2028\u2029":
            out.append("\\u%04x" % o)
        else:
            out.append(ch)
    out.append('"')
    return "".join(out)


def json_float(x: Column) -> Column:
    """Go's JSON float spelling from Java's shortest digits. Whole numbers and
    the range that Java writes plainly take short ways."""
    size = F.abs(x)
    return (F.when((size < 1e15) & (size > 0) & (F.floor(x) == x), x.cast("bigint").cast("string"))
            .when((size < 1e7) & (size >= 1e-3), x.cast("string")).otherwise(apart(x, _any_float)))


def _any_float(x: Column) -> Column:
    s = x.cast("string")
    pat = r"^(-?)([0-9])\.([0-9]+)E(-?[0-9]+)$"
    sign = F.regexp_extract(s, pat, 1)
    lead = F.regexp_extract(s, pat, 2)
    frac = F.regexp_replace(F.regexp_extract(s, pat, 3), "0+$", "")
    n = F.regexp_extract(s, pat, 4).cast("int")
    digits = F.concat(lead, frac)
    mant = F.when(frac == "", lead).otherwise(F.concat(lead, F.lit("."), frac))
    big = F.concat(sign, mant, F.lit("e+"), n.cast("string"))
    tiny = F.concat(sign, mant, F.lit("e-"), (-n).cast("string"))
    wide = F.when(F.length(digits) <= n + 1, F.concat(sign, digits, F.repeat(F.lit("0"), n + 1 - F.length(digits)))) \
        .otherwise(F.concat(sign, digits.substr(F.lit(1), n + 1), F.lit("."), digits.substr(n + 2, F.lit(1 << 20))))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -n - 1), digits)
    sci = (F.when(n >= 21, big).when(n <= -7, tiny).when(n >= 0, wide).otherwise(small))
    return (F.when(x.isNull() | s.isin("NaN", "Infinity", "-Infinity"), F.lit("null"))
            .when(s.contains("E"), sci)
            .otherwise(F.regexp_replace(s, r"\.0$", "")))


def render(x: Column, dtype: T.DataType, indent: str | None = None, level: int = 0) -> Column:
    """JSON text of a value of type ``dtype`` (never NULL: ``null``)."""
    if isinstance(dtype, T.NullType):
        return F.lit("null")
    if isinstance(dtype, T.StringType):
        return json_string(x)
    if isinstance(dtype, T.BooleanType):
        return F.when(x, F.lit("true")).when(~x, F.lit("false")).otherwise(F.lit("null"))
    if isinstance(dtype, INTEGRAL_TYPES):
        return F.coalesce(x.cast("string"), F.lit("null"))
    if isinstance(dtype, NUMERIC_TYPES):
        return json_float(x.cast("double") if isinstance(dtype, T.DecimalType) else x)
    inner = "" if indent is None else "\n" + indent * (level + 1)
    outer = "" if indent is None else "\n" + indent * level
    sep = ":" if indent is None else ": "
    if isinstance(dtype, T.ArrayType):
        et = dtype.elementType
        body = F.array_join(F.transform(x, lambda e: render(e, et, indent, level + 1)), "," + inner)
        return (F.when(x.isNull(), F.lit("null")).when(F.size(x) == 0, F.lit("[]"))
                .otherwise(F.concat(F.lit("[" + inner), body, F.lit(outer + "]"))))
    if isinstance(dtype, T.StructType):
        entries, there = [], F.lit(False)
        for f in sorted(dtype.fields, key=lambda f: f.name.encode("utf-8")):
            v = x.getField(f.name)
            there = there | v.isNotNull()
            entries.append(F.when(v.isNotNull(), F.concat(F.lit(json_key(f.name) + sep),
                                                          render(v, f.dataType, indent, level + 1))))
        body = F.concat_ws("," + inner, *entries) if entries else F.lit("")
        return (F.when(x.isNull(), F.lit("null")).when(~there, F.lit("{}"))
                .otherwise(F.concat(F.lit("{" + inner), body, F.lit(outer + "}"))))
    if isinstance(dtype, T.MapType):
        vt = dtype.valueType

        def entry(k):
            return F.concat(json_string(k.cast("string")), F.lit(sep),
                            render(F.element_at(x, k), vt, indent, level + 1))
        body = F.array_join(F.transform(F.array_sort(F.map_keys(x)), entry), "," + inner)
        return (F.when(x.isNull(), F.lit("null")).when(F.size(x) == 0, F.lit("{}"))
                .otherwise(F.concat(F.lit("{" + inner), body, F.lit(outer + "}"))))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):  # nothing to escape
        return F.coalesce(F.concat(F.lit('"'), x.cast("string"), F.lit('"')), F.lit("null"))
    if isinstance(dtype, T.VariantType):
        return F.coalesce(F.to_json(x), F.lit("null"))
    return json_string(x.cast("string"))
