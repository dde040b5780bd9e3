"""Value semantics of untyped items, as Spark column expressions.

* ``resolve_path`` -- dotted-path access (``author.name``), resolved on the
  driver against the schema: struct step -> field, string-keyed map step ->
  ``try_element_at``, variant step -> ``try_variant_get``, anything else
  (arrays, scalars, unknown names) -> NULL. Never passes the dotted text to
  ``F.col``: on ``array<struct>`` Spark would extract an array and an
  unknown name would be an analysis error, where the item model yields nil.
* ``canonical_text`` -- the text a value prints as (Go's ``%v``): strings
  as is, nil as ``<nil>``, booleans ``true``/``false``, numbers in the
  shortest form (exponent beyond 1e6 or below 1e-4), lists ``[a b]``,
  objects ``map[k:v ...]`` by sorted key. Used by filter, text sort and
  dedupe keys. Every branch is a JVM-side expression (no UDF).
* ``sort_key`` -- the comparison key for Sort/Merge sort.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..feed import col

# How a missing/nil value and non-finite floats print.
NIL_TEXT = "<nil>"
POS_INF_TEXT = "+Inf"
NEG_INF_TEXT = "-Inf"
NAN_TEXT = "NaN"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers count as numbers; numeric *text* does not."""
    return isinstance(dtype, NUMERIC_TYPES)


def _field(schema: T.StructType, name: str) -> T.StructField | None:
    for f in schema.fields:
        if f.name == name:
            return f
    return None


def _variant_step(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def resolve_path(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """Dotted path -> (expression, type). Missing anything -> (NULL, NullType)."""
    parts = path.split(".")
    f = _field(schema, parts[0])
    if f is None or parts[0].startswith("__"):
        return F.lit(None), T.NullType()
    expr, dtype = col(f.name), f.dataType
    for p in parts[1:]:
        if isinstance(dtype, T.StructType):
            sub = _field(dtype, p)
            if sub is None:
                return F.lit(None), T.NullType()
            expr, dtype = expr.getField(p), sub.dataType
        elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            expr, dtype = F.try_element_at(expr, F.lit(p)), dtype.valueType
        elif isinstance(dtype, T.VariantType):
            expr = F.try_variant_get(expr, _variant_step(p), "variant")
        else:
            return F.lit(None), T.NullType()
    return expr, dtype


def resolve_flat(schema: T.StructType, name: str) -> tuple[Column, T.DataType]:
    """Flat literal key (dedupe, regex, truncate): the column named exactly so."""
    f = _field(schema, name)
    if f is None or name.startswith("__"):
        return F.lit(None), T.NullType()
    return col(f.name), f.dataType


# ---------------------------------------------------------------------------
# numbers
# ---------------------------------------------------------------------------

def float_text(x: Column) -> Column:
    """Shortest round-trip text of a float/double in Go's ``%v`` layout.

    Java's ``Double.toString`` gives the shortest digits, plain for
    1e-3 <= |x| < 1e7 and ``d.dddE[-]n`` otherwise; Go's ``%v`` is plain for
    1e-4 <= |x| < 1e6 and ``d.ddde[+-]nn`` otherwise. So only two bands
    move: [1e6, 1e7) to exponent form and [1e-4, 1e-3) to plain form; the
    rest is spelling (no ``.0``, ``e+07``). A short chain of regex rewrites.
    """
    s = x.cast("string")
    exp_small = F.regexp_replace(s, r"^(?<s>-?)(?<d>[0-9])\.(?<f>[0-9]*?)0*E-4$", "${s}0.000${d}${f}")
    exp_form = F.regexp_replace(s, r"\.0E", "E")
    exp_form = F.regexp_replace(exp_form, r"E(?<s>-?)(?<d>[0-9])$", "E${s}0${d}")
    exp_form = F.regexp_replace(F.regexp_replace(exp_form, "E-", "e-"), "E", "e+")
    million = F.regexp_replace(s, r"^(?<s>-?)(?<d>[0-9])(?<r>[0-9]{6})\.(?<f>[0-9]*)$", "${s}${d}.${r}${f}e+06")
    million = F.regexp_replace(million, r"\.?0+e", "e")
    plain = F.regexp_replace(s, r"\.0$", "")
    return (F.when(s == "NaN", F.lit(NAN_TEXT))
            .when(s == "Infinity", F.lit(POS_INF_TEXT))
            .when(s == "-Infinity", F.lit(NEG_INF_TEXT))
            .when(s.endswith("E-4"), exp_small)
            .when(s.contains("E"), exp_form)
            .when(s.rlike(r"^-?[0-9]{7}\."), million)
            .otherwise(plain))


def number_text(x: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, INTEGRAL_TYPES):
        return x.cast("string")
    if isinstance(dtype, T.DecimalType):
        return float_text(x.cast("double"))
    return float_text(x)


# ---------------------------------------------------------------------------
# canonical text
# ---------------------------------------------------------------------------

def _go_key_order(names: list[str]) -> list[str]:
    return sorted(names, key=lambda n: n.encode("utf-8"))


def _inner_text(x: Column, dtype: T.DataType) -> Column:
    """Text of a value, NULL when the value is nil (callers decide)."""
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast("string")
    if isinstance(dtype, T.StringType):
        return x
    if isinstance(dtype, T.BooleanType):
        return F.when(x, F.lit("true")).when(~x, F.lit("false"))
    if is_numeric(dtype):
        return number_text(x, dtype)
    if isinstance(dtype, T.ArrayType):
        et = dtype.elementType
        return F.when(x.isNull(), F.lit(None)).otherwise(
            F.concat(F.lit("["),
                     F.array_join(F.transform(x, lambda e: F.coalesce(_inner_text(e, et), F.lit(NIL_TEXT))),
                                  " "),
                     F.lit("]")))
    if isinstance(dtype, T.StructType):
        parts = []
        for name in _go_key_order([f.name for f in dtype.fields]):
            f = _field(dtype, name)
            v = x.getField(name)
            # absent keys and JSON nulls are both NULL; absent is far more
            # common in items, so a NULL field is left out of the text
            parts.append(F.when(v.isNotNull(), F.concat(F.lit(name + ":"),
                                                         F.coalesce(_inner_text(v, f.dataType),
                                                                    F.lit(NIL_TEXT)))))
        body = F.concat_ws(" ", *parts) if parts else F.lit("")
        return F.when(x.isNull(), F.lit(None)).otherwise(F.concat(F.lit("map["), body, F.lit("]")))
    if isinstance(dtype, T.MapType):
        vt = dtype.valueType

        def entry(k):
            return F.concat(k.cast("string"), F.lit(":"),
                            F.coalesce(_inner_text(F.element_at(x, k), vt), F.lit(NIL_TEXT)))
        return F.when(x.isNull(), F.lit(None)).otherwise(
            F.concat(F.lit("map["),
                     F.array_join(F.transform(F.array_sort(F.map_keys(x)), entry), " "),
                     F.lit("]")))
    if isinstance(dtype, T.VariantType):
        return variant_text(x)
    # timestamps, dates, binary: Spark's own text (no counterpart in items)
    return x.cast("string")


VARIANT_DEPTH = 2
# What stands for an escaped backslash and an escaped quote while a JSON text
# is cut up: control characters, which JSON texts hold only as escapes.
_BACKSLASH, _QUOTE = "\x01", "\x02"
_JSON_TOKEN = '"[^"]*+"|[{}\\[\\],:]|[^"{}\\[\\],:]++'


def json_text(j: Column) -> Column:
    """Text (%v) of a list or object given as the compact JSON text of a
    VARIANT, at any depth: the text is cut into its tokens, each is respelled
    by itself, and they are joined again. Object keys come in order already."""
    cut = F.replace(F.replace(j, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))

    def respell(t):
        whole = F.replace(F.replace(t, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
        number = t.cast("double")
        return (F.when(t.startswith('"') & t.contains("\\") | t.contains(_BACKSLASH) | t.contains(_QUOTE),
                       F.try_variant_get(F.try_parse_json(whole), "$", "string"))
                .when(t.startswith('"'), t.substr(F.lit(2), F.length(t) - F.lit(2)))
                .when(t == ",", F.lit(" ")).when(t == "{", F.lit("map[")).when(t == "}", F.lit("]"))
                .when(t == "null", F.lit(NIL_TEXT))
                .when(t.rlike("^-?[0-9]{16,}$") & (F.abs(number) > float(1 << 53)), t)
                .when(t.rlike("^-?[0-9]"), float_text(number))
                .otherwise(t))
    return F.array_join(F.transform(F.regexp_extract_all(cut, F.lit(_JSON_TOKEN), F.lit(0)), respell), "")


def variant_text(v: Column, depth: int = VARIANT_DEPTH) -> Column:
    """Text of a VARIANT value as %v: scalars, lists and objects at any depth.
    JSON numbers are doubles in the item model; integers beyond 2^53 keep
    their digits. Lists and objects go by their JSON text, which spells an
    infinite number like a string; only where it might hold one, the upper
    ``depth`` levels are told apart value by value."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    whole = F.try_variant_get(v, "$", "bigint")
    out = (F.when(v.isNull() | (kind == "VOID"), F.lit(None))
           .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
           .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit("true"))
                 .otherwise(F.lit("false")))
           .when(kind.startswith("BIGINT") & (F.abs(number) > float(1 << 53)), whole.cast("string"))
           .when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), float_text(number)))
    j = F.to_json(v)
    nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    if depth > 0:
        def inner(e):
            return F.coalesce(variant_text(e, depth - 1), F.lit(NIL_TEXT))
        out = out.when(nested & ~j.contains('Infinity"'), json_text(j))
        items = F.try_variant_get(v, "$", "array<variant>")
        members = F.try_variant_get(v, "$", "map<string,variant>")
        out = out.when(kind.startswith("ARRAY"), F.concat(
            F.lit("["), F.array_join(F.transform(items, inner), " "), F.lit("]")))
        out = out.when(kind.startswith("OBJECT"), F.concat(F.lit("map["), F.array_join(F.transform(
            F.array_sort(F.map_keys(members)), lambda k: F.concat(k, F.lit(":"), inner(F.element_at(members, k)))), " "),
            F.lit("]")))
    else:
        out = out.when(nested, json_text(j))
    return out.otherwise(j)


def canonical_text(x: Column, dtype: T.DataType) -> Column:
    """Never-NULL text of a value; nil prints as ``<nil>``."""
    if isinstance(dtype, T.NullType):
        return F.lit(NIL_TEXT)
    return F.coalesce(_inner_text(x, dtype), F.lit(NIL_TEXT))


# The two characters whose lower case differs between a
# per-character simple mapping (the item model) and full case mapping
# (Java, Python): capital I with dot above (full mapping adds U+0307), and
# capital sigma (full mapping gives final sigma at the end of a word).
# Each fix lists the characters a needle must contain for it to matter.
SIMPLE_LOWER_FIXES = {"\u0130": ("i", "i\u0307"), "\u03a3": ("\u03c3", "\u03c3\u03c2")}


def simple_lower(c: Column, needle: str | None = None) -> Column:
    """Lower case character by character (no expansions, no context).

    With ``needle`` (a literal searched for in the result), only the fixes
    whose characters occur in the lowered needle are applied: elsewhere a
    match cannot overlap a character the two mappings disagree on, so plain
    ``lower`` gives the same answer at full speed."""
    low = simple_lower_text(needle) if needle is not None else None
    for src, (dst, relevant) in SIMPLE_LOWER_FIXES.items():
        if low is None or any(ch in low for ch in relevant):
            c = F.replace(c, F.lit(src), F.lit(dst))
    return F.lower(c)


def simple_lower_text(s: str) -> str:
    return "".join(SIMPLE_LOWER_FIXES[ch][0] if ch in SIMPLE_LOWER_FIXES else ch for ch in s).lower()


# ---------------------------------------------------------------------------
# sort keys
# ---------------------------------------------------------------------------

def sort_key(x: Column, dtype: T.DataType) -> tuple[Column, bool]:
    """(key, numeric?) for Sort / Merge sort.

    Two numbers compare numerically; anything else compares as canonical
    text by bytes. In a numeric column a nil prints ``<nil>``, which is
    above every number's text, so nil sorts last ascending and first
    descending -- the caller picks the null placement from ``numeric``.
    """
    if is_numeric(dtype):
        return x.cast("double"), True
    if isinstance(dtype, T.StringType):
        return F.coalesce(x, F.lit(NIL_TEXT)), False
    return canonical_text(x, dtype), False


VARIANT_NUMBER_KINDS = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"


def sort_keys(x: Column, dtype: T.DataType) -> list[tuple[Column, bool]]:
    """Sort keys, most significant first, as (key, numeric?) pairs.

    A mixed-type (VARIANT) field gets a total order: numbers (compared as
    numbers) before texts (compared by bytes), i.e. keys (is_text, number,
    text). The item model compares a number with a text by their texts,
    which is not transitive; this is the declared total order instead."""
    if not isinstance(dtype, T.VariantType):
        return [sort_key(x, dtype)]
    is_num = F.coalesce(F.schema_of_variant(x).rlike(VARIANT_NUMBER_KINDS), F.lit(False))
    return [(F.when(is_num, F.lit(0)).otherwise(F.lit(1)), True),
            (F.when(is_num, F.try_variant_get(x, "$", "double")), True),
            (F.when(~is_num, canonical_text(x, dtype)), False)]
