"""Merge (M1-M5): union of all inputs in connection order, optional
first-wins dedupe on a flat field, optional sort.

* Union: ``unionByName(allowMissingColumns=True)``. Items keep their own
  types: a column whose type differs between inputs widens where that loses
  nothing (integers to bigint, float to double); nested objects that differ
  only by missing fields stay nested (Spark merges the structs); any other
  mixture becomes VARIANT, value by value (2^53 + 1 stays itself, ``1`` stays
  a number beside ``"1"``; their canonical texts, and so dedupe keys, agree).
* Order: input ``i``'s ordering columns are renamed apart and an input
  index is added; the new ordering is ``[input, input0 keys, input1 keys,
  ...]``. Rows of different inputs differ at the index, so the NULL
  paddings never decide. No global rank, no single-partition window.
* Dedupe: the key is the canonical text of the flat field (every row
  missing it shares ``<nil>``); the survivor is the first in feed order:
  ``row_number() over (partition by key order by ordering) = 1``, which
  Spark plans with a partial ``WindowGroupLimit`` before the shuffle --
  a hot key (say all rows lacking the field) costs one row per input
  partition, not a third of the data in one task. Non-objects are kept.
* Sort: after dedupe; only ``desc`` descends, absent -> ascending.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..feed import HIDDEN, OBJ, VALUE, Feed, OrderKey, check_case, col, fresh
from ..functions.values import INTEGRAL_TYPES, NIL_TEXT, canonical_text, is_numeric, resolve_flat
from .limit import limit_items
from .sort import sort_by


def _nested_compatible(a: T.DataType, b: T.DataType) -> bool:
    """Types whose union Spark resolves by itself: structs differing only in
    missing fields (recursively), same-shaped arrays/maps, numbers with
    numbers. Anything else (e.g. text vs number inside a struct) is not."""
    if a == b or isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return True
    if is_numeric(a) and is_numeric(b):
        return True
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        bf = {f.name: f.dataType for f in b.fields}
        return all(_nested_compatible(f.dataType, bf[f.name]) for f in a.fields if f.name in bf)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return _nested_compatible(a.elementType, b.elementType)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return a.keyType == b.keyType and _nested_compatible(a.valueType, b.valueType)
    return False


def _as_variant(c, dtype: T.DataType):
    if isinstance(dtype, T.VariantType):
        return c
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_variant_object(c)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        c = c.cast("bigint")
    return c.cast("variant")


def _reconcile(inputs: list[Feed]) -> list[Feed]:
    types: dict[str, list[T.DataType]] = {}
    for f in inputs:
        for fld in f.df.schema.fields:
            if not fld.name.startswith(HIDDEN):
                types.setdefault(fld.name, []).append(fld.dataType)
    target: dict[str, str | None] = {}
    for name, ts in types.items():
        if all(t == ts[0] for t in ts):
            continue
        if all(isinstance(t, (T.NullType, *INTEGRAL_TYPES)) for t in ts):
            target[name] = "bigint"
        elif all(isinstance(t, (T.NullType, T.FloatType, T.DoubleType)) for t in ts):
            target[name] = "double"
        elif all(isinstance(t, (T.StructType, T.ArrayType, T.MapType, T.NullType)) for t in ts) and \
                all(_nested_compatible(x, y) for x in ts for y in ts):
            continue  # nested shapes that differ only by missing fields: Spark merges them
        else:
            target[name] = "variant"
    if not target:
        return inputs
    out = []
    for f in inputs:
        cols = {}
        for fld in f.df.schema.fields:
            kind = target.get(fld.name)
            if kind == "variant":
                cols[fld.name] = _as_variant(col(fld.name), fld.dataType)
            elif kind is not None:
                cols[fld.name] = col(fld.name).cast(kind)
        out.append(f.with_df(f.df.withColumns(cols)))
    return out


def union_feeds(inputs: list[Feed]) -> Feed:
    if not inputs:
        raise ValueError("merge needs at least one input")
    check_case(inputs[0].df.sparkSession, [c for f in inputs for c in f.item_columns])
    inputs = _reconcile(inputs)
    any_non_obj = any(f.has_non_objects for f in inputs)
    tag = fresh("m")
    in_col = f"{tag}_in"
    ordering: list[OrderKey] = [OrderKey(in_col)]
    parts = []
    for i, f in enumerate(inputs):
        sel = [col(c) for c in f.item_columns]
        for j, k in enumerate(f.ordering):
            name = f"{tag}_{i}_{j}"
            sel.append(col(k.name).alias(name))
            ordering.append(OrderKey(name, k.descending, k.nulls_first))
        if any_non_obj:
            sel.append(col(OBJ) if f.has_non_objects else F.lit(True).alias(OBJ))
            sel.append(col(VALUE) if VALUE in f.columns else F.lit(None).alias(VALUE))
        sel.append(F.lit(i).alias(in_col))
        parts.append(f.df.select(*sel))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    return Feed(df, ordering)


def dedupe(feed: Feed, field: str) -> Feed:
    x, dtype = resolve_flat(feed.df.schema, field)
    if isinstance(dtype, T.NullType):
        # every object shares the key '<nil>': the first object survives
        objs = feed.with_df(feed.df.where(feed.is_object())) if feed.has_non_objects else feed
        first = limit_items(objs, 1)
        if not feed.has_non_objects:
            return first
        rest = feed.df.where(~feed.is_object())
        return feed.with_df(first.df.unionByName(rest))
    rn = fresh("rn")
    if isinstance(dtype, T.StringType) and not feed.has_non_objects:
        return _dedupe_text(feed, field, rn)
    key = canonical_text(x, dtype)
    w = Window.partitionBy(key).orderBy(*feed.order_columns())
    if feed.has_non_objects:
        objs = feed.df.where(feed.is_object())
        kept = objs.withColumn(rn, F.row_number().over(w)).where(col(rn) == 1).drop(rn)
        return feed.with_df(kept.unionByName(feed.df.where(~feed.is_object())))
    kept = feed.df.withColumn(rn, F.row_number().over(w)).where(col(rn) == 1).drop(rn)
    return feed.with_df(kept)


def _dedupe_text(feed: Feed, field: str, rn: str) -> Feed:
    """First wins per text key in one pass: a missing value and the literal
    text ``<nil>`` are one key, so the column itself travels with its missing
    values spelled out, and a flag brings them back. No copy of the key goes
    through the shuffle (it would double the bytes of long texts)."""
    missing = fresh("missing")
    spelled = feed.df.withColumns({missing: col(field).isNull(), field: F.coalesce(col(field), F.lit(NIL_TEXT))})
    w = Window.partitionBy(col(field)).orderBy(*feed.order_columns())
    kept = spelled.withColumn(rn, F.row_number().over(w)).where(col(rn) == 1).drop(rn)
    return feed.with_df(kept.withColumn(field, F.when(~col(missing), col(field))).drop(missing))


def merge(inputs: list[Feed], dedupe_field: str = "", sort_field: str = "",
          sort_order: str = "") -> Feed:
    feed = union_feeds(inputs)
    if dedupe_field:
        feed = dedupe(feed, dedupe_field)
    if sort_field:
        feed = sort_by(feed, sort_field, sort_order == "desc")
    return feed
