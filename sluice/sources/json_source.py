"""JSON source (S7-S10): landed payloads -> items.

Input: a table with one JSON document per row (``source_url``, ``payload``)
-- HTTP fetching itself is not part of the engine; payloads are landed
first. Each payload is parsed to VARIANT (``parse_json``: a bad document
fails the job, as a bad body fails the run; ``on_error='null'`` uses
``try_parse_json`` and yields one nil item instead).

``items_path`` walks map keys and list indexes (``data.items.0``); each
step tries the key and, for a numeric step, the index. A list becomes one
item per element (``posexplode``, so ``__pos`` keeps document order), an
object one item, a scalar or nil one non-object item.

Items become columns with a declared schema, or with one inferred by
``schema_of_variant_agg`` (one extra pass). JSON numbers are doubles in
the item model, so every inferred number is cast to double.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..feed import OBJ, VALUE, Feed, OrderKey, check_case, col, fresh


def _key_path(step: str) -> str:
    return "$['" + step.replace("\\", "\\\\").replace("'", "\\'") + "']"


def walk_items_path(df: DataFrame, items_path: str, at: str) -> DataFrame:
    """Column ``at`` (VARIANT) becomes what the path leads to: map step by
    key, list step by index; anything else -> NULL. Every step is a
    projection over a column, so the document is parsed once and a step is
    two lookups, whatever the depth."""
    for step in items_path.split(".") if items_path else []:
        v = F.try_variant_get(col(at), _key_path(step), "variant")
        if re.fullmatch(r"[0-9]+", step):
            v = F.coalesce(v, F.try_variant_get(col(at), f"$[{int(step)}]", "variant"))
        df = df.withColumn(at, v)
    return df


def _numbers_to_double(dtype: T.DataType) -> T.DataType:
    """JSON numbers are doubles in the item model; a field seen only as
    null (VOID) becomes a string column that is always NULL."""
    if isinstance(dtype, (T.DecimalType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.FloatType)):
        return T.DoubleType()
    if isinstance(dtype, T.NullType):
        return T.StringType()
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _numbers_to_double(f.dataType), True) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_numbers_to_double(dtype.elementType), True)
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, _numbers_to_double(dtype.valueType), True)
    return dtype


def _ddl_type(spark, ddl: str) -> T.DataType:
    return T._parse_datatype_string(ddl) if spark is None else \
        spark.createDataFrame([], f"x {ddl}").schema["x"].dataType


def json_payload_items(payloads: DataFrame, payload_col: str = "payload",
                       items_path: str = "", order_cols: list[str] | None = None,
                       on_error: str = "fail", limit=None) -> Feed:
    """Explode payloads to one VARIANT item per row (``__item``); ``limit``
    keeps the first n items of each payload (cut before exploding)."""
    from ..operators.limit import limit_count
    parse = F.parse_json if on_error == "fail" else F.try_parse_json
    doc = fresh("doc")
    walked = walk_items_path(payloads.withColumn(doc, parse(col(payload_col))), items_path, doc)
    kind = F.schema_of_variant(col(doc))
    as_list = F.when(kind.startswith("ARRAY"), F.try_variant_get(col(doc), "$", "array<variant>")) \
        .otherwise(F.array(col(doc)))
    n = limit_count(limit)
    if n is not None:
        as_list = F.slice(as_list, 1, n) if n > 0 else F.filter(as_list, lambda x: F.lit(False))
    pos, item = fresh("pos"), "__item"
    order_cols = order_cols if order_cols is not None else \
        [c for c in payloads.columns if c != payload_col][:1]
    keep = [col(c) for c in payloads.columns if c != payload_col]
    src_keys = []
    hidden = []
    for c in order_cols:
        h = fresh("src")
        hidden.append(col(c).alias(h))
        src_keys.append(OrderKey(h))
    df = walked.select(*keep, *hidden, F.posexplode(as_list).alias(pos, item))
    return Feed(df, src_keys + [OrderKey(pos)])


def infer_item_schema(feed: Feed, item: str = "__item") -> T.StructType:
    """One aggregation pass (partial per task, merged once): the merged
    schema of all object items."""
    row = feed.df.where(F.schema_of_variant(col(item)).startswith("OBJECT")) \
        .agg(F.schema_of_variant_agg(col(item)).alias("s")).first()
    ddl = row["s"] if row and row["s"] else "OBJECT<>"
    if not ddl.startswith("OBJECT<") or ddl == "OBJECT<>":
        return T.StructType([])
    inner = ddl[len("OBJECT<"):-1].replace("OBJECT<", "STRUCT<")
    spark = feed.df.sparkSession
    st = _ddl_type(spark, "struct<" + inner + ">")
    return _numbers_to_double(st)


def items_to_columns(feed: Feed, schema: T.StructType | str | None = None,
                     item: str = "__item", keep: list[str] | None = None) -> Feed:
    """Project VARIANT items to typed columns + ``__obj`` / ``__value``."""
    if schema is None:
        schema = infer_item_schema(feed, item)
    elif isinstance(schema, str):
        schema = _ddl_type(feed.df.sparkSession, "struct<" + schema + ">")
    check_case(feed.df.sparkSession, [*(keep or []), *schema.fieldNames()])
    v = col(item)
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    fields = []
    for f in schema.fields:
        if isinstance(f.dataType, T.VariantType):
            e = F.try_variant_get(v, _key_path(f.name), "variant")
        else:
            e = F.try_variant_get(v, _key_path(f.name), f.dataType.simpleString())
        fields.append(e.alias(f.name))
    keep_cols = [col(c) for c in (keep or [])]
    hidden = [col(h) for h in feed.hidden_columns if h != item]
    df = feed.df.select(*keep_cols, *fields, *hidden,
                        is_obj.alias(OBJ),
                        F.when(~is_obj, v).alias(VALUE))
    return feed.with_df(df)


def json_items(payloads: DataFrame, items_path: str = "", schema=None, payload_col: str = "payload",
               order_cols: list[str] | None = None, limit=None, on_error: str = "fail") -> Feed:
    """S7-S10 in one call; ``limit`` applies per payload (S6). Without a
    declared ``schema`` one inference pass runs over all items."""
    feed = json_payload_items(payloads, payload_col, items_path, order_cols, on_error, limit)
    return items_to_columns(feed, schema)


def to_payload(items: DataFrame, group_cols: list[str], order_col: str, items_path: str = "data.items",
               payload_col: str = "payload") -> DataFrame:
    """Build landed JSON payloads from a table (test fixture shape).

    Items are nested under ``items_path``; ``array_sort`` over a struct led
    by ``order_col`` fixes the order inside the payload.
    """
    value_cols = [c for c in items.columns if c not in group_cols]
    packed = F.array_sort(F.collect_list(F.struct(col(order_col).alias("__o"),
                                                  F.struct(*[col(c) for c in value_cols]).alias("v"))))
    arr = F.transform(packed, lambda x: x["v"])
    doc = arr
    for step in reversed(items_path.split(".")) if items_path else []:
        doc = F.struct(doc.alias(step))
    return items.groupBy(*group_cols).agg(F.to_json(doc).alias(payload_col))


def headers_from_text(text: str) -> dict[str, str]:
    """``Name: value`` per line; first ':' splits; bad lines ignored."""
    out = {}
    for line in (text or "").split("\n"):
        line = line.strip()
        if ":" in line:
            k, v = line.split(":", 1)
            out[k.strip()] = v.strip()
    return out


__all__ = ["json_items", "json_payload_items", "items_to_columns", "infer_item_schema",
           "walk_items_path", "to_payload", "headers_from_text"]
