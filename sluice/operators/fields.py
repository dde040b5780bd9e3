"""Per-item field rewrites: Map (P1-P5), Regex replace (P6), Truncate.

All are one projection (narrow, no shuffle) with JVM-side expressions.
Non-object items pass unchanged (their fields are NULL and ``__value`` is
kept as is).
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..feed import Feed, check_case, col
from ..functions.regex import compile_re2, replaceable, translate_replacement
from ..functions.text import DEFAULT_MAX_LENGTH, DEFAULT_SUFFIX, truncate_text
from ..functions.values import _inner_text, is_numeric, resolve_flat, resolve_path


def parse_mappings(text: str) -> dict[str, str]:
    """``new:src, new2:a.b`` -> {new: src}. Split on ',', then on the first
    ':'; both sides trimmed; pieces without ':' ignored; last one wins."""
    out: dict[str, str] = {}
    for part in text.split(","):
        part = part.strip()
        if ":" in part:
            k, v = part.split(":", 1)
            out[k.strip()] = v.strip()
    return out


def map_fields(feed: Feed, mappings: str | dict = "", keep_original: bool = False) -> Feed:
    """Build fields from dotted sources of the *original* item.

    keep_original: all old fields stay; a target is replaced only when its
    source is non-nil. Otherwise only the mapped fields (NULL when the
    source is nil). Every target reads the original row, so swaps work.
    """
    if not mappings:
        return feed
    fmap = parse_mappings(mappings) if isinstance(mappings, str) else dict(mappings)
    schema = feed.df.schema
    new_cols = {}
    for target, source in fmap.items():
        expr, dtype = resolve_path(schema, source)
        if isinstance(dtype, T.NullType):
            expr = F.lit(None).cast("string")
        if keep_original and target in feed.item_columns:
            # a nil source leaves the existing value in place
            old_t = schema[target].dataType
            if old_t == dtype or isinstance(dtype, T.NullType):
                expr = F.coalesce(expr.cast(old_t), col(target))
            elif is_numeric(old_t) and is_numeric(dtype):
                expr = F.coalesce(expr.cast("double"), col(target).cast("double"))
            else:
                expr = F.coalesce(_inner_text(expr, dtype), _inner_text(col(target), old_t))
        new_cols[target] = expr
    check_case(feed.df.sparkSession, [*(feed.item_columns if keep_original else []), *new_cols])
    if keep_original:
        return feed.with_df(feed.df.withColumns(new_cols))
    sel = [e.alias(t) for t, e in new_cols.items()] + [col(h) for h in feed.hidden_columns]
    return feed.with_df(feed.df.select(*sel))


def regex_replace(feed: Feed, field: str = "", pattern: str = "", replacement: str = "",
                  spark=None) -> Feed:
    """Replace every match in a string field (an empty one only where no match
    has just ended); a bad pattern raises."""
    if not field or not pattern:
        return feed
    t = compile_re2(pattern, spark)  # raises RegexError
    x, dtype = resolve_flat(feed.df.schema, field)
    java, repl = replaceable(pattern, t), translate_replacement(replacement, t)
    return _on_strings(feed, field, x, dtype, lambda s: F.regexp_replace(s, java, repl))


def _on_strings(feed: Feed, field: str, x, dtype, fn) -> Feed:
    """Apply ``fn`` to the field's value where it is a string: a string
    column as a whole, a mixed-type (VARIANT) column per value; any other
    type is left alone."""
    if isinstance(dtype, T.StringType):
        return feed.with_df(feed.df.withColumn(field, fn(x)))
    if isinstance(dtype, T.VariantType):
        text = F.try_variant_get(x, "$", "string")
        new = F.when(F.schema_of_variant(x) == "STRING", fn(text).cast("variant")).otherwise(x)
        return feed.with_df(feed.df.withColumn(field, new))
    return feed


def truncate(feed: Feed, field: str = "", max_length=DEFAULT_MAX_LENGTH,
             suffix: str = "") -> Feed:
    """Strip HTML and shorten a string field to ``max_length`` bytes."""
    if max_length is None or isinstance(max_length, bool) or not isinstance(max_length, (int, float)):
        max_length = DEFAULT_MAX_LENGTH
    if not suffix:
        suffix = DEFAULT_SUFFIX
    if not field:
        return feed
    x, dtype = resolve_flat(feed.df.schema, field)
    return _on_strings(feed, field, x, dtype, lambda s: truncate_text(s, int(max_length), suffix))
