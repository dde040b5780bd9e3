"""Sort (T8) and the shared key logic for Merge's sort (M3).

Stable: the key is prepended to the feed's ordering, so ties keep the
previous order. Nothing is sorted here -- the ordering is applied by the
consumer that makes order observable (limit, dedupe, outputs), so a sort
followed by a filter or another sort costs nothing.

Numbers compare numerically; anything else as canonical text by bytes.
In a numeric column nil prints ``<nil>``, above every number's text:
last ascending, first descending. Non-object items go last.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..feed import OBJ, Feed, OrderKey, fresh
from ..functions.values import resolve_path, sort_keys


def sort_by(feed: Feed, field: str, descending: bool) -> Feed:
    x, dtype = resolve_path(feed.df.schema, field)
    cols, keys = {}, []
    for key, numeric in sort_keys(x, dtype):
        name = fresh("sort")
        cols[name] = key
        # numeric nil: text '<nil>' sorts above numbers -> last asc, first desc
        keys.append(OrderKey(name, descending, numeric and descending))
    df = feed.df.withColumns(cols)
    if feed.has_non_objects:
        keys = [OrderKey(OBJ, True, False)] + keys
    return feed.with_df(df, keys + list(feed.ordering))


def sort_items(feed: Feed, field: str = "", order: str = "") -> Feed:
    """Sort node: empty field -> pass; empty order -> descending;
    ``desc`` descends, any other value ascends."""
    if not field:
        return feed
    if order == "":
        order = "desc"
    return sort_by(feed, field, order == "desc")


def rank_column(feed: Feed, name: str = "rank"):
    """``row_number`` over the ordering: only for already-bounded feeds."""
    from pyspark.sql import Window
    return F.row_number().over(Window.orderBy(*feed.order_columns())).cast("bigint").alias(name)
