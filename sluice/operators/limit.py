"""Limit (T9) and top-k.

First ``n`` items in feed order. ``count`` must be a number: absent,
non-numeric, ``<= 0`` or at least the item count -> all items; fractions
truncate (``0.5`` -> none, ``2.9`` -> 2).

``orderBy(ordering).limit(n)`` plans as ``TakeOrderedAndProject``: every
partition keeps its own top n, and only those meet in one task -- the
data is never globally sorted, and a preceding Sort costs nothing extra.

Top-k lets n rows of every task meet in one, so a large n would not fit it:
above ``TOPK_MAX_ROWS`` the limit becomes ``rank <= n`` over ``global_rank``
(range-partitioned sort + per-partition offsets), which stays distributed.
That is a choice of plan only: the same items come out for any n and any
ordering. A feed without an ordering has the order of its partitions. The
large plan runs its sort and checkpoint when the limit is applied, so it is
for batch feeds.
"""

from __future__ import annotations

from numbers import Real

from ..feed import Feed

TOPK_MAX_ROWS = 100_000


def limit_count(count) -> int | None:
    """None = keep everything; otherwise the number of items to keep."""
    if isinstance(count, bool) or not isinstance(count, Real):
        return None
    if count <= 0:
        return None
    return int(count)


def limit_items(feed: Feed, count=None) -> Feed:
    n = limit_count(count)
    if n is None:
        return feed
    feed = feed.positioned()
    if n <= TOPK_MAX_ROWS:
        return feed.with_df(feed.df.orderBy(*feed.order_columns()).limit(n))
    from pyspark.sql import functions as F

    from ..feed import col, fresh
    from ..plans.rank import global_rank
    rk = fresh("lim")
    ranked = global_rank(feed, rk)
    return feed.with_df(ranked.df.where(col(rk) <= F.lit(n)).drop(rk))
