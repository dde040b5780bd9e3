"""Algebraic laws of the operators."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL, feed_of
from sluice.feed import Feed
from sluice.functions.text import strip_html
from sluice.operators.fields import map_fields, regex_replace, truncate
from sluice.operators.filter import filter_items
from sluice.operators.merge import merge


def ordered(feed, cols):
    return [tuple(r) for r in feed.ordered().select(*cols).collect()]


def test_merge_is_associative_in_content_and_order(spark):
    a = feed_of(spark, [(2, "a2"), (1, "a1")], "i int, v string")
    b = feed_of(spark, [(1, "b1")], "i int, v string")
    c = feed_of(spark, [(3, "c3"), (0, "c0")], "i int, v string")
    left = merge([merge([a, b]), c])
    right = merge([a, merge([b, c])])
    flat = merge([a, b, c])
    want = [("a1",), ("a2",), ("b1",), ("c0",), ("c3",)]
    assert ordered(left, ["v"]) == ordered(right, ["v"]) == ordered(flat, ["v"]) == want


def test_strip_is_idempotent_on_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    once = pages.select(strip_html(F.col("html")).alias("s"))
    twice = once.select(strip_html(F.col("s")).alias("s"))
    assert sorted(r["s"] for r in once.collect()) == sorted(r["s"] for r in twice.collect())


def _per_item(spark, feed):
    f = filter_items(feed, "event_type", "not-equals", "view", spark)
    f = map_fields(f, "event_id:event_id, kind:event_type, amount:value, k:props", False)
    f = regex_replace(f, "kind", "(?i)^(.)", "<$1>", spark)
    return truncate(f, "kind", 6)


def test_batch_equals_stream_for_per_item_operators(spark, scratch):
    from sluice.streaming.incremental import incremental_run, read_stream
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    batch = sorted(tuple(r) for r in _per_item(spark, Feed.from_table(ev, "event_id")).items().collect())
    land = os.path.join(scratch, "land")
    ev.write.parquet(land)
    out = os.path.join(scratch, "out")
    s = read_stream(spark, land + "/", ev.schema)
    incremental_run(s, lambda f: _per_item(spark, f), out, "laws", os.path.join(scratch, "ckpt"))
    stream = sorted(tuple(r) for r in spark.read.parquet(out)
                    .select("event_id", "kind", "amount", "k").collect())
    assert batch == stream and len(batch) > 0
