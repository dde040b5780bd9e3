"""Streams with state tables: keys that return, tops and hashes across batches."""

import os
import random

import pytest

from sluice.feed import OrderKey
from sluice.streaming.incremental import read_stream
from sluice.streaming.state import changed_payloads_stream, dedupe_forever, latest_top, possibly_in, top_overall


def landing(spark, folder, rows, schema):
    """Land rows and return a stream over the folder."""
    spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(folder)
    return read_stream(spark, folder + "/", spark.read.schema(schema).parquet(folder).schema)


def test_a_key_that_returns_much_later_is_dropped(spark, tmp_path):
    base, schema = str(tmp_path), "k string, z long, i long"
    batches = [[("a", 1, 0), ("b", None, 1), ("a", 1, 2), (None, 3, 3)], [("c", 1, 9), ("b", None, 8)],
               [("x", 0, 20)] * 5, [("a", 1, 30), ("a", 2, 31), (None, 3, 32), (None, None, 33)]]
    for rows in batches:
        s = landing(spark, base + "/land", rows, schema)
        dedupe_forever(s, ["k", "z"], ["i"], base + "/out", base + "/state", "d", base + "/ckpt")
    got = sorted(tuple(r) for r in spark.read.parquet(base + "/out").select("batch_id", "i").collect())
    assert got == [(0, 0), (0, 1), (0, 3), (1, 9), (2, 20), (3, 31), (3, 33)]


def test_a_retried_batch_comes_out_the_same(spark, tmp_path):
    base, schema = str(tmp_path), "k string, i long"
    for rows in ([("a", 1)], [("a", 2), ("b", 3)]):
        s = landing(spark, base + "/land", rows, schema)
        dedupe_forever(s, ["k"], ["i"], base + "/out", base + "/state", "d", base + "/ckpt")
    os.remove(base + "/ckpt/commits/1")  # as if the job had ended before the batch was committed
    crc = base + "/ckpt/commits/.1.crc"
    if os.path.exists(crc):
        os.remove(crc)
    dedupe_forever(read_stream(spark, base + "/land/", spark.read.parquet(base + "/land").schema), ["k"], ["i"],
                   base + "/out", base + "/state", "d", base + "/ckpt")
    assert sorted(tuple(r) for r in spark.read.parquet(base + "/out").select("k", "i").collect()) == [("a", 1), ("b", 3)]


def test_the_filter_loses_nothing(spark):
    rows = spark.range(5000).selectExpr("cast(if(id % 7 = 0, null, id) as string) as k", "id")
    wanted = rows.where("id % 100 < 3").select("k")
    got = {r["id"] for r in possibly_in(rows, wanted, ["k"]).collect()}
    assert {r["id"] for r in rows.where("id % 100 < 3").collect()} <= got and len(got) < 2000


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_the_top_of_all_batches(spark, tmp_path, k):
    base, schema = str(tmp_path), "v double, i long"
    r = random.Random(k)
    every = []
    order = [OrderKey("v", descending=True), OrderKey("i")]
    for b in range(4):
        rows = [(r.choice([None, 1.0, 2.5, 7.0, float(b)]), b * 100 + j) for j in range(r.randint(1, 9))]
        every += rows
        s = landing(spark, base + "/land", rows, schema)
        top_overall(s, order, k, base + "/state", "t", base + "/ckpt")
        want = sorted(every, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:k]
        got = [tuple(x) for x in latest_top(spark, base + "/state", s.schema).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_unchanged_payloads_inside_and_across_batches(spark, tmp_path):
    base, schema = str(tmp_path), "feed_url string, payload string, fetched_at long"
    batches = [
        [("u", "1", 10), ("u", "1", 11), ("u", "2", 12), ("u", "1", 13), ("v", "x", 10), (None, "n", 1), ("w", None, 1)],
        [("u", "1", 20), ("v", "y", 5), ("v", "x", 4), (None, "n", 2), ("w", None, 2), ("w", "", 3)],
        [("u", "2", 1), ("v", "y", 30), ("t", "a", 7), ("t", "b", 7), ("t", "a", 8)],
    ]
    for rows in batches:
        s = landing(spark, base + "/land", rows, schema)
        changed_payloads_stream(s, base + "/out", base + "/state", "c", checkpoint=base + "/ckpt")

    import hashlib
    digest = lambda p: "" if p is None else hashlib.sha256(p.encode()).hexdigest()
    want, last = [], {}
    for b, rows in enumerate(batches):
        for u, p, t in sorted(rows, key=lambda x: (str(x[0]), x[2], digest(x[1]))):
            if u not in last or last[u] != digest(p):
                want.append((b, u, p, t))
            last[u] = digest(p)
    got = [tuple(r) for r in spark.read.parquet(base + "/out").select("batch_id", "feed_url", "payload", "fetched_at").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
