"""Outputs that change by a pointer: a job may end at any step."""

import os

import pytest

from conftest import feed_of
from sluice.sinks import publish as P
from sluice.sinks.documents import write_json_lines
from sluice.sinks.publish import current_output, publish


def write(spark, path, text):
    return publish(spark, path, spark.createDataFrame([(text,)], "value string").write.text)


def now(spark, path):
    return [r["value"] for r in spark.read.text(current_output(spark, path)).collect()]


class Killed(Exception):
    pass


def test_a_job_killed_at_any_step_leaves_an_output(spark, scratch, monkeypatch):
    path = os.path.join(scratch, "out")
    write(spark, path, "first")

    def halfway(target):
        spark.createDataFrame([("half",)], "value string").write.text(target)
        raise Killed
    with pytest.raises(Killed):  # while the version is written
        publish(spark, path, halfway)
    assert now(spark, path) == ["first"]

    def killed(*_, **__):
        raise Killed
    for step, after in (("point_to", "first"), ("prune", "second")):  # before the pointer; before the cleaning
        with monkeypatch.context() as m:
            m.setattr(P, step, killed)
            with pytest.raises(Killed):
                write(spark, path, "second")
        assert now(spark, path) == [after]
    # in the middle of the cleaning: pointer rows go first, versions after them
    with monkeypatch.context() as m:
        m.setattr(P, "list_names", killed)
        with pytest.raises(Killed):
            write(spark, path, "third")
    assert now(spark, path) == ["third"]
    write(spark, path, "fourth")
    assert now(spark, path) == ["fourth"]
    assert len(os.listdir(os.path.join(path, "_versions"))) == P.KEEP  # what the killed jobs left is gone


def test_a_pointer_that_was_not_committed_does_not_count(spark, scratch):
    path = os.path.join(scratch, "out")
    write(spark, path, "first")
    os.makedirs(os.path.join(path, "_pointers", "_temporary", "0", "seq=99999999999999999999"))
    assert now(spark, path) == ["first"]


def test_a_reader_may_finish_the_version_it_has_found(spark, scratch):
    path = os.path.join(scratch, "out")
    write(spark, path, "first")
    found = current_output(spark, path)
    write(spark, path, "second")
    assert [r["value"] for r in spark.read.text(found).collect()] == ["first"]


def test_seq_grows_when_the_clock_does_not(spark, scratch, monkeypatch):
    path = os.path.join(scratch, "out")
    monkeypatch.setattr(P.time, "time_ns", lambda: 7)
    for text in ("a", "b", "c"):
        write(spark, path, text)
    assert now(spark, path) == ["c"]


def test_nothing_published_fails_clearly(spark, scratch):
    with pytest.raises(FileNotFoundError):
        current_output(spark, os.path.join(scratch, "none"))


def test_unordered_feeds_keep_the_order_of_their_partitions(spark, scratch):
    from sluice.feed import Feed
    from sluice.operators.limit import limit_items
    from sluice.sinks.documents import json_envelope, webhook_payloads
    parts = [range(0, 3), range(3, 40), range(40, 50), range(50, 300)]
    df = None
    for p in parts:
        one = spark.createDataFrame([(i,) for i in p], "i int").coalesce(1)
        df = one if df is None else df.union(one)
    path = os.path.join(scratch, "out")
    write_json_lines(Feed(df), path)
    folder = current_output(spark, path)
    lines = [line for f in sorted(os.listdir(folder)) if f.startswith("part") for line in open(os.path.join(folder, f))]
    assert [int(x.split(":")[1].rstrip("}\n")) for x in lines] == list(range(300))
    assert sorted(r["i"] for r in limit_items(Feed(df), 45).df.collect()) == list(range(45))
    assert json_envelope(Feed(df)).first()["document"].index('"i": 2') < json_envelope(Feed(df)).first()["document"].index('"i": 60')
    first = sorted(webhook_payloads(Feed(df), 100).collect(), key=lambda r: r["batch"])[0]["payload"]
    assert first.startswith('{"batch":0,"batches":3,"count":100,"items":[{"i":0},{"i":1},{"i":2},{"i":3}')


def test_feeds_with_an_ordering_are_untouched():
    from sluice.feed import Feed, OrderKey
    f = Feed(None, [OrderKey("a")])
    assert f.positioned() is f


def test_lines_count(spark, scratch):
    f = feed_of(spark, [(2, "b"), (1, "a")], "i int, v string")
    assert write_json_lines(f, os.path.join(scratch, "out")) == 2
