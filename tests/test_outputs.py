"""Outputs: JSON envelope/lines, RSS, webhook payloads and delivery, versions."""

import json
import os

from conftest import feed_of
from sluice.sinks.documents import (json_envelope, rss_document, webhook_payloads,
                                    write_json_lines)
from sluice.sinks.versions import latest_versions, save_output
from sluice.sinks.webhook import deliver
from sluice.sinks.publish import current_output


def test_json_envelope_order_and_count(spark):
    f = feed_of(spark, [(3, "c"), (1, "a"), (2, "b")], "i int, v string")
    row = json_envelope(f, 3).first()
    doc = json.loads(row["document"])
    assert doc == {"count": 3, "items": [{"i": 1, "v": "a"}, {"i": 2, "v": "b"}, {"i": 3, "v": "c"}]}
    assert row["document"] == json.dumps(doc, indent=2)   # two-space indentation, sorted keys


def test_json_envelope_empty(spark):
    f = feed_of(spark, [(1, "a")], "i int, v string")
    from sluice.operators.filter import filter_items
    assert json_envelope(filter_items(f, "v", "equals", "zzz"), 10).count() == 0


def test_json_lines_keep_previous_on_empty(spark, scratch):
    f = feed_of(spark, [(2, "b"), (1, "a")], "i int, v string")
    path = os.path.join(scratch, "out")
    assert write_json_lines(f, path) == 2
    from sluice.operators.filter import filter_items
    assert write_json_lines(filter_items(f, "v", "equals", "zzz"), path) == 0
    lines = [json.loads(x) for x in spark.read.text(current_output(spark, path)).collect() for x in [x["value"]]]
    assert sorted(d["i"] for d in lines) == [1, 2]


def test_rss_document(spark):
    f = feed_of(spark, [(1, None, "d<1>", 1136214245, "", ["a", "b"]), (2, "T2", "", 0, "x", None)],
                "i int, title string, description string, published_at bigint, published string, "
                "categories array<string>")
    doc = rss_document(f, title="My & feed").first()["document"]
    assert doc.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0">')
    assert "<title>My &amp; feed</title>" in doc
    assert "<title>Untitled</title>" in doc and "<title>T2</title>" in doc
    assert "<description>d&lt;1&gt;</description>" in doc
    assert "<pubDate>Mon, 02 Jan 2006 15:04:05 +0000</pubDate>" in doc
    assert "<pubDate>x</pubDate>" in doc
    assert "<category>a</category>" in doc and "<guid>" not in doc
    assert doc.index("Untitled") < doc.index("T2")


def test_webhook_batches_and_file_delivery(spark, scratch):
    f = feed_of(spark, [(i, i * 10) for i in range(25)], "i int, v int")
    p = webhook_payloads(f, 10)
    rows = sorted(p.collect(), key=lambda r: r["batch"])
    assert [r["count"] for r in rows] == [10, 10, 5]
    first = json.loads(rows[0]["payload"])
    assert first["count"] == 10 and [x["i"] for x in first["items"]] == list(range(10))
    target = os.path.join(scratch, "hook")
    deliver(p, "file://" + target)
    sent = [json.loads(r["value"]) for r in spark.read.text(target).collect()]
    assert sorted((x["batch"], x["batches"], x["count"], x["total"]) for x in sent) == [(0, 3, 10, 25), (1, 3, 10, 25), (2, 3, 5, 25)]


def test_versions_latest(spark, scratch):
    table = os.path.join(scratch, "versions")
    docs = spark.createDataFrame([("v1",)], "document string")
    save_output(spark, table, "p", "json", docs, "application/json", created_at=1)
    save_output(spark, table, "p", "json", spark.createDataFrame([("v2",)], "document string"),
                "application/json", created_at=2)
    save_output(spark, table, "p", "json", spark.createDataFrame([], "document string"),
                "application/json", created_at=3)
    latest = latest_versions(spark.read.parquet(table)).collect()
    assert [r["content"] for r in latest] == ["v2"]


def test_read_published_runs_once_when_absent(spark, scratch):
    from sluice.plans.flow import run_flow
    from sluice.sinks.versions import read_published
    table = os.path.join(scratch, "versions")
    flows = spark.createDataFrame([("p1", True), ("p2", False)], "flow_id string, is_public boolean")
    src = spark.createDataFrame([(1, "a"), (2, "b")], "i int, v string")
    cfg = {"nodes": [{"id": "s", "type": "table-source", "config": {"table": "x", "order_by": "i"}},
                     {"id": "j", "type": "json-output", "config": {}}],
           "connections": [{"source": "s", "target": "j"}]}
    calls = []

    def run():
        calls.append(1)
        run_flow(spark, cfg, {"x": src}, versions_table=table, flow_id="p1")
    content, ctype = read_published(spark, table, flows, "p1", "json", run)
    assert json.loads(content)["count"] == 2 and ctype == "application/json" and calls == [1]
    assert read_published(spark, table, flows, "p1", "json", run)[0] == content and calls == [1]
    assert read_published(spark, table, flows, "p2", "json", run) is None and calls == [1]  # private


def test_rss_categories_keep_text_members_of_mixed_lists(spark):
    from sluice.sources.json_source import json_items
    doc = '[{"title":"t","categories":["a",1,"b",null,{"x":1}]}]'
    f = json_items(spark.createDataFrame([(0, doc)], "src int, payload string"))
    out = rss_document(f).first()["document"]
    assert "<category>a</category>" in out and "<category>b</category>" in out
    assert out.count("<category>") == 2


def test_single_documents_never_drop_items(spark):
    import pytest as _pt
    f = feed_of(spark, [(i, "x") for i in range(5)], "i int, v string")
    assert json_envelope(f, 5).first()["count"] == 5
    with _pt.raises(Exception, match="more than 4 items"):
        json_envelope(f, 4).collect()
    with _pt.raises(Exception, match="more than 3 items"):
        rss_document(f, limit=3).collect()


def test_large_saved_documents_are_published_in_chunks(spark, scratch, monkeypatch):
    import pytest as _pt

    import sluice.sinks.documents as D
    from sluice.plans.flow import run_flow
    from sluice.sinks.versions import VERSION_SCHEMA, latest_chunks, latest_documents, publish_document, read_published
    monkeypatch.setattr(D, "CHUNK_ITEMS", 7)
    table = os.path.join(scratch, "versions")
    flows = spark.createDataFrame([("p1", True), ("p2", False)], "flow_id string, is_public boolean")
    for n, kind in ((20, "json"), (50, "json"), (50, "rss")):  # the second save of json is the published one
        src = spark.createDataFrame([(i, f"t{i}") for i in range(n)], "i int, title string")
        cfg = {"nodes": [{"id": "s", "type": "table-source", "config": {"table": "x", "order_by": "i"}},
                         {"id": "o", "type": f"{kind}-output", "config": {}}], "connections": [{"source": "s", "target": "o"}]}
        run_flow(spark, cfg, {"x": src}, versions_table=table, flow_id="p1")
    versions = spark.read.schema(VERSION_SCHEMA).parquet(table)
    for kind in ("json", "rss"):
        whole = read_published(spark, table, flows, "p1", kind)[0]
        rows = sorted((r["chunk"], r["content"]) for r in latest_chunks(versions).where(f"format = '{kind}'").collect())
        assert [c for c, _ in rows] == list(range(8)) and "".join(x for _, x in rows) == whole
        out = os.path.join(scratch, "published", kind)
        assert publish_document(spark, table, flows, "p1", out, kind) is not None
        out = current_output(spark, out)
        parts = sorted(f for f in os.listdir(out) if f.startswith("part"))
        assert "".join(open(os.path.join(out, f)).read() for f in parts).rstrip("\n") == whole.rstrip("\n")
        size = len(whole.encode())
        assert read_published(spark, table, flows, "p1", kind, max_bytes=size)[0] == whole
        with _pt.raises(Exception, match=f"more than {size - 1} bytes"):
            read_published(spark, table, flows, "p1", kind, max_bytes=size - 1)
    with _pt.raises(Exception, match="more than 9 bytes"):
        latest_documents(versions, max_bytes=9).collect()
    assert publish_document(spark, table, flows, "p2", os.path.join(scratch, "private")) is None  # private
