"""Flow composer: validation, execution, fan-out, run records."""

import os

import pytest

from sluice.plans.flow import FlowError, run_flow, validate
from sluice.sinks.publish import current_output


def _cfg(nodes, conns):
    return {"nodes": nodes, "connections": [{"id": str(i), "source": s, "target": t}
                                            for i, (s, t) in enumerate(conns)]}


def test_validation_errors():
    n = [{"id": "a", "type": "filter"}, {"id": "b", "type": "limit"}]
    with pytest.raises(FlowError, match="cycle"):
        validate(_cfg(n, [("a", "b"), ("b", "a")]))
    with pytest.raises(FlowError, match="unknown node"):
        validate(_cfg(n, [("a", "zz")]))
    with pytest.raises(FlowError, match="duplicate"):
        validate(_cfg(n + [{"id": "a", "type": "sort"}], []))
    with pytest.raises(FlowError, match="unknown node type: nope"):
        validate(_cfg([{"id": "a", "type": "nope"}], []))
    assert validate({"nodes": [], "connections": []}) == []


def test_run_flow_end_to_end(spark, scratch):
    src = spark.createDataFrame([(i, f"t{i % 3}", i % 5) for i in range(20)], "i int, t string, v int")
    cfg = _cfg([
        {"id": "s", "type": "table-source", "config": {"table": "x", "order_by": "i"}},
        {"id": "m", "type": "merge", "config": {"dedupe_field": "t"}},
        {"id": "o", "type": "sort", "config": {"field": "i", "order": "desc"}},
        {"id": "j", "type": "json-output", "config": {}},
    ], [("s", "m"), ("s", "m"), ("m", "o"), ("o", "j")])
    res = run_flow(spark, cfg, {"x": src}, out_dir=os.path.join(scratch, "out"),
                   runs_table=os.path.join(scratch, "runs"), observe_nodes=True)
    assert res.status == "success" and res.items_processed == 3
    import json
    lines = [json.loads(r["value"]) for r in spark.read.text(current_output(spark, os.path.join(scratch, "out", "j"))).collect()]
    assert [d["i"] for d in lines] == [2, 1, 0]
    runs = spark.read.parquet(os.path.join(scratch, "runs")).collect()
    assert runs[0]["status"] == "success" and runs[0]["items_processed"] == 3


def test_run_flow_failure_is_recorded(spark, scratch):
    src = spark.createDataFrame([(1, "a")], "i int, t string")
    cfg = _cfg([
        {"id": "s", "type": "table-source", "config": {"table": "x", "order_by": "i"}},
        {"id": "r", "type": "regex", "config": {"field": "t", "pattern": "(?=a)", "replacement": "b"}},
    ], [("s", "r")])
    runs = os.path.join(scratch, "runs")
    with pytest.raises(FlowError, match="node r"):
        run_flow(spark, cfg, {"x": src}, runs_table=runs)
    row = spark.read.parquet(runs).first()
    assert row["status"] == "failed" and "regex" in row["error_message"].lower()


def test_node_without_input_yields_nothing(spark):
    cfg = _cfg([{"id": "f", "type": "filter", "config": {"field": "a", "operator": "equals", "value": "x"}}], [])
    res = run_flow(spark, cfg, {})
    assert res.outputs["f"] is None and res.items_processed == 0


def test_run_logs_and_history(spark, scratch):
    from sluice.plans.history import recent_runs, run_log
    src = spark.createDataFrame([(i, i % 2) for i in range(10)], "i int, v int")
    cfg = _cfg([
        {"id": "s", "type": "table-source", "config": {"table": "x", "order_by": "i"}},
        {"id": "f", "type": "filter", "config": {"field": "v", "operator": "equals", "value": "1"}},
        {"id": "j", "type": "json-output", "config": {}},
    ], [("s", "f"), ("f", "j")])
    runs, logs = os.path.join(scratch, "runs"), os.path.join(scratch, "logs")
    for _ in range(2):
        run_flow(spark, cfg, {"x": src}, out_dir=os.path.join(scratch, "out"), runs_table=runs,
                 logs_table=logs, observe_nodes=True, flow_id="p1")
    lines = spark.read.parquet(logs)
    assert {r["message"] for r in lines.where("node_id = 'f'").collect()} == {"5 items", "Filtered 10 -> 5 items"}
    assert run_log(lines).where("line = 1").count() == 2
    assert recent_runs(spark.read.parquet(runs), 1).count() == 1


def test_rss_output_node(spark, scratch):
    src = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "i int, title string")
    cfg = _cfg([
        {"id": "s", "type": "table-source", "config": {"table": "x", "order_by": "i"}},
        {"id": "r", "type": "rss-output", "config": {"title": "T"}},
        {"id": "w", "type": "webhook-output", "config": {"url": "file://" + os.path.join(scratch, "hook"),
                                                         "batch_size": 2}},
    ], [("s", "r"), ("s", "w")])
    res = run_flow(spark, cfg, {"x": src}, out_dir=os.path.join(scratch, "out"))
    assert res.sink_counts == {"r": 5, "w": 5} and res.items_processed == 10
    doc = spark.read.text(current_output(spark, os.path.join(scratch, "out", "r")), wholetext=True).first()["value"]
    assert doc.count("<item>") == 5 and "<title>T</title>" in doc
    assert spark.read.text(os.path.join(scratch, "hook")).count() == 3


def test_fan_out_cache_is_released(spark, scratch):
    src = spark.createDataFrame([(i,) for i in range(10)], "i int")
    cfg = _cfg([
        {"id": "s", "type": "table-source", "config": {"table": "x", "order_by": "i"}},
        {"id": "a", "type": "json-output", "config": {}},
        {"id": "b", "type": "json-output", "config": {}},
    ], [("s", "a"), ("s", "b")])
    res = run_flow(spark, cfg, {"x": src}, out_dir=os.path.join(scratch, "out"))
    assert res.sink_counts == {"a": 10, "b": 10}
    assert not res.outputs["s"].df.is_cached


def test_regex_node_logs_modified_count(spark, scratch):
    src = spark.createDataFrame([(1, "cat"), (2, "dog"), (3, "cart")], "i int, t string")
    cfg = _cfg([
        {"id": "s", "type": "table-source", "config": {"table": "x", "order_by": "i"}},
        {"id": "r", "type": "regex", "config": {"field": "t", "pattern": "ca", "replacement": "CA"}},
        {"id": "j", "type": "json-output", "config": {}},
    ], [("s", "r"), ("r", "j")])
    logs = os.path.join(scratch, "logs")
    run_flow(spark, cfg, {"x": src}, out_dir=os.path.join(scratch, "out"), logs_table=logs, observe_nodes=True)
    msgs = {r["message"] for r in spark.read.parquet(logs).where("node_id = 'r'").collect()}
    assert "Modified 2 of 3 items" in msgs


def _table_flow(sink, *mid, order_by="i"):
    nodes = [{"id": "s", "type": "table-source", "config": {"table": "x", "order_by": order_by}}, *mid, sink]
    return _cfg(nodes, [(a["id"], b["id"]) for a, b in zip(nodes, nodes[1:])])


NOTHING = {"id": "f", "type": "filter", "config": {"field": "t", "operator": "equals", "value": "no such"}}


def test_outputs_have_no_bound_and_keep_order(spark, scratch, monkeypatch):
    import sluice.sinks.documents as D
    from sluice.sinks.versions import VERSION_SCHEMA, latest_documents
    monkeypatch.setattr(D, "CHUNK_ITEMS", 7)
    src = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "i int, title string").repartition(5)
    table = os.path.join(scratch, "versions")
    for kind in ("json", "rss"):
        cfg = _table_flow({"id": "o", "type": f"{kind}-output", "config": {}})
        res = run_flow(spark, cfg, {"x": src}, out_dir=os.path.join(scratch, kind), versions_table=table)
        assert res.items_processed == 50
    saved = {r["format"]: r["content"] for r in
             latest_documents(spark.read.schema(VERSION_SCHEMA).parquet(table)).collect()}
    import json
    doc = json.loads(saved["json"])
    assert doc["count"] == 50 and [x["i"] for x in doc["items"]] == list(range(50))
    import re
    assert re.findall(r"<title>(t\d+)</title>", saved["rss"]) == [f"t{i}" for i in range(50)]
    assert saved["rss"].endswith("</rss>")
    folder = current_output(spark, os.path.join(scratch, "rss", "o"))
    parts = sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.startswith("part"))
    assert "".join(open(p).read() for p in parts) == saved["rss"] + "\n"


def test_empty_output_keeps_the_previous_one(spark, scratch):
    src = spark.createDataFrame([(1, "a")], "i int, t string")
    out, table = os.path.join(scratch, "out"), os.path.join(scratch, "versions")
    for kind in ("json", "rss"):
        sink = {"id": kind, "type": f"{kind}-output", "config": {}}
        run_flow(spark, _table_flow(sink), {"x": src}, out_dir=out, versions_table=table)
        before = spark.read.text(current_output(spark, os.path.join(out, kind))).collect()
        res = run_flow(spark, _table_flow(sink, NOTHING), {"x": src}, out_dir=out, versions_table=table)
        assert res.items_processed == 0
        assert spark.read.text(current_output(spark, os.path.join(out, kind))).collect() == before
    assert spark.read.parquet(table).count() == 2


def test_last_save_within_a_second_wins(spark, scratch):
    from sluice.sinks.versions import latest_documents, save_output
    table = os.path.join(scratch, "versions")
    for i in range(6):
        save_output(spark, table, "f", "json", spark.createDataFrame([(f"doc{i}",)], "document string"), "t", created_at=5)
    assert [r["content"] for r in latest_documents(spark.read.parquet(table)).collect()] == ["doc5"]


def test_node_counts_of_an_unordered_table(spark, scratch):
    src = spark.range(20_000).selectExpr("id as i", "concat('t', id) as title").repartition(8)
    for sink in ("json-output", "rss-output", "webhook-output"):
        cfg = _table_flow({"id": "o", "type": sink, "config": {"url": os.path.join(scratch, "hook")}}, order_by=None)
        res = run_flow(spark, cfg, {"x": src}, out_dir=os.path.join(scratch, sink), observe_nodes=True)
        assert res.node_counts == {"s": 20_000} and res.items_processed == 20_000


def test_feed_flow_items_have_the_feed_fields_only(spark, scratch):
    from test_sources import RSS
    payloads = spark.createDataFrame([("a", RSS)], "feed_url string, payload string")
    cfg = _cfg([{"id": "s", "type": "rss-source", "config": {"url": "u"}},
                {"id": "o", "type": "json-output", "config": {}}], [("s", "o")])
    run_flow(spark, cfg, {"u": payloads}, out_dir=scratch)
    import json
    keys = {k for r in spark.read.text(current_output(spark, os.path.join(scratch, "o"))).collect() for k in json.loads(r["value"])}
    assert keys <= {"title", "description", "content", "link", "author", "published", "published_at", "updated",
                    "updated_at", "guid", "categories", "enclosures", "image"}


def test_flow_without_a_sink_counts_its_last_node(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    cfg = _cfg([{"id": "s", "type": "table-source", "config": {"table": "x", "order_by": "i"}}], [])
    assert run_flow(spark, cfg, {"x": src}).items_processed == 2


def test_upstream_runs_once_for_a_json_output(spark, scratch):
    seen = spark.sparkContext.accumulator(0)
    from pyspark.sql import functions as F

    def count(x):
        seen.add(1)
        return x
    src = spark.createDataFrame([(i, "a") for i in range(100)], "i int, t string") \
        .withColumn("u", F.udf(count, "string")("t"))
    run_flow(spark, _table_flow({"id": "o", "type": "json-output", "config": {}}), {"x": src}, out_dir=scratch)
    assert seen.value == 100
