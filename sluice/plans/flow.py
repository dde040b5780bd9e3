"""Flow composer (C1-C5): a JSON description of nodes and connections ->
composed DataFrames; Catalyst plans it, each sink is one Spark action.

    {"nodes": [{"id": "a", "type": "table-source", "config": {...}}, ...],
     "connections": [{"source": "a", "target": "b"}, ...]}

Node types: ``rss-source http-source table-source filter sort limit merge
map regex truncate json-output rss-output webhook-output`` and any type
added with ``register``. Sources read landed payload tables (or any
DataFrame) handed in as ``sources``: HTTP fetching is not part of the
engine. Validation: duplicate ids, connections to unknown nodes, cycles
and unknown types are errors. Every node runs once; its result feeds all
successors (fan-out) -- a result used more than once is persisted.
"""

from __future__ import annotations

import graphlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..feed import Feed
from ..operators.fields import map_fields, regex_replace, truncate
from ..operators.filter import filter_items
from ..operators.limit import limit_items
from ..operators.merge import merge
from ..operators.sort import sort_items
from ..sinks.documents import (JSON_CONTENT_TYPE, RSS_CONTENT_TYPE, Staged, document_text, item_json, json_document,
                               rss_chunks, webhook_batches, write_chunks, write_lines)
from ..sources.feed_source import feed_items
from ..sources.json_source import headers_from_text, json_items


class FlowError(ValueError):
    pass


@dataclass
class Context:
    spark: SparkSession
    sources: dict[str, DataFrame]
    out_dir: str | None = None
    versions_table: str | None = None
    flow_id: str = "flow"
    logs: list[dict] = field(default_factory=list)
    sink_counts: dict[str, int] = field(default_factory=dict)
    node_id: str = ""
    observe: bool = False
    modified: dict[str, Observation] = field(default_factory=dict)

    def log(self, level: str, message: str) -> None:
        self.logs.append({"node_id": self.node_id, "level": level, "message": message,
                          "timestamp": int(time.time()), "seq": len(self.logs)})


NodeFn = Callable[[list[Feed], dict, Context], Feed | None]
REGISTRY: dict[str, NodeFn] = {}


def register(type_name: str, fn: NodeFn) -> None:
    """C4: add a node type (the only extension point)."""
    REGISTRY[type_name] = fn


def _first(inputs: list[Feed]) -> Feed | None:
    return inputs[0] if inputs else None


def _source_table(ctx: Context, key: str) -> DataFrame:
    if not key:
        raise FlowError("a source needs a url")
    if key not in ctx.sources:
        raise FlowError(f"no landed payloads for {key!r}")
    return ctx.sources[key]


def _rss_source(inputs, cfg, ctx):
    payloads = _source_table(ctx, cfg.get("url", ""))
    return feed_items(payloads, limit=cfg.get("limit"), keep=[], on_error=cfg.get("on_error") or "fail")


def _http_source(inputs, cfg, ctx):
    payloads = _source_table(ctx, cfg.get("url", ""))
    return json_items(payloads, items_path=cfg.get("items_path", ""), schema=cfg.get("schema"),
                      limit=cfg.get("limit"))


def _table_source(inputs, cfg, ctx):
    return Feed.from_table(_source_table(ctx, cfg.get("table", "")), cfg.get("order_by"))


def _filter(inputs, cfg, ctx):
    f = _first(inputs)
    return None if f is None else filter_items(f, cfg.get("field", "") or "", cfg.get("operator", "") or "",
                                               cfg.get("value", "") or "", ctx.spark)


def _sort(inputs, cfg, ctx):
    f = _first(inputs)
    return None if f is None else sort_items(f, cfg.get("field", "") or "", cfg.get("order", "") or "")


def _limit(inputs, cfg, ctx):
    f = _first(inputs)
    return None if f is None else limit_items(f, cfg.get("count"))


def _merge(inputs, cfg, ctx):
    live = [f for f in inputs if f is not None]
    if not live:
        return None
    return merge(live, cfg.get("dedupe_field", "") or "", cfg.get("sort_field", "") or "",
                 cfg.get("sort_order", "") or "")


def _map(inputs, cfg, ctx):
    f = _first(inputs)
    keep = cfg.get("keep_original")
    return None if f is None else map_fields(f, cfg.get("mappings", "") or "", keep is True)


def _regex(inputs, cfg, ctx):
    f = _first(inputs)
    if f is None:
        return None
    field = cfg.get("field", "") or ""
    out = regex_replace(f, field, cfg.get("pattern", "") or "", cfg.get("replacement", "") or "", ctx.spark)
    if ctx.observe and out is not f and field in f.item_columns:
        # count the values the replacement changed (for the run log)
        from ..feed import col, fresh
        old = fresh("old")
        before = f.df.withColumn(old, col(field))
        after = regex_replace(Feed(before, f.ordering), field, cfg.get("pattern", "") or "",
                              cfg.get("replacement", "") or "", ctx.spark)
        obs = Observation(fresh("modified"))
        changed = F.sum(F.when(~col(field).eqNullSafe(col(old)), 1).otherwise(0)).alias("m")
        ctx.modified[ctx.node_id] = obs
        out = after.with_df(after.df.observe(obs, changed).drop(old))
    return out


def _truncate(inputs, cfg, ctx):
    f = _first(inputs)
    ml = cfg.get("max_length", 200)
    return None if f is None else truncate(f, cfg.get("field", "") or "", ml, cfg.get("suffix", "") or "")


def _save(ctx: Context, fmt: str, chunks: DataFrame, ctype: str) -> None:
    if ctx.versions_table:
        from ..sinks.versions import save_output
        save_output(ctx.spark, ctx.versions_table, ctx.flow_id, fmt, chunks, ctype)


def _json_output(inputs, cfg, ctx):
    f = _first(inputs)
    if f is None:
        ctx.log("info", "nothing to write: no input")
        return None
    # both forms come from one staged copy: the inputs run once
    texts = ({"line": item_json(f)} if ctx.out_dir else {}) | ({"document": document_text(f)} if ctx.versions_table else {})
    with Staged(f, texts or {"none": F.lit(None).cast("string")}, "json-output") as staged:
        n = None
        if ctx.versions_table:
            made = json_document(staged.text("document"))
            if made is not None:
                _save(ctx, "json", made[0], JSON_CONTENT_TYPE)
            n = made[1] if made is not None else 0
        if ctx.out_dir:
            n = write_lines(staged.text("line"), f"{ctx.out_dir}/{ctx.node_id}")
        ctx.sink_counts[ctx.node_id] = staged.feed.df.count() if n is None else n
    return f


def _rss_output(inputs, cfg, ctx):
    f = _first(inputs)
    if f is None:
        ctx.log("info", "nothing to write: no input")
        return None
    made = rss_chunks(f, cfg.get("title", "") or "", cfg.get("description", "") or "", cfg.get("link", "") or "")
    if made is None:
        ctx.log("info", "nothing to write: no items")   # earlier output stays
        ctx.sink_counts[ctx.node_id] = 0
        return f
    chunks, n = made
    if ctx.out_dir:
        write_chunks(chunks, f"{ctx.out_dir}/{ctx.node_id}")
    _save(ctx, "rss", chunks, RSS_CONTENT_TYPE)
    ctx.sink_counts[ctx.node_id] = n
    return f


def _webhook_output(inputs, cfg, ctx):
    from ..sinks.webhook import deliver
    f = _first(inputs)
    if f is None:
        ctx.log("info", "nothing to send: no input")
        return None
    url = cfg.get("url", "")
    if not url:
        raise FlowError("a webhook output needs a url")
    payloads, total = webhook_batches(f, int(cfg.get("batch_size", 1000)))
    deliver(payloads, url, headers_from_text(cfg.get("headers", "")), cfg.get("ledger") or None)
    ctx.sink_counts[ctx.node_id] = total
    return f


for _name, _fn in {
    "rss-source": _rss_source, "http-source": _http_source, "table-source": _table_source,
    "filter": _filter, "sort": _sort, "limit": _limit, "merge": _merge, "map": _map,
    "regex": _regex, "truncate": _truncate, "json-output": _json_output,
    "rss-output": _rss_output, "webhook-output": _webhook_output,
}.items():
    register(_name, _fn)

SINK_TYPES = {"json-output", "rss-output", "webhook-output"}
#: M4: node types that read their first input only.
SINGLE_INPUT = {"filter", "sort", "limit", "map", "regex", "truncate", *SINK_TYPES}


def validate(config: dict) -> list[str]:
    """Return the execution order or raise FlowError."""
    nodes = config.get("nodes") or []
    ids = [n.get("id") for n in nodes]
    if len(set(ids)) != len(ids):
        raise FlowError("duplicate node id")
    known = set(ids)
    for c in config.get("connections") or []:
        if c.get("source") not in known or c.get("target") not in known:
            raise FlowError(f"connection {c.get('id', '?')} refers to an unknown node")
    for n in nodes:
        if n.get("type") not in REGISTRY:
            raise FlowError(f"unknown node type: {n.get('type')}")
    ts = graphlib.TopologicalSorter({i: [] for i in ids})
    for c in config.get("connections") or []:
        ts.add(c["target"], c["source"])
    try:
        return list(ts.static_order())
    except graphlib.CycleError as e:
        raise FlowError("flow contains a cycle") from e


# The per-node log messages of a run (by node type).
NODE_MESSAGES = {
    "rss-source": "Retrieved {n_out} items",
    "http-source": "Retrieved {n_out} items",
    "filter": "Filtered {n_in} -> {n_out} items",
    "limit": "Limited {n_in} -> {n_out} items",
    "sort": "Sorted {n_out} items by {field} ({order})",
    "merge": "Merged {inputs} inputs into {n_out} items",
    "map": "Mapped {n_out} items",
    "truncate": "Truncated {n_out} items",
    "regex": "Modified {modified} of {n_out} items",
}


def node_messages(cfg: dict, counts: dict[str, int], ts: int,
                  modified: dict[str, int] | None = None) -> list[dict]:
    """Info lines from observed item counts (input = first incoming node,
    as single-input nodes read; a limit logs only when it cut items)."""
    conns = cfg.get("connections") or []
    out = []
    for node in cfg.get("nodes") or []:
        nid, kind = node.get("id"), node.get("type")
        if kind not in NODE_MESSAGES or nid not in counts:
            continue
        ins = [c["source"] for c in conns if c.get("target") == nid]
        n_in = counts.get(ins[0]) if ins else 0
        if kind == "limit" and (n_in is None or counts[nid] >= n_in):
            continue
        if kind == "regex" and nid not in (modified or {}):
            continue
        conf = node.get("config") or {}
        msg = NODE_MESSAGES[kind].format(n_in=n_in, n_out=counts[nid], inputs=len(ins),
                                         modified=(modified or {}).get(nid, 0),
                                         field=conf.get("field", ""), order=conf.get("order") or "desc")
        out.append(dict(node_id=nid, level="info", message=msg, timestamp=ts, seq=0))
    return out


@dataclass
class RunResult:
    id: str
    status: str
    items_processed: int
    outputs: dict[str, Feed | None]
    sink_counts: dict[str, int]
    logs: list[dict]
    error_message: str | None = None
    duration_ms: int = 0
    node_counts: dict[str, int] = field(default_factory=dict)


def _recorded(spark: SparkSession, path: str, key: str, run_id: str) -> bool:
    from ..session import path_exists
    return path_exists(spark, path) and not spark.read.parquet(path).where(F.col(key) == run_id).isEmpty()


def run_flow(spark: SparkSession, config: dict | str, sources: dict[str, DataFrame] | None = None,
             out_dir: str | None = None, versions_table: str | None = None, flow_id: str = "flow",
             runs_table: str | None = None, trigger: str = "manual", observe_nodes: bool = False,
             raise_errors: bool = True, logs_table: str | None = None, run_id: str | None = None) -> RunResult:
    """Run every node once in dependency order; sinks act. With a
    ``run_id`` of the caller's, a repeated run (a retried batch) leaves the
    record and log that the first attempt has written."""
    cfg = json.loads(config) if isinstance(config, str) else config
    repeated = run_id is not None
    run_id = run_id or str(uuid.uuid4())
    started = time.time()
    ctx = Context(spark, dict(sources or {}), out_dir, versions_table, flow_id, observe=observe_nodes)
    results: dict[str, Feed | None] = {}
    observations: dict[str, Observation] = {}
    persisted: list[Feed] = []
    error = None
    try:
        order = validate(cfg)
        nodes = {n["id"]: n for n in cfg.get("nodes") or []}
        conns = cfg.get("connections") or []
        fan_out = {}
        for c in conns:
            fan_out[c["source"]] = fan_out.get(c["source"], 0) + 1
        for node_id in order:
            node = nodes[node_id]
            ctx.node_id = node_id
            inputs = [results[c["source"]] for c in conns if c["target"] == node_id and c["source"] in results]
            if len(inputs) > 1 and node["type"] in SINGLE_INPUT:
                ctx.log("warn", f"{len(inputs)} inputs are connected; a {node['type']} node reads the first one only")
            try:
                out = REGISTRY[node["type"]](inputs, node.get("config") or {}, ctx)
            except Exception as ex:
                ctx.log("error", f"node failed: {ex}")
                raise FlowError(f"node {node_id} ({node['type']}): {ex}") from ex
            if out is not None and observe_nodes and node["type"] not in SINK_TYPES:
                obs = Observation(f"n_{node_id}_{run_id[:8]}")
                out = out.with_df(out.df.observe(obs, F.count(F.lit(1)).alias("n")))
                observations[node_id] = obs
            if out is not None and fan_out.get(node_id, 0) > 1 and node["type"] not in SINK_TYPES:
                out = out.persist()
                persisted.append(out)
            results[node_id] = out
    except Exception as ex:  # C3: first failure fails the run
        error = str(ex)
        if raise_errors and not runs_table:
            raise
    finally:
        # fan-out copies served their sinks; release executor memory (the
        # returned feeds stay usable and recompute on demand)
        for f in persisted:
            f.df.unpersist()
    done = time.time()
    status = "failed" if error else "success"
    items = sum(ctx.sink_counts.values())
    if not error and not ctx.sink_counts and results:
        last = results[order[-1]]  # a flow without a sink has processed what its last node holds
        items = last.df.count() if last is not None else 0
    node_counts = {}
    if observations and not error:
        for k, o in observations.items():
            try:
                node_counts[k] = int(o.get["n"])
            except Exception:  # noqa: BLE001 - node not on any executed path
                pass
    res = RunResult(run_id, status, items, results, ctx.sink_counts, ctx.logs, error,
                    int((done - started) * 1000), node_counts)
    if logs_table and not (repeated and _recorded(spark, logs_table, "execution_id", run_id)):
        # One line per node count (from observations), the per-node
        # messages, and the nodes' own messages
        lines = [dict(node_id=k, level="data", message=f"{v} items", timestamp=int(done), seq=0)
                 for k, v in sorted(node_counts.items())]
        modified = {}
        for k, o in ctx.modified.items():
            try:
                modified[k] = int(o.get["m"] or 0)
            except Exception:  # noqa: BLE001 - node not on any executed path
                pass
        lines += node_messages(cfg, node_counts, int(done), modified) + ctx.logs
        rows = [(str(uuid.uuid4()), run_id, ln["node_id"], ln["level"], ln["message"], ln["timestamp"], i)
                for i, ln in enumerate(lines)]
        if rows:
            from .history import LOG_SCHEMA
            spark.createDataFrame(rows, LOG_SCHEMA).write.mode("append").parquet(logs_table)
    if runs_table and repeated and _recorded(spark, runs_table, "id", run_id):
        runs_table = None
        if error and raise_errors:
            raise FlowError(error)
    if runs_table:
        row = [(run_id, flow_id, status, trigger, int(started), int(done), res.duration_ms, items, error)]
        from .history import RUN_SCHEMA
        spark.createDataFrame(row, RUN_SCHEMA).write.mode("append").parquet(runs_table)
        if error and raise_errors:
            raise FlowError(error)
    return res
