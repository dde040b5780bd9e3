"""Run a flow description as a Spark job.

    python -m sluice run --config flow.json \\
        --source feeds=/landing/feeds/*.xml:documents --source users=/tables/users:parquet \\
        --out /outputs/flow-1 --runs /tables/runs --logs /tables/logs --flow flow-1

A source is ``name=path[:format]``: ``parquet`` (default) reads a table,
``documents`` reads landed documents one per file (``feed_url``,
``payload``). Outputs go under ``--out``; run records and log lines are
appended to the ``--runs``/``--logs`` tables when given. Under
``spark-submit``, submit a two-line script that calls ``sluice.__main__.main()``
with the package shipped via ``--py-files``.
"""

from __future__ import annotations

import argparse
import json
import sys


def _source(spark, spec: str):
    name, _, rest = spec.partition("=")
    path, fmt = rest, "parquet"
    head, sep, tail = rest.rpartition(":")
    if sep and tail in ("parquet", "documents"):
        path, fmt = head, tail
    if fmt == "documents":
        from .sources.files import landed_documents
        return name, landed_documents(spark, path)
    return name, spark.read.parquet(path)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="sluice")
    sub = ap.add_subparsers(dest="cmd", required=True)
    run = sub.add_parser("run", help="run a flow description once")
    run.add_argument("--config", required=True, help="flow description (JSON file)")
    run.add_argument("--source", action="append", default=[], help="name=path[:parquet|documents]")
    run.add_argument("--out", required=True, help="folder for the outputs")
    run.add_argument("--runs", help="run-record table (appended)")
    run.add_argument("--logs", help="run-log table (appended)")
    run.add_argument("--flow", default="flow", help="flow id recorded with the run")
    a = ap.parse_args(argv)

    from .plans.flow import run_flow
    from .session import get_session
    spark = get_session()
    with open(a.config, encoding="utf-8") as fh:
        config = json.load(fh)
    sources = dict(_source(spark, s) for s in a.source)
    res = run_flow(spark, config, sources, out_dir=a.out, runs_table=a.runs, logs_table=a.logs,
                   flow_id=a.flow, raise_errors=False, observe_nodes=bool(a.logs))
    print(json.dumps({"id": res.id, "status": res.status, "items_processed": res.items_processed,
                      "error": res.error_message}))
    return 0 if res.status == "success" else 1


if __name__ == "__main__":
    sys.exit(main())
