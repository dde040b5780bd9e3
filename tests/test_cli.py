"""The job entry point, run as its own process (as spark-submit would)."""

import json
import os
import subprocess
import sys

from conftest import SF_SMALL

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_run_flow_job(tmp_path):
    cfg = {"nodes": [
        {"id": "docs", "type": "table-source", "config": {"table": "documents", "order_by": "doc_id"}},
        {"id": "f", "type": "filter", "config": {"field": "lang", "operator": "equals", "value": "en"}},
        {"id": "l", "type": "limit", "config": {"count": 5}},
        {"id": "out", "type": "json-output", "config": {}}],
        "connections": [{"source": "docs", "target": "f"}, {"source": "f", "target": "l"},
                        {"source": "l", "target": "out"}]}
    (tmp_path / "flow.json").write_text(json.dumps(cfg))
    out, runs = tmp_path / "out", tmp_path / "runs"
    env = dict(os.environ, SLUICE_SCRATCH=str(tmp_path))
    proc = subprocess.run(
        [sys.executable, "-m", "sluice", "run", "--config", str(tmp_path / "flow.json"),
         "--source", f"documents={SF_SMALL}/documents.parquet", "--out", str(out), "--runs", str(runs),
         "--flow", "docs-en"],
        cwd=REPO, env=env, capture_output=True, text=True, timeout=300)
    assert proc.returncode == 0, proc.stderr[-2000:]
    result = json.loads(proc.stdout.strip().splitlines()[-1])
    assert result["status"] == "success" and result["items_processed"] == 5
    lines = [json.loads(x) for f in sorted((out / "out" / "_versions").glob("*/part-*")) for x in f.read_text().splitlines()]
    assert len(lines) == 5 and all(d["lang"] == "en" for d in lines)
    assert [d["doc_id"] for d in lines] == sorted(d["doc_id"] for d in lines)
