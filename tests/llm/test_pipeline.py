import hashlib
import math
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from test_decontaminate import brute  # noqa: E402
from test_near_dedup import brute_classes  # noqa: E402

from sluice.llm.q_mixing import BUDGET, TARGETS  # noqa: E402
from sluice.llm.q_sharding import TOPOLOGY  # noqa: E402
from sluice.llm.sharding import children  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def base_kept(text):
    """The base rule; with so few labels no cutoff can be proven, so it is all that rejects."""
    words = (text or "").split()
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    return len(words) >= 10 and 100 * len(covered) <= 20 * len(words)


def topic(text):
    if "icense" in text or "opyright" in text:
        return "legal"
    if "@" in text or "://" in text:
        return "contact"
    return "table" if " | " in text else "prose"


def u52(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def mixed(rows):
    cells = [tuple(v if v in t else "other" for v, t in zip((r["source"], r["lang"], topic(r["text"])), TARGETS.values()))
             for r in rows]
    tokens = Counter()
    for c, r in zip(cells, rows):
        tokens[c] += len(r["text"].split())
    total = sum(tokens.values())
    weight = {c: n * BUDGET for c, n in tokens.items()}
    for _ in range(25):
        for d, target in enumerate(TARGETS.values()):
            have, out = Counter(), Counter()
            for c, w in weight.items():
                have[c[d]] += w
                out[c[d]] += tokens[c]
            rest = 1 - out["other"] / total
            named = sum(target[v] for v in out if v in target)
            goal = {v: BUDGET * total * (rest * target[v] / named if v in target else 1 - rest) for v in out}
            weight = {c: min(tokens[c], w * goal[c[d]] / have[c[d]] if have[c[d]] else 0) for c, w in weight.items()}
    p = {c: round(w / tokens[c], 6) if tokens[c] else BUDGET for c, w in weight.items()}
    return [r for c, r in zip(cells, rows) if u52(f"{r['doc_id']}|mix") / 2 ** 52 < p[c]]


def placed(doc_id):
    tree, path = children(TOPOLOGY), ""
    out = []
    for _ in range(3):
        draw = lambda c: (-math.log((u52(f"{doc_id}|shard|{c['p']}") + 0.5) / 2 ** 52) / c["w"], c["i"])
        best = min(tree[path], key=draw)
        path = best["p"]
        out.append(best["i"])
    return out


def test_pipeline_matches_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if base_kept(r["text"])]
    classes = brute_classes([(r["doc_id"], r["text"]) for r in rows])
    first = {c for _, c, _ in classes}
    rows = [r for r in rows if r["doc_id"] in first]
    held = {n for n, _ in brute([(r["doc_id"], r["text"]) for r in rows], items)}
    rows = mixed([r for n, r in enumerate(rows) if n not in held])
    want = sorted(tuple(r[c] for c in COLUMNS) + tuple(placed(r["doc_id"])) for r in rows)
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == COLUMNS + ["region", "rack", "shard"]
    assert sorted(tuple(r) for r in out.collect()) == want
    assert 30 < len(want) < 200


def test_stages_keep_the_columns_and_take_edge_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, kept string, __p double"
    rows = [(1, "a b c d e f g h i j k l", "en", "src0", 3, 9, "x", 0.5), (1, "a b c d e f g h i j k l", "en", "src0", 3, 9, "x", 0.5),
            (None, None, None, None, None, None, None, None), (3, "", "xx", "weird", 0, 1, "", 0.0),
            (None, "w" * 100_000 + " b c d e f g h i j k", "de", None, 1, 1, "y", 1.0)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            assert len(got) <= len(data)
            if name != "sharding":
                assert out.schema == docs.schema or out.columns == docs.columns


def test_queries_are_registered():
    import __spark_entry__ as e
    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.parametrize("target,tokens", [({"a": 0.5, "b": 0.5}, {"a": 10.0, "other": 10.0})])
def test_goals_share_out_what_is_absent(target, tokens):
    from sluice.llm.mixing import goals
    assert goals(tokens, target, 10.0) == {"a": 5.0, "other": 5.0}
