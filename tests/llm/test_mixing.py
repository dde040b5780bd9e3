import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import mixing as M


def test_rake_meets_the_marginals():
    rng = np.random.default_rng(3)
    cells = [(a, b, c) for a in "xyz" for b in "pq" for c in "uv"]
    tokens = rng.uniform(500, 1500, len(cells))
    targets = [{"x": 0.5, "y": 0.3, "z": 0.2}, {"p": 0.6, "q": 0.4}, {"u": 0.5, "v": 0.5}]
    w = M.rake(cells, tokens, targets, 0.4, rounds=200)
    assert w.sum() == pytest.approx(0.4 * tokens.sum(), rel=1e-6) and (w <= tokens + 1e-9).all()
    for d, t in enumerate(targets):
        for v, share in t.items():
            assert sum(x for c, x in zip(cells, w) if c[d] == v) / w.sum() == pytest.approx(share, rel=1e-4)


def test_a_target_beyond_the_tokens_takes_the_whole_cell():
    w = M.rake([("a",), ("b",)], np.array([10.0, 1000.0]), [{"a": 0.5, "b": 0.5}], 0.5)
    assert w[0] == 10.0 and w[1] <= 1000.0


def marked(spark, docs, targets, budget=0.5, **options):
    dims = {d: F.col(d) for d in targets}
    return M.with_probabilities(docs, targets, dims, budget, **options)


def test_sampled_tokens_follow_the_targets(spark):
    docs = spark.range(20_000).selectExpr(
        "id as doc_id", "concat('w w w ', id) as text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source",
        "if(id % 7 < 5, 'en', 'de') as lang")
    targets = {"source": {"hot": 0.2, **{f"s{i}": 0.16 for i in range(5)}}, "lang": {"en": 0.5, "de": 0.5}}
    out = marked(spark, docs, targets, 0.3)
    for d, t in targets.items():
        got = {r["value"]: r["share"] for r in M.achieved(out, F.col(d)).collect()}
        for v, share in t.items():
            assert got[v] == pytest.approx(share, abs=0.02)
    kept = out.filter("kept").agg(F.sum("n_tokens")).first()[0]
    assert kept == pytest.approx(0.3 * 80_000, rel=0.03)


def test_edge_rows_and_clashing_names(spark):
    rows = [(1, "a b", "x", 9.0), (1, "a b", "x", 9.0), (None, None, None, 1.0), (2, "", "y", 2.0), (3, "w " * 50_000, "zz", 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, probability double")
    out = marked(spark, docs, {"source": {"x": 1.0, "y": 1.0}}).collect()
    assert len(out) == 5 and all(0 <= r["probability"] <= 1 for r in out)
    assert len({(r["probability"], r["kept"]) for r in out if r["doc_id"] == 1}) == 1
    assert sorted(r["n_tokens"] for r in out) == [0, 0, 2, 2, 50_000]
    sampled = M.sample(docs, {"source": {"x": 1.0}}, {"source": F.col("source")}, 1.0)
    assert sampled.columns == docs.columns and set(r["probability"] for r in sampled.collect()) <= {9.0, 1.0, 2.0, 3.0}
    assert marked(spark, docs.limit(0), {"source": {"x": 1.0}}).collect() == []
    wide = {"source": {str(i): 1 for i in range(2000)}, "text": {str(i): 1 for i in range(2000)}}
    assert len(marked(spark, docs, wide).collect()) == 5  # only cells that occur count


def test_many_cells_are_raked_as_a_table(spark):
    docs = spark.range(3_000).selectExpr(
        "id as doc_id", "repeat('w ', cast(1 + id % 11 as int)) as text", "concat('s', id % 13) as source",
        "if(id % 7 < 5, 'en', if(id % 2 = 0, 'de', null)) as lang")
    targets = {"source": {f"s{i}": 1 / 12 for i in range(12)}, "lang": {"en": 0.65, "de": 0.35}}
    few, many = marked(spark, docs, targets, 0.3), marked(spark, docs, targets, 0.3, max_cells=1)
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    left = M.residuals(few, targets, {d: F.col(d) for d in targets}, 0.3).collect()
    assert {r["dimension"] for r in left} == {"source", "lang"} and len(left) == 16
    assert max(abs(r["residual"]) for r in left) < 1e-3
    empty = docs.limit(0)
    assert marked(spark, empty, targets, max_cells=0).collect() == []
    assert M.residuals(marked(spark, empty, targets), targets, {d: F.col(d) for d in targets}, 0.3).collect() == []
