import random

import numpy as np
import pytest

from sluice.llm import toxicity as T
from sluice.llm.catalog import QUERIES


def logits_by_pairs(m, terms):
    """Every pair of terms, one by one."""
    rows = [m.slot[t] for t in terms if m.slot[t] >= 0]
    total = m.bias + sum(m.w[r] for r in rows)
    return total + sum(float(m.v[a] @ m.v[b]) for i, a in enumerate(rows) for b in rows[i + 1:])


def corpus(n, seed):
    """Toxic = an insult and a group mention together; either alone is clean."""
    rng = random.Random(seed)
    filler = [f"filler{i}" for i in range(200)]
    texts, labels = [], []
    for _ in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(filler, 12) + ["vermin"] * insult + ["neighbours"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(insult and group))
    return texts, np.array(labels)


def accuracy(m, texts, labels):
    docs = [m.slot[T.text_terms(t)] for t in texts]
    docs = [d[d >= 0].astype(np.int64) for d in docs]
    p = T.sigmoid(m.logits(np.concatenate(docs), np.array([len(d) for d in docs])))
    return ((p >= 0.5) == (labels == 1)).mean(), p[labels == 1].min() - p[labels == 0].max()


def test_pairs_are_learned_that_a_linear_model_cannot_separate_as_widely():
    texts, labels = corpus(1200, 1)
    held, held_labels = corpus(400, 2)
    m = T.fit([T.text_terms(t) for t in texts], labels, labels.mean())
    acc, _ = accuracy(m, held, held_labels)
    assert acc >= 0.97
    rows = [m.slot[T.text_terms(w)].max() for w in ("vermin", "neighbours")]
    assert float(m.v[rows[0]] @ m.v[rows[1]]) > 0


def test_fast_logits_equal_pairwise_sum():
    texts, labels = corpus(300, 3)
    m = T.fit([T.text_terms(t) for t in texts], labels, labels.mean(), rounds=30)
    for t in texts[:20]:
        terms = T.text_terms(t)
        rows = m.slot[terms]
        rows = rows[rows >= 0].astype(np.int64)
        assert m.logits(rows, np.array([len(rows)]))[0] == pytest.approx(logits_by_pairs(m, terms), abs=1e-5)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "bad vermin neighbours", "x"), (2, None, "x"), (3, "", "y"), (None, "vermin", "z"),
                                  (1, "bad vermin neighbours", "x"), (5, "w " * 50_000, "q")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    m = T.fit_machine(docs, labels)
    rows = docs.select("doc_id", "text", T.scorer(spark, m)(docs["text"]).alias("p")).collect()
    assert len(rows) == 6 and all(0 <= r["p"] <= 1 for r in rows)
    assert len({r["p"] for r in rows if not r["text"]}) == 1
    only = T.fit_machine(docs, labels.limit(0))
    assert {round(r[0], 6) for r in docs.select(T.scorer(spark, only)(docs["text"])).collect()} == {0.5}
    empty = docs.limit(0)
    assert empty.select(T.scorer(spark, m)(empty["text"])).collect() == []


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op9_factorization_machine_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit / sum(r["predicted"] for r in rows) > 0.9
    assert hit / sum(r["toxic"] for r in rows) > 0.8
