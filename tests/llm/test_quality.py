import random
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from sluice.llm import quality as Q


def brute(text):
    t = text or ""
    import re
    words = re.findall(r"[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
            "n_capitals": sum(c.isupper() for c in t)}


def test_measures_match_brute_force(spark):
    rng = random.Random(4)
    pool = ["a", "b", "cc", "Été", "###", "x|y", "\n", "\n\n", " ", "\t", "\x0b", "\x0c", "\r", "😀", " ", "\x1f"]
    texts = ["", None, " \n ", "one", "a b c d e", "a a a a a a a a", "a b c d e a b c d e", "x\nx\n x\nx"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(150)]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += ["word " * 30_000, " ".join(f"w{i}" for i in range(20_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in Q.with_measures(df, "text").collect():
        want = brute(texts[r["i"]])
        assert {k: r[k] for k in want} == want, texts[r["i"]]


@pytest.mark.parametrize("n,k", [(1, 0), (30, 0), (300, 1), (500, 2), (1000, 9), (5000, 30), (20, 5)])
def test_binomial_tail_is_exact(spark, n, k):
    p = 0.01
    got = spark.range(1).select(Q.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
    want = sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
    assert got == pytest.approx(want, rel=1e-9)


def corpus(spark, n, noise, seed=1):
    """Good texts hold few symbols, bad ones many; ``noise`` of the good look bad."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        share = 0.4 if not good or rng.random() < noise else 0.0
        words = [f"word{rng.randrange(10 ** 6)}" + ("###" if rng.random() < share else "") for _ in range(30)]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), \
        spark.createDataFrame(labels, "doc_id long, quality int")


def test_false_rejection_stays_below_the_risk(spark):
    docs, labels = corpus(spark, 4000, 0.002)
    out = Q.judge(docs, labels).join(labels, "doc_id").select("m_kept", "quality").collect()
    good = [r["m_kept"] for r in out if r["quality"]]
    bad = [r["m_kept"] for r in out if not r["quality"]]
    assert good.count(False) / len(good) <= 0.05
    assert bad.count(False) / len(bad) > 0.9


def test_without_evidence_nothing_is_rejected(spark):
    docs, labels = corpus(spark, 300, 0.0)          # too few labels for the exact bound
    assert all(r["m_kept"] for r in Q.judge(docs, labels).collect())
    docs, labels = corpus(spark, 4000, 0.3)         # a rule that would reject 30 % of the good
    out = Q.judge(docs, labels).join(labels, "doc_id").filter("quality = 1")
    assert out.filter("not m_kept").count() / out.count() <= 0.05
    assert all(r["m_kept"] for r in Q.judge(docs, labels.limit(0)).collect())


def test_copies_count_once_and_edge_rows(spark):
    text = " ".join(f"w{i}###" for i in range(20))
    rows = [(i, text, "en", 1.0) for i in range(50)] + [(None, None, None, None), (99, "", "xx", 0.0), (99, "", "xx", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, m_kept double")
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    p = Q.Policy()
    measured = Q.with_measures(docs.filter("doc_id < 50"), "text", "m_").withColumns(
        {"stratum": Q.stratum_of(F.col("lang"), p), "good": F.lit(1)}).dropDuplicates(["text"])
    assert {r["n"] for r in Q.choose_cutoffs(measured, p, "m_").collect()} == {1}
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 50
    assert Q.keep_good(docs.limit(0), labels).collect() == []
    found = {(r["lang"], r["q_stratum"]) for r in Q.judge(docs, labels, prefix="q_").collect()}
    assert found == {("en", "en"), (None, "other"), ("xx", "other")}


def test_added_columns_replace_those_of_the_same_name(spark):
    docs, labels = corpus(spark, 60, 0.1)
    clash = docs.selectExpr("*", "'x' as m_kept", "'y' as m_n_words", "'z' as m_digest")
    plain = {r["doc_id"]: r["m_kept"] for r in Q.judge(docs, labels).collect()}
    out = Q.judge(clash, labels)
    assert len(set(out.columns)) == len(out.columns) and "m_digest" in out.columns
    assert {r["doc_id"]: r["m_kept"] for r in out.collect()} == plain
    assert Q.keep_good(clash, labels).columns == clash.columns
