import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.llm import lm_scoring as L
from sluice.llm.catalog import QUERIES


class Trie:
    """PPM with method C escapes and exclusion, one byte at a time."""

    def __init__(self, texts, order):
        self.order, self.next = order, defaultdict(Counter)
        for t in texts:
            s = b"\0" * order + t + b"\0"
            for i in range(order, len(s)):
                for d in range(order + 1):
                    self.next[s[i - d:i]][s[i]] += 1

    def score(self, text):
        s, total = b"\0" * self.order + text + b"\0", 0.0
        for i in range(self.order, len(s)):
            out = set()
            for d in range(self.order, -1, -1):
                seen = {b: c for b, c in self.next.get(s[i - d:i], {}).items() if b not in out}
                n, q = sum(seen.values()), len(seen)
                if s[i] in seen:
                    total += math.log10(seen[s[i]] / (n + q))
                    break
                if q:
                    total += math.log10(q / (n + q))
                out |= set(self.next.get(s[i - d:i], {}))
            else:
                total += math.log10(1 / (256 - len(out)))
        return total


def base(rows):
    taught = Counter(w for t, l in rows if l for w in t.split() + [None])
    n, v = sum(taught.values()), len(taught)
    score = lambda t: sum(math.log10((taught[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t.split() + [None])
    return n, taught, score


def lower(text):
    return (text or "").encode().lower()


def check(rows, scored, order):
    texts = [(lower(t), bool(l)) for _, t, l in rows]
    trie = Trie([t for t, l in texts if l], order)
    n, taught, word_score = base(texts)
    want = sorted((k is None, k or 0, len(t.split()) + 1, sum(taught[w] > 0 for w in t.split() + [None]), n,
                   round(word_score(t), 6), round(trie.score(t), 6)) for (k, _, _), (t, _) in zip(rows, texts))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"],
                  round(r["base_score"], 6), round(r["score"], 6)) for r in scored)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], abs=2e-5)


@pytest.mark.parametrize("order", [2, 4])
def test_scores_match_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(L, "BLOCK", 400)
    monkeypatch.setattr(L, "SLICE", 97)
    rows = [(i, t, i % 5 != 1) for i, t in enumerate(
        ["the cat sat on the mat", "The CAT ran", "", None, "ééé ñ 日本", "the mat\nthe mat", "a" * 300, "zq xj",
         "the cat sat on the mat", " \t\x0b ", "the\x00cat", "end"])] + [(None, "null id", False), (3, "again", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)
    check(rows, L.score_texts(df, F.col("learn"), order=order).collect(), order)


def test_no_learning_documents_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in L.score_texts(df, F.lit(False)).collect()}
    assert rows[1]["score"] == pytest.approx(3 * math.log10(1 / 256)) and rows[1]["train_tokens"] == 0
    assert rows[2]["n_tokens"] == 1
    assert L.score_texts(df.limit(0), F.lit(True)).collect() == []


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [(k, t, zlib.crc32(str(k).encode()) % 5 != 1) for k, t in docs]
    out = QUERIES["op6_ppm_scores"](spark, sf).collect()
    check(rows, out, L.ORDER)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in out)
