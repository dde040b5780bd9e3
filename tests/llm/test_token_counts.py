import json
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from sluice.llm.token_counts import Counter, MergeTable, token_counter  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return Counter(MergeTable(json.load(f)))


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_edge_texts(library, counter):
    texts = ["", " ", "\n", "  \n\t x", "a", "aaaa", "a" * 2000, "ab" * 999, "<|endoftext|>", "x<|endoftext|><|endoftext|> y",
             "<|endoftext", "don't we'll I'M", "été  ü\x85z", "\x1c\x1d a\x1fb", "日本語テキスト😀😀", "\x00\x01", "1234567 12 ½ ²"]
    assert counter.count(texts) == expected(library, texts)


def test_random_texts(library, counter):
    rng = random.Random(5)
    pool = ["the", " the", "ing", "tion", " ", "  ", "\n", "é", "ñ", "'s", "'", "12", "!!", "***", "😀", "　", "\x1d", "A", "zq"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["".join(chr(rng.randrange(1, 0x2FF)) for _ in range(40)) for _ in range(300)]
    assert counter.count(texts) == expected(library, texts)


def test_memo_is_bounded(monkeypatch, library, counter):
    import sluice.llm.token_counts as m
    monkeypatch.setattr(m, "MEMO", 10)
    monkeypatch.setattr(m, "RUN_CHARS", 50)
    texts = [f"word{i} and{i * 7} more" for i in range(100)]
    assert counter.count(texts) == expected(library, texts)


def test_long_pretoken(library, counter):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij") for _ in range(20_000))
    assert counter.count([text]) == expected(library, [text])


def test_documents_match_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: r[1] for r in docs.select("doc_id", token_counter(spark, PATH)(docs["text"]).alias("n")).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert [got[r[0]] for r in rows] == expected(library, [r[1] or "" for r in rows])


def test_nulls_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "a b", 2), (1, "a b", 2)], "doc_id long, text string, n_tokens int")
    rows = df.select("*", token_counter(spark, PATH)(df["text"]).alias("count")).collect()
    assert sorted(r["count"] for r in rows) == [0, 2, 2]
    none = df.limit(0)
    assert none.select(token_counter(spark, PATH)(none["text"])).collect() == []


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        MergeTable(json.load(f))
