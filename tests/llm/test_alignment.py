"""Alignment of two tokenizations, against a token-by-token version."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm.alignment import PreTokens, Vocabularies, align, align_documents
from sluice.llm.q_alignment import op12_cross_tokenizer_alignment
from sluice.llm.token_counts import byte_symbols

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_FILE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
PRE_TOKENS = PreTokens(A)
PARTS = [" ", "  ", "\n", " \n ", "\t", "a", "'s", "'ll", "12", "é", "日本", "😀", "<|endoftext|>", ".", "...", " the", "\xa0", "\u3000", "\x85", "_", "\u200d"]
VALUE = {s: b for b, s in enumerate(byte_symbols())}


def bytes_a(i):
    return bytes(VALUE[c] for c in A.id_to_token(i))


def bytes_b(i):
    return bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()


def plain(text):
    """Groups of (ids of A, ids of B) of one text."""
    a, b = (A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)) if text else ([], [])
    spelled = (b"".join(map(bytes_a, a)), b"".join(map(bytes_b, b)))
    if not text or spelled != ((" " + text).encode(),) * 2:
        return []
    groups, here, at_a, at_b = [], ([], []), 0, 0
    b = list(b)
    for i in a:
        here[0].append(i)
        at_a += len(bytes_a(i))
        while b and at_b < at_a and at_b + len(bytes_b(b[0])) <= at_a:
            at_b += len(bytes_b(b[0]))
            here[1].append(b.pop(0))
        if at_a == at_b:
            groups.append(here)
            here = ([], [])
    return groups


def brute(texts):
    """Rows as the query returns them, for (doc_id, text)."""
    aligned = [(k, plain(t)) for k, t in texts]
    count = Counter((a[-1], b[-1]) for _, groups in aligned for a, b in groups)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for k, groups in aligned:
        links = [(a[-1], b[-1]) for a, b in groups]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((k, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


EDGES = ["", None, " ", "  two  spaces", "a▁b is left out", "<|endoftext|> <s> x", "日本語 😀 \x00\n\n", "naïve café ß", "x" * 3000,
         "word " * 5000, "the same text", "the same text", "the same text", "  ", "﻿�"]


def test_edge_rows_and_clashing_columns(spark):
    rows = [(i, t, "x", i, "y") for i, t in enumerate(EDGES)] + [(None, "the same text", "x", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_sha256 string, copies long, links string").repartition(3)
    got = align_documents(docs, "doc_id", A_FILE, B_FILE)
    kept = [tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(kept, key=str) == brute([(r[0], r[1]) for r in rows])
    texts = {r["doc_id"]: r["groups"] for r in got.collect()}
    assert texts[4] == "" and texts[10] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain(EDGES[10]))
    assert align_documents(docs.limit(0), "doc_id", A_FILE, B_FILE).count() == 0


def test_pair_counts_weigh_copies(spark):
    docs = spark.createDataFrame([("one two",)] * 3 + [("two one",)], "text string")
    got = {(r["a_id"], r["b_id"]): r["n"] for r in align(docs, A_FILE, B_FILE).pairs.collect()}
    want = Counter((a[-1], b[-1]) for t in ["one two"] * 3 + ["two one"] for a, b in plain(t))
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=40), min_size=1, max_size=6))
def test_pre_tokens_one_by_one_are_the_librarys(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, counts = PRE_TOKENS.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [A.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_link_is_in_the_bounded_list():
    both = Vocabularies(open(A_FILE, "rb").read(), open(B_FILE, "rb").read())
    listed = set(zip(*(x.tolist() for x in both.pairs())))
    assert len(listed) <= sum(both.len_a) + sum(both.len_b)
    for t in filter(None, EDGES):
        assert {(a[-1], b[-1]) for a, b in plain(t)} <= listed


@pytest.mark.parametrize("chars", [200, 1_000_000])
def test_query_equals_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr("sluice.llm.alignment.RUN_CHARS", chars)
    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in op12_cross_tokenizer_alignment(spark, sf).collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).collect()
    assert sorted(got, key=str) == brute([tuple(r) for r in docs])
