"""Agenda encoding and decoding, against the sentencepiece library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm.q_pieces import op13_agenda_pieces
from sluice.llm.sentence_pieces import PieceCoder, SentencePieces, merge_vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODER = PieceCoder(MODEL, "")
PARTS = ["a", "e", "th", "ing", "▁", " ", "  ", "     ", "\n", "\t", "\x00", "é", "é", "日", "日本", "😀", "<s>", "</s>",
         "<0x0A>", "<unk>", "0", "12", "\xa0", "　", "﻿", "�", "the", "Hello", "."]


def encoded(coder, texts):
    ids, counts, _ = coder.encode(texts)
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=60), min_size=1, max_size=8))
def test_ids_and_texts_are_the_librarys(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    want = LIBRARY.encode(texts)
    assert encoded(CODER, texts) == want
    assert [CODER.decode(np.array(i, dtype=np.int32)) for i in want] == [LIBRARY.decode(i) for i in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0, 1, 2, 3, 35, 200, 228, 229, 255, 259, 264, 28705]), st.integers(0, 31999)), max_size=10))
def test_any_ids_decode_as_in_the_library(ids):
    assert CODER.decode(np.array(ids, dtype=np.int32)) == LIBRARY.decode(ids)


def test_long_segments_by_heap_and_short_ones_by_arrays_agree():
    for text in ("abc" * 5_000, "日本語のテキスト" * 300, "▁" * 777, "x" * 49, "thethe" * 8):
        assert encoded(CODER, [text]) == [LIBRARY.encode(text)]
        segment = "▁" + text[:40].replace("▁", "a")
        flat, counts = CODER.merged_many([segment])
        assert flat.tolist() == CODER.merged(segment) and counts.tolist() == [len(flat)]


def test_a_full_memo_starts_again(monkeypatch):
    monkeypatch.setattr("sluice.llm.sentence_pieces.MEMO_IDS", 50)
    coder = PieceCoder(MODEL, "segments")
    texts = [f"word{i} and the other{i} words" for i in range(40)]
    for t in texts:
        ids, _, agrees = coder.encode([t, "the end"])
        assert ids.tolist() == LIBRARY.encode(t) + LIBRARY.encode("the end") and agrees.all()


@pytest.mark.parametrize("check", ["texts", "segments"])
def test_a_wrong_merge_is_noticed(check):
    coder = PieceCoder(MODEL, check)
    coder.ranks = coder.ranks.max() - coder.ranks
    _, _, agrees = coder.encode(["", "a", "internationalization of understanding"])
    assert agrees.tolist() == [True, True, False]


def test_other_vocabularies_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    proto.ParseFromString(MODEL)
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError):
        merge_vocabulary(proto.SerializeToString())


def test_column_functions_and_edge_rows(spark):
    texts = [None, "", " ", "  two  spaces ", "long " * 30_000, "same", "same", "日本 <s> \x00"]
    rows = [(i, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k long, text string, ids long").repartition(3)
    pieces = SentencePieces(spark, PATH, "texts")
    both = df.select("k", pieces.round_trip(F.col("text")).alias("e")).select("k", "e.*").orderBy("k").collect()
    got = df.select("k", pieces.encode(F.col("text")).alias("e")) \
        .select("k", "e.*", pieces.decode(F.col("e.ids")).alias("back")).orderBy("k").collect()
    assert [r["ids"] for r in got] == [LIBRARY.encode(t or "") for t in texts]
    assert [r["back"] for r in got] == [t or "" for t in texts] and all(r["agrees"] for r in got)
    assert [(r["ids"], r["decoded"], r["agrees"]) for r in both] == [(r["ids"], r["back"], True) for r in got]
    none = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert {r[0] for r in none.select(pieces.decode(F.col("ids"))).collect()} == {None, ""}
    assert df.limit(0).select(pieces.encode(F.col("text"))).count() == 0


def test_query_is_the_librarys(spark):
    sf_small = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in op13_agenda_pieces(spark, sf_small).collect()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d["text"] or "")
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["agrees"]) == (
            len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)), True)
