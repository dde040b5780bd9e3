"""Truncate and HTML strip: seeds plus a byte-level Python model on real documents."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, feed_of
from sluice.functions.text import strip_html
from sluice.operators.fields import truncate

GO_SPACE = "".join(chr(c) for c in [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                         0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def model_strip(s: str) -> str:
    out, in_tag = [], False
    for ch in s:
        if ch == "<":
            in_tag = True
        elif ch == ">":
            in_tag = False
        elif not in_tag:
            out.append(ch)
    return "".join(out).strip(GO_SPACE)


def model_truncate(s: str, n: int, suffix: str = "...") -> str:
    v = model_strip(s).encode("utf-8")
    if len(v) <= n:
        return v.decode("utf-8")
    cut = n
    idx = v[:n].rfind(b" ")
    if idx > n // 2:
        cut = idx
    head = v[:cut]
    # dangling bytes of a cut character render as U+FFFD each
    text = head.decode("utf-8", errors="ignore")
    k = len(head) - len(text.encode("utf-8"))
    if k:
        return text + "�" * k + suffix
    return text.strip(GO_SPACE) + suffix


@pytest.mark.parametrize("text,n,expected", [
    ("hello wonderful world", 10, "hello wond..."),
    ("hello wonderful world", 9, "hello..."),
    ("<p>ab</p>", 200, "ab"),
    ("a > b", 200, "a  b"),
    ("x <unclosed", 200, "x"),
    ("a<b<c>d", 200, "ad"),
    ("ééééé", 5, "éé�..."),
    ("  short  ", 200, "short"),
    ("abc", 0, "..."),
])
def test_truncate_seeds(spark, text, n, expected):
    f = feed_of(spark, [(1, text)], "i int, t string")
    assert truncate(f, "t", n).df.first()["t"] == expected


def test_truncate_custom_suffix_and_non_string(spark):
    f = feed_of(spark, [(1, "hello wonderful world", 5)], "i int, t string, n int")
    assert truncate(f, "t", 10, "~").df.first()["t"] == "hello wond~"
    assert truncate(f, "n", 1).df.first()["n"] == 5
    with pytest.raises(ValueError):
        truncate(f, "t", -1)


@pytest.mark.parametrize("n", [1, 7, 40, 120, 301])
def test_truncate_matches_byte_model_on_documents(spark, n):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    from sluice.feed import Feed
    got = {r["doc_id"]: r["text"] for r in truncate(Feed.from_table(docs, "doc_id"), "text", n).df.collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == model_truncate(r["text"], n), r["doc_id"]


def test_strip_matches_model_on_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    for r in pages.select("html", strip_html(F.col("html")).alias("s")).collect():
        assert r["s"] == model_strip(r["html"])
