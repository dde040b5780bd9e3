"""Feed (RSS/Atom) and JSON sources on hand-made payloads (FIXTURES.md 1.2, 1.3)."""

import pytest
from pyspark.sql import functions as F

from sluice.functions.text import parse_feed_date
from sluice.sources.feed_source import feed_items, feed_summary
from sluice.sources.json_source import json_items

RSS = """<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"
     xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>T</title><link>http://x</link>
<item><title>A &amp; B</title><description>d</description><content:encoded><![CDATA[<p>hi</p>]]></content:encoded>
<dc:creator>Bob</dc:creator><guid isPermaLink="false">g</guid><category>c1</category>
<enclosure url="u" type="audio/mpeg" length="9"/><pubDate>Mon, 02 Jan 2006 15:04:05 GMT</pubDate></item>
<item><title/><description>only</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title type="html">E1</title>
<link href="http://e/1" rel="alternate"/><id>urn:1</id><updated>2006-01-02T15:04:05Z</updated>
<author><name>Al</name></author><category term="t1"/><summary>sum</summary></entry></feed>"""


def test_rss_and_atom_items(spark):
    payloads = spark.createDataFrame([("a", RSS), ("b", ATOM)], "feed_url string, payload string")
    f = feed_items(payloads)
    rows = f.ordered().collect()
    assert [r["title"] for r in rows] == ["A & B", "", "E1"]
    r0, r1, r2 = rows
    assert r0["content"] == "<p>hi</p>" and r0["description"] == "d"
    assert r0["author"] == "Bob" and r0["guid"] == "g" and r0["categories"] == ["c1"]
    assert r0["enclosures"][0].asDict() == {"url": "u", "type": "audio/mpeg", "length": "9"}
    assert r0["published_at"] == 1136214245
    assert r1["content"] == "only" and r1["published_at"] == 0 and r1["link"] == ""
    assert r2["link"] == "http://e/1" and r2["author"] == "Al" and r2["guid"] == "urn:1"
    assert r2["updated_at"] == 1136214245 and r2["description"] == "sum" and r2["content"] == "sum"
    assert r2["categories"] == ["t1"]


def test_source_limit_per_feed(spark):
    payloads = spark.createDataFrame([("a", RSS), ("b", ATOM)], "feed_url string, payload string")
    assert len(feed_items(payloads, limit=1).df.collect()) == 2
    assert len(feed_items(payloads, limit=0.5).df.collect()) == 0
    assert len(feed_items(payloads, limit=0).df.collect()) == 3


def test_feed_summary(spark):
    payloads = spark.createDataFrame([("a", RSS), ("b", ATOM)], "feed_url string, payload string")
    got = {r["feed_url"]: (r["title"], r["item_count"]) for r in feed_summary(payloads).collect()}
    assert got == {"a": ("T", 2), "b": ("F", 1)}


@pytest.mark.parametrize("text,epoch", [
    ("Mon, 02 Jan 2006 15:04:05 -0700", 1136239445),
    ("Mon, 2 Jan 2006 15:04:05 MST", 1136214245),
    ("2006-01-02T15:04:05Z", 1136214245),
    ("2006-01-02T15:04:05.123+01:00", 1136210645),
    ("02 Jan 06 15:04 -0700", 1136239440),
    ("2006-01-02 15:04:05", 1136214245),
    ("2006-01-02", 1136160000),
    ("garbage", 0),
    ("2006-02-30", 0),
    ("Foo, 02 Jan 2006 15:04:05 GMT", 0),
    ("mon, 02 jan 2006 15:04:05 EST", 1136214245),
    ("02 Jan 70 00:00 +0000", 86400),
    ("02 Jan 69 00:00 UTC", -31449600),
    ("Mon, 02 Jan 2006 24:04:05 +0000", 0),
])
def test_date_layouts(spark, text, epoch):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_feed_date(F.col("t")).alias("e")).first()["e"] == epoch


def _payloads(spark, docs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "src int, payload string")


def test_json_items_path_and_normalisation(spark):
    p = _payloads(spark, ['{"d":{"i":[1,2]}}'])
    assert len(json_items(p, "d.i").df.collect()) == 2
    assert len(json_items(p, "d.i.0").df.collect()) == 1
    nil = json_items(p, "d.no").df.collect()
    assert len(nil) == 1 and nil[0]["__obj"] is False          # one nil item, as the reference
    obj = json_items(_payloads(spark, ['{"a":1}'])).df.collect()
    assert len(obj) == 1 and obj[0]["a"] == 1.0


def test_json_mixed_items_keep_order(spark):
    doc = '{"data":{"items":[{"id":1,"author":{"name":"a"},"tags":["x","y"]},{"id":"1"},7,null]}}'
    f = json_items(_payloads(spark, [doc]), "data.items")
    rows = f.ordered().collect()
    assert [r["__obj"] for r in rows] == [True, True, False, False]
    from sluice.operators.filter import filter_items
    from sluice.operators.merge import merge
    # non-objects are dropped by filter, kept by dedupe
    assert len(filter_items(f, "id", "not-equals", "zzz").df.collect()) == 2
    assert len(merge([f], dedupe_field="id").df.collect()) == 3   # ids 1 and "1" collide
    kept = filter_items(f, "author.name", "equals", "a").df.collect()
    assert len(kept) == 1


def test_json_bad_payload(spark):
    p = _payloads(spark, ["{not json"])
    with pytest.raises(Exception):
        json_items(p, schema="a double").df.collect()
    rows = json_items(p, schema="a double", on_error="null").df.collect()
    assert len(rows) == 1 and rows[0]["__obj"] is False


def test_mixed_type_field_sorts_numbers_then_text(spark):
    from sluice.operators.sort import sort_items
    doc = '[{"id":1,"m":10},{"id":2,"m":"b"},{"id":3,"m":2.5},{"id":4},{"id":5,"m":"a"}]'
    f = json_items(_payloads(spark, [doc]))
    asc = [r["id"] for r in sort_items(f, "m", "asc").ordered().collect()]
    assert asc == [3.0, 1.0, 4.0, 5.0, 2.0]       # 2.5, 10, then '<nil>', 'a', 'b' by bytes
    desc = [r["id"] for r in sort_items(f, "m", "desc").ordered().collect()]
    assert desc == [2.0, 5.0, 4.0, 1.0, 3.0]


def test_regex_and_truncate_touch_only_string_values(spark):
    from sluice.operators.fields import regex_replace, truncate
    doc = '[{"id":1,"m":"hello world"},{"id":2,"m":7},{"id":3,"m":"<b>bold</b> text here"}]'
    f = json_items(_payloads(spark, [doc]))
    r = regex_replace(f, "m", "o", "0", spark)
    got = [x["m"] for x in r.ordered().selectExpr("to_json(m) as m").collect()]
    assert got == ['"hell0 w0rld"', "7", '"<b>b0ld</b> text here"']
    t = truncate(f, "m", 9)
    got = [x["m"] for x in t.ordered().selectExpr("to_json(m) as m").collect()]
    assert got == ['"hello..."', "7", '"bold text..."']


def test_dates_do_not_depend_on_session_time_zone(spark):
    from sluice.functions.text import epoch_to_rfc1123z
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        df = spark.createDataFrame([("Mon, 02 Jan 2006 15:04:05 -0700", 1136214245)], "t string, e bigint")
        r = df.select(parse_feed_date(F.col("t")).alias("p"), epoch_to_rfc1123z(F.col("e")).alias("r")).first()
        assert r["p"] == 1136239445 and r["r"] == "Mon, 02 Jan 2006 15:04:05 +0000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_landed_document_files(spark, tmp_path):
    from sluice.sources.files import landed_documents
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    (tmp_path / "c.json").write_text('{"data":{"items":[{"id":1},{"id":2}]}}')
    docs = landed_documents(spark, str(tmp_path / "*.xml"))
    titles = sorted(r["title"] for r in feed_items(docs).df.collect())
    assert titles == ["", "A & B", "E1"]
    js = json_items(landed_documents(spark, str(tmp_path / "*.json")), "data.items")
    assert sorted(r["id"] for r in js.df.collect()) == [1.0, 2.0]


RDF = """<?xml version="1.0"?><!-- c --><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"
 xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>R</title></channel>
<item><title>one</title><dc:date>2006-01-02T15:04:05Z</dc:date></item><item><title>two</title></item></rdf:RDF>"""
QUOTING = "<rss><channel><title>Q</title><item><title>t</title><description><![CDATA[see <feed xmlns='x'>]]></description>" \
          "</item></channel></rss>"


def test_the_root_element_decides_the_dialect(spark):
    payloads = spark.createDataFrame([("r", RDF), ("q", QUOTING)], "feed_url string, payload string")
    got = [(r["feed_url"], r["title"], r["published_at"]) for r in feed_items(payloads).ordered().collect()]
    assert got == [("q", "t", 0), ("r", "one", 1136214245), ("r", "two", 0)]
    assert {(r["title"], r["item_count"]) for r in feed_summary(payloads).collect()} == {("R", 2), ("Q", 1)}


@pytest.mark.parametrize("bad", ["not xml", "", None, "<rss><channel><item><title>cut", "<html><body/></html>"])
def test_unreadable_payloads_fail_or_are_set_aside(spark, bad):
    from sluice.sources.feed_source import bad_payloads
    payloads = spark.createDataFrame([("a", RSS), ("b", bad)], "feed_url string, payload string")
    with pytest.raises(Exception, match="unreadable feed payload: b"):
        feed_items(payloads).df.collect()
    with pytest.raises(Exception, match="unreadable feed payload: b"):
        feed_summary(payloads).collect()
    assert feed_items(payloads, on_error="skip").df.count() == 2
    assert [r["feed_url"] for r in bad_payloads(payloads).collect()] == ["b"]


def test_keep_names_the_payload_columns_carried_along(spark):
    payloads = spark.createDataFrame([("a", RSS)], "feed_url string, payload string")
    assert "feed_url" in feed_items(payloads).item_columns
    assert "feed_url" not in feed_items(payloads, keep=[]).item_columns
