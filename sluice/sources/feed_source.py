"""Feed source (S1-S6) and feed summary.

Input: landed payloads ``(feed_url, payload)`` holding RSS 2.0, RSS 1.0
(RDF) or Atom XML -- one row per fetched document. The root element alone
decides the dialect. ``from_xml`` parses each payload once, with a declared
schema (no inference pass), ``posexplode`` turns its items into rows in
document order, and one projection flattens them to the 13-field feed item.
A payload that is no feed, or whose XML is broken or cut off, fails the run
with its source named; ``on_error="skip"`` leaves it out, and
``bad_payloads`` lists what would be left out:

    title, description, content, link, author, published : string
    published_at : bigint, updated : string, updated_at : bigint
    guid : string, categories : array<string>
    enclosures : array<struct<url, type, length : string>>, image : string

Missing text is ``""`` and missing dates ``0`` -- never NULL. ``content``
is the item's content when non-empty, else its description. Dates are
epoch seconds parsed with the fixed layout list (``parse_feed_date``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..feed import Feed, OrderKey, col, fresh
from ..functions.text import parse_feed_date
from ..operators.limit import limit_count

FEED_ITEM_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("published_at", T.LongType()),
    T.StructField("updated", T.StringType()),
    T.StructField("updated_at", T.LongType()),
    T.StructField("guid", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("enclosures", T.ArrayType(T.StructType([
        T.StructField("url", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("length", T.StringType())]))),
    T.StructField("image", T.StringType()),
])

_RSS_ITEM = (
    "array<struct<title string, link string, description string, `content:encoded` string, "
    "author string, `dc:creator` string, pubDate string, `dc:date` string, "
    "guid struct<_VALUE string, _isPermaLink string>, category array<string>, "
    "enclosure array<struct<_url string, _type string, _length string>>, "
    "image struct<url string>, `media:thumbnail` struct<_url string>>>"
)
#: RSS 2.0 has its items inside the channel, RSS 1.0 beside it.
RSS_XML_SCHEMA = (f"channel struct<title string, link string, description string, item {_RSS_ITEM}>, "
                  f"item {_RSS_ITEM}, _corrupt_record string")
ATOM_XML_SCHEMA = (
    "title string, subtitle string, link array<struct<_href string, _rel string>>, "
    "entry array<struct<title string, link array<struct<_href string, _rel string, _type string, _length string>>, "
    "id string, updated string, published string, author array<struct<name string>>, "
    "summary string, content string, category array<struct<_term string>>>>, _corrupt_record string"
)
XML_OPTIONS = {"mode": "PERMISSIVE"}
#: What may stand before the root element: byte order mark, declarations, comments.
_PROLOG = r"^(?:[\s\uFEFF]|<\?.*?\?>|<!--.*?-->|<![^>]*>)*"
_ROOT = f"(?s){_PROLOG}<([A-Za-z][A-Za-z0-9_:.-]*)"
_ATOM, _RSS = "__atom", "__rss"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _parsed(payloads: DataFrame, payload_col: str) -> DataFrame:
    """``payloads`` with the payload parsed once, by its dialect (the other
    dialect's column is NULL)."""
    root = F.regexp_extract(col(payload_col), _ROOT, 1)
    return payloads.withColumns({
        _ATOM: F.when(root.isin("feed", "atom:feed"), F.from_xml(col(payload_col), ATOM_XML_SCHEMA, XML_OPTIONS)),
        _RSS: F.when(root.isin("rss", "rdf:RDF", "RDF"), F.from_xml(col(payload_col), RSS_XML_SCHEMA, XML_OPTIONS))})


def _unreadable() -> Column:
    """The payload is neither dialect, or its XML is broken."""
    broken = lambda c: F.coalesce(col(c)["_corrupt_record"].isNotNull(), F.lit(False))
    return (col(_ATOM).isNull() & col(_RSS).isNull()) | broken(_ATOM) | broken(_RSS)


def _checked(value: Column, source_col: str, on_error: str) -> Column:
    """``value`` of a readable payload; otherwise the run fails, or NULL
    (``skip``). Inside the projection: a filter would be pushed below the
    parse and repeat it."""
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error is 'fail' or 'skip'")
    message = F.concat(F.lit("unreadable feed payload: "), _text(col(source_col).cast("string")))
    return F.when(~_unreadable(), value) if on_error == "skip" else \
        F.when(_unreadable(), F.raise_error(message)).otherwise(value)


def bad_payloads(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """The payload rows that are no readable feed (for a quarantine table)."""
    return _parsed(payloads, payload_col).where(_unreadable()).select(*[col(c) for c in payloads.columns])


def _rss_items() -> Column:
    parsed = col(_RSS)
    return F.transform(F.coalesce(parsed["channel"]["item"], parsed["item"]), lambda it: F.struct(
        _text(it["title"]).alias("title"),
        _text(it["description"]).alias("description"),
        _text(it["content:encoded"]).alias("raw_content"),
        _text(it["link"]).alias("link"),
        _text(F.coalesce(it["author"], it["dc:creator"])).alias("author"),
        _text(F.coalesce(it["pubDate"], it["dc:date"])).alias("published"),
        F.lit("").alias("updated"),
        _text(it["guid"]["_VALUE"]).alias("guid"),
        it["category"].alias("categories"),
        F.when(F.size(it["enclosure"]) > 0,
               F.transform(it["enclosure"], lambda e: F.struct(
                   _text(e["_url"]).alias("url"), _text(e["_type"]).alias("type"),
                   _text(e["_length"]).alias("length")))).alias("enclosures"),
        _text(F.coalesce(it["image"]["url"], it["media:thumbnail"]["_url"])).alias("image"),
    ))


def _atom_link(links: Column) -> Column:
    alt = F.filter(links, lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    return _text(F.get(alt, F.lit(0))["_href"])


def _atom_items() -> Column:
    return F.transform(col(_ATOM)["entry"], lambda it: F.struct(
        _text(it["title"]).alias("title"),
        _text(it["summary"]).alias("description"),
        _text(it["content"]).alias("raw_content"),
        _atom_link(it["link"]).alias("link"),
        _text(F.get(it["author"], F.lit(0))["name"]).alias("author"),
        _text(it["published"]).alias("published"),
        _text(it["updated"]).alias("updated"),
        _text(it["id"]).alias("guid"),
        F.transform(it["category"], lambda c: c["_term"]).alias("categories"),
        F.when(F.size(F.filter(it["link"], lambda l: l["_rel"] == "enclosure")) > 0,
               F.transform(F.filter(it["link"], lambda l: l["_rel"] == "enclosure"),
                           lambda e: F.struct(_text(e["_href"]).alias("url"), _text(e["_type"]).alias("type"),
                                              _text(e["_length"]).alias("length")))).alias("enclosures"),
        F.lit("").alias("image"),
    ))


def feed_items(payloads: DataFrame, payload_col: str = "payload", source_col: str = "feed_url",
               limit=None, keep: list[str] | None = None, on_error: str = "fail") -> Feed:
    """Payload rows -> 13-field items, ordered (source, position).
    ``keep`` names the payload columns carried along (default: the source)."""
    payloads = _parsed(payloads, payload_col)
    raw = _checked(F.when(col(_ATOM).isNotNull(), _atom_items()).otherwise(_rss_items()), source_col, on_error)
    n = limit_count(limit)
    if n is not None:
        # The first n items of each fetched document, cut inside the row
        # before exploding -- no shuffle, nothing else is materialised
        raw = F.slice(raw, 1, n) if n > 0 else F.filter(raw, lambda x: F.lit(False))
    src, pos, it = fresh("src"), fresh("pos"), fresh("it")
    keep_cols = [col(c) for c in ([source_col] if keep is None else keep)]
    exploded = payloads.select(*keep_cols, col(source_col).alias(src),
                               F.posexplode_outer(raw).alias(pos, it)).where(col(it).isNotNull())
    feed = Feed(exploded, [OrderKey(src), OrderKey(pos)])
    i = col(it)
    published_at = parse_feed_date(i["published"])
    updated_at = parse_feed_date(i["updated"])
    items = feed.df.select(
        *keep_cols,
        i["title"].alias("title"),
        i["description"].alias("description"),
        F.when(i["raw_content"] != "", i["raw_content"]).otherwise(i["description"]).alias("content"),
        i["link"].alias("link"),
        i["author"].alias("author"),
        i["published"].alias("published"),
        F.when(i["published"] != "", published_at).otherwise(F.lit(0).cast("bigint")).alias("published_at"),
        i["updated"].alias("updated"),
        F.when(i["updated"] != "", updated_at).otherwise(F.lit(0).cast("bigint")).alias("updated_at"),
        i["guid"].alias("guid"),
        i["categories"].alias("categories"),
        i["enclosures"].alias("enclosures"),
        i["image"].alias("image"),
        col(src), col(pos))
    return Feed(items, feed.ordering)


def limit_per_source(feed: Feed, limit, source: str | None = None) -> Feed:
    """S6 for items already in a table (many feeds, one row per item): the
    first n of every source: ``row_number() <= n`` per source, planned as a
    partial ``WindowGroupLimit`` before the shuffle (a huge source costs n
    rows per input partition)."""
    n = limit_count(limit)
    if n is None:
        return feed
    src_key = source or feed.ordering[0].name
    rest = [k for k in feed.ordering if k.name != src_key]
    rn = fresh("rn")
    w = Window.partitionBy(col(src_key)).orderBy(*[k.column() for k in rest])
    df = feed.df.withColumn(rn, F.row_number().over(w)).where(col(rn) <= n).drop(rn)
    return feed.with_df(df)


def feed_summary(payloads: DataFrame, payload_col: str = "payload", source_col: str = "feed_url",
                 on_error: str = "fail") -> DataFrame:
    """Per payload: title, description, link, item_count."""
    atom, rss = col(_ATOM), col(_RSS)
    is_atom = atom.isNotNull()
    items = F.coalesce(F.size(atom["entry"]), F.size(rss["channel"]["item"]), F.size(rss["item"]), F.lit(0))
    summary = F.struct(
        _text(F.when(is_atom, atom["title"]).otherwise(rss["channel"]["title"])).alias("title"),
        _text(F.when(is_atom, atom["subtitle"]).otherwise(rss["channel"]["description"])).alias("description"),
        F.when(is_atom, _atom_link(atom["link"])).otherwise(_text(rss["channel"]["link"])).alias("link"),
        items.cast("bigint").alias("item_count"))
    one = _checked(F.array(summary), source_col, on_error)  # an array: a skipped payload explodes to nothing
    return _parsed(payloads, payload_col).select(col(source_col), F.explode(one).alias("s")).select(col(source_col), "s.*")
