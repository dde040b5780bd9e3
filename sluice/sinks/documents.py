"""Outputs O1-O5, O8: JSON lines / JSON envelope, RSS, webhook payloads.

The outputs of flows have no bound: items are turned into text once and
staged, numbered with ``global_rank``, and written in feed order as JSON
lines, or as the ordered chunks (``CHUNK_ITEMS`` items each) of one document
(``document_chunks``): the chunks one after another are the reference's
``{"count", "items"}`` envelope or RSS document, for any number of items.

``json_envelope`` and ``rss_document`` put a document into a single value
for callers that want one; they gather rows by nature, so they take a bound
(``limit``, default 10,000 items), go through the top-k path and fail beyond
it instead of leaving items out.

Every output returns its input feed (O8: outputs pass items through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..feed import VALUE, Feed, col, fresh
from ..functions.text import epoch_to_rfc1123z
from ..functions.values import INTEGRAL_TYPES, resolve_flat
from ..operators.limit import limit_items
from ..plans.rank import global_rank
from ..session import discard, stage
from .gojson import apart, render
from .publish import publish

DEFAULT_DOCUMENT_BOUND = 10_000
CHUNK_ITEMS = 1000
ENVELOPE_INDENT = "  "
# Channel defaults of the RSS output (title and description
# are our own wording; the link is the reference's default).
RSS_DEFAULT_TITLE = "Feed"
RSS_DEFAULT_DESCRIPTION = "Generated feed"
RSS_DEFAULT_LINK = "http://localhost:3001"
RSS_UNTITLED = "Untitled"
JSON_CONTENT_TYPE = "application/json"
RSS_CONTENT_TYPE = "application/rss+xml"


# ---------------------------------------------------------------------------
# JSON
# ---------------------------------------------------------------------------

def item_json(feed: Feed, indent: str | None = None, level: int = 0) -> Column:
    """One item as JSON text in the reference's spelling (``gojson``):
    objects as their visible fields, keys sorted, NULLs left out;
    non-objects as their scalar value. ``indent``/``level`` place it inside
    an indented document."""
    fields = [f for f in feed.df.schema.fields if f.name in set(feed.item_columns)]
    obj = render(F.struct(*[col(f.name) for f in fields]), T.StructType(fields), indent, level)
    if feed.has_non_objects:
        return F.when(feed.is_object(), obj).otherwise(
            F.coalesce(F.to_json(col(VALUE)), F.lit("null")))
    return obj


class Staged:
    """Texts of a feed's items, written once with the item order: the inputs
    run a single time, whatever is made of the texts later. A feed without an
    ordering keeps the order in which its partitions hold it."""

    def __init__(self, feed: Feed, texts: dict[str, Column], tag: str):
        feed = feed.positioned()
        slim = feed.df.select(*[t.alias(name) for name, t in texts.items()], *[col(k.name) for k in feed.ordering])
        df, self.path = stage(slim, tag)
        self.feed, self.spark = Feed(df, list(feed.ordering)), df.sparkSession

    def text(self, name: str) -> Feed:
        """One of the texts as the column ``text``."""
        return Feed(self.feed.df.select(col(name).alias("text"), *[col(k.name) for k in self.feed.ordering]), self.feed.ordering)

    def __enter__(self) -> "Staged":
        return self

    def __exit__(self, *_) -> None:
        discard(self.spark, self.path)


def write_lines(lines: Feed, path: str) -> int:
    """Texts (``text``) as lines of a new version of the output ``path``, in
    feed order; returns their number. No text: nothing changes."""
    n = lines.df.count()
    if n:
        publish(lines.df.sparkSession, path, lines.ordered().select(col("text").alias("value")).write.text)
    return n


def write_json_lines(feed: Feed, path: str) -> int:
    """O1, scalable form: items as JSON lines in feed order; returns count.

    Empty input writes nothing, and the previous output stays until the new
    one is complete (``publish``; ``current_output`` names its folder)."""
    with Staged(feed, {"line": item_json(feed)}, "json-lines") as staged:
        return write_lines(staged.text("line"), path)


def document_chunks(lines: Feed, head: str, between: str, tail: str, per_chunk: int | None = None) -> tuple[DataFrame, int] | None:
    """Any number of texts (``text``, staged) as the ordered chunks of one document: rows
    ``(chunk, document)`` and the number of texts; None for an empty feed.
    NULL texts are left out; ``{count}`` in ``head`` is the number of texts. At most
    ``per_chunk`` items meet in one row."""
    size = per_chunk or CHUNK_ITEMS
    ranked = global_rank(lines, "__pos").df.select(col("__pos"), col("text"))
    totals = ranked.agg(F.max("__pos").alias("rows"), F.count("text").alias("texts"),
                        F.min(F.when(col("text").isNotNull(), col("__pos"))).alias("first")).first()
    if totals["rows"] is None:
        return None
    last = (totals["rows"] - 1) // size
    # every text but the first of the document is led by the separator
    lead = F.when(col("__pos") == F.lit(totals["first"]), F.lit("")).otherwise(F.lit(between))
    packed = ranked.select(F.floor((col("__pos") - 1) / F.lit(size)).alias("chunk"),
                           F.struct(col("__pos").alias("r"), F.concat(lead, col("text")).alias("t")).alias("e"))
    chunks = packed.groupBy("chunk").agg(F.array_sort(F.collect_list("e")).alias("es")).select(
        "chunk", F.concat(
            F.when(col("chunk") == 0, F.lit(head.replace("{count}", str(totals["texts"])))).otherwise(F.lit("")),
            F.array_join(F.transform("es", lambda e: e["t"]), ""),
            F.when(col("chunk") == F.lit(last), F.lit(tail)).otherwise(F.lit(""))).alias("document"))
    return chunks, int(totals["texts"])


def document_text(feed: Feed) -> Column:
    """An item's text inside the JSON document."""
    return item_json(feed, ENVELOPE_INDENT, 2)


def json_document(lines: Feed, per_chunk: int | None = None) -> tuple[DataFrame, int] | None:
    """The JSON document of staged ``document_text``s, in chunks."""
    ind = ENVELOPE_INDENT
    head = "{\n" + ind + '"count": {count},\n' + ind + '"items": [\n' + ind * 2
    return document_chunks(lines, head, ",\n" + ind * 2, "\n" + ind + "]\n}", per_chunk)


def json_chunks(feed: Feed, per_chunk: int | None = None) -> tuple[DataFrame, int] | None:
    """O1: the JSON document of a feed of any size, in chunks."""
    with Staged(feed, {"text": document_text(feed)}, "document") as staged:
        return json_document(staged.text("text"), per_chunk)


def rss_chunks(feed: Feed, title: str = "", description: str = "", link: str = "",
               per_chunk: int | None = None) -> tuple[DataFrame, int] | None:
    """O2: the RSS document of a feed of any size, in chunks. Items that are
    not objects are skipped; a feed of only such items is an empty channel."""
    head, tail = rss_channel(title, description, link)
    with Staged(feed, {"text": F.when(feed.is_object(), rss_fragment(feed))}, "document") as staged:
        return document_chunks(staged.text("text"), head.replace("{count}", "{ count}"), "", tail, per_chunk)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The chunks as text part files, in order, of a new version of the output ``path``. Lines end where rows end, so a
    chunk's leading line break is the end of the line before it."""
    line = F.when(col("chunk") == 0, col("document")).otherwise(F.regexp_replace("document", "^\n", ""))
    publish(chunks.sparkSession, path, chunks.orderBy("chunk").select(line.alias("value")).write.text)


def _bounded_ranked(feed: Feed, limit: int) -> tuple[DataFrame, str]:
    """At most ``limit + 1`` rows (top-k), ranked: one row more than the
    bound lets the document fail loudly instead of silently dropping items."""
    bounded = limit_items(feed, limit + 1)
    rk = fresh("rank")
    return bounded.df.withColumn(rk, F.row_number().over(Window.orderBy(*bounded.order_columns()))), rk


def _whole_or_fail(count: Column, limit: int, document: Column, form: str) -> Column:
    """The document, or a task failure when the input exceeds the bound:
    a single document never silently leaves items out."""
    msg = (f"{form}: more than {limit} items for one document; raise the bound or use the "
           "scalable form (JSON lines, RSS fragments, webhook batches)")
    return F.when(count > F.lit(limit), F.raise_error(F.lit(msg)).cast("string")).otherwise(document)


def json_envelope(feed: Feed, limit: int = DEFAULT_DOCUMENT_BOUND) -> DataFrame:
    """O1, document form: one row ``(count, document)``; at most ``limit``
    items, in feed order. Zero items -> zero rows (nothing to save)."""
    if not limit or limit <= 0:
        raise ValueError("json_envelope needs a positive bound")
    df, rk = _bounded_ranked(feed, limit)
    # the saved document is indented by two spaces; items sit at depth 2
    j = item_json(Feed(df, feed.ordering), ENVELOPE_INDENT, 2)
    packed = df.select(F.struct(col(rk).alias("r"), j.alias("j")).alias("e"))
    agg = packed.agg(F.count(F.lit(1)).alias("count"),
                     F.array_sort(F.collect_list("e")).alias("es"))
    ind = ENVELOPE_INDENT
    doc = F.concat(F.lit("{\n" + ind + '"count": '), col("count").cast("string"),
                   F.lit(",\n" + ind + '"items": [\n' + ind * 2),
                   F.array_join(F.transform(col("es"), lambda e: e["j"]), ",\n" + ind * 2),
                   F.lit("\n" + ind + "]\n}"))
    return agg.where(col("count") > 0).select(
        col("count"), _whole_or_fail(col("count"), limit, doc, "json_envelope").alias("document"))


# ---------------------------------------------------------------------------
# RSS
# ---------------------------------------------------------------------------

# XML text escapes (in this order; '&' first).
XML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"),
               ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")]
# Characters outside XML's range (controls other than tab, LF, CR; U+FFFE,
# U+FFFF) are written as U+FFFD.
XML_INVALID_CHARS = "".join(chr(c) for c in [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20),
                                             0xFFFE, 0xFFFF])


def xml_escape(c: Column) -> Column:
    """Escaped text. Most texts hold none of the characters concerned: one
    search spares them nine passes."""
    def escaped(x: Column) -> Column:
        out = F.translate(x, XML_INVALID_CHARS, "\ufffd" * len(XML_INVALID_CHARS))
        for a, b in XML_ESCAPES:
            out = F.replace(out, F.lit(a), F.lit(b))
        return out
    return F.when(c.rlike("[&<>\"'\\x00-\\x1F\\uFFFE\\uFFFF]"), apart(c, escaped)).otherwise(c)


def _string_field(feed: Feed, name: str, default: str) -> Column:
    x, dtype = resolve_flat(feed.df.schema, name)
    if isinstance(dtype, T.StringType):
        return F.coalesce(x, F.lit(default))
    if isinstance(dtype, T.VariantType):  # mixed types: each item's own value counts
        return F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.lit(default))
    return F.lit(default)


def _element(tag: str, value: Column, indent: str, omit_empty: bool) -> Column:
    el = F.concat(F.lit(f"\n{indent}<{tag}>"), xml_escape(value), F.lit(f"</{tag}>"))
    return F.when(value != "", el).otherwise(F.lit("")) if omit_empty else el


def rss_item_fields(feed: Feed) -> dict[str, Column]:
    """O2-O4 item fields: title (``Untitled`` when missing or not text),
    description, link, pubDate (published text, else epoch > 0 as RFC 1123),
    guid, author, categories (text members)."""
    schema = feed.df.schema
    pub_text = _string_field(feed, "published", "")
    pa, pa_t = resolve_flat(schema, "published_at")
    if isinstance(pa_t, INTEGRAL_TYPES):
        from_epoch = F.when(pa > 0, epoch_to_rfc1123z(pa)).otherwise(F.lit(""))
    elif isinstance(pa_t, (T.DoubleType, T.FloatType, T.VariantType)):
        # a merge with JSON items may have widened the epoch: whole numbers count
        num = F.try_variant_get(pa, "$", "double") if isinstance(pa_t, T.VariantType) else pa.cast("double")
        whole = (num > 0) & (num == F.floor(num)) & (num < F.lit(1e15))
        from_epoch = F.when(whole, epoch_to_rfc1123z(F.when(whole, num).cast("bigint"))).otherwise(F.lit(""))
    else:
        from_epoch = F.lit("")
    cats, cats_t = resolve_flat(schema, "categories")
    if isinstance(cats_t, T.ArrayType) and isinstance(cats_t.elementType, T.StringType):
        categories = F.coalesce(F.filter(cats, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    elif isinstance(cats_t, T.ArrayType) and isinstance(cats_t.elementType, T.VariantType):
        # a mixed JSON list: only its text members become categories
        texts = F.transform(F.filter(cats, lambda v: F.schema_of_variant(v) == "STRING"),
                            lambda v: F.try_variant_get(v, "$", "string"))
        categories = F.coalesce(texts, F.array().cast("array<string>"))
    else:
        categories = F.array().cast("array<string>")
    return {
        "title": _string_field(feed, "title", RSS_UNTITLED),
        "description": _string_field(feed, "description", ""),
        "link": _string_field(feed, "link", ""),
        "pubDate": F.when(pub_text != "", pub_text).otherwise(from_epoch),
        "guid": _string_field(feed, "guid", ""),
        "author": _string_field(feed, "author", ""),
        "categories": categories,
    }


def rss_fragment(feed: Feed) -> Column:
    """One ``<item>`` element, indented as inside ``rss > channel``."""
    f = rss_item_fields(feed)
    ind = "      "
    cats = F.array_join(F.transform(f["categories"], lambda c: F.concat(
        F.lit(f"\n{ind}<category>"), xml_escape(c), F.lit("</category>"))), "")
    return F.concat(F.lit("\n    <item>"),
                    _element("title", f["title"], ind, False),
                    _element("description", f["description"], ind, False),
                    _element("link", f["link"], ind, False),
                    _element("pubDate", f["pubDate"], ind, True),
                    _element("guid", f["guid"], ind, True),
                    _element("author", f["author"], ind, True),
                    cats,
                    F.lit("\n    </item>"))


def rss_fragments(feed: Feed, keep: list[str] | None = None) -> Feed:
    """Scalable RSS form: one fragment per object item (non-objects skipped)."""
    frag = fresh("frag")
    df = feed.df.where(feed.is_object()).withColumn(frag, rss_fragment(feed))
    return Feed(df.select(*[col(c) for c in (keep or [])], col(frag).alias("fragment"),
                          *[col(k.name) for k in feed.ordering]),
                feed.ordering)


def rss_channel(title: str = "", description: str = "", link: str = "") -> tuple[str, str]:
    def esc(s):
        for a, b in XML_ESCAPES:
            s = s.replace(a, b)
        return s
    head = ('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0">\n  <channel>'
            f"\n    <title>{esc(title or RSS_DEFAULT_TITLE)}</title>"
            f"\n    <description>{esc(description or RSS_DEFAULT_DESCRIPTION)}</description>"
            f"\n    <link>{esc(link or RSS_DEFAULT_LINK)}</link>")
    tail = "\n  </channel>\n</rss>"
    return head, tail


def rss_document(feed: Feed, title: str = "", description: str = "", link: str = "",
                 limit: int = DEFAULT_DOCUMENT_BOUND, group_cols: list[str] | None = None) -> DataFrame:
    """O2 document form: ``(count, document)``; bounded by ``limit`` per
    group (``group_cols``: one document per group, e.g. per feed)."""
    head, tail = rss_channel(title, description, link)
    group_cols = group_cols or []
    frags = rss_fragments(feed, group_cols)
    if group_cols:
        # bound per group with a partial WindowGroupLimit, then rank
        names = [k.name for k in frags.ordering]
        keep = frags.df.select("fragment", *[col(g) for g in group_cols], *[col(n) for n in names])
        rk = fresh("rank")
        w = Window.partitionBy(*[col(g) for g in group_cols]).orderBy(*frags.order_columns())
        ranked = keep.withColumn(rk, F.row_number().over(w)).where(col(rk) <= limit + 1)
        grouped = ranked.groupBy(*[col(g) for g in group_cols])
    else:
        ranked, rk = _bounded_ranked(frags, limit)
        grouped = ranked.groupBy()
    agg = grouped.agg(F.count(F.lit(1)).alias("count"),
                      F.array_sort(F.collect_list(F.struct(col(rk).alias("r"), col("fragment").alias("f"))))
                      .alias("fs"))
    doc = F.concat(F.lit(head), F.array_join(F.transform(col("fs"), lambda e: e["f"]), ""), F.lit(tail))
    if not group_cols:
        agg = agg.where(col("count") > 0)  # nothing to write: the earlier document stays
    return agg.select(*[col(g) for g in group_cols], col("count"),
                      _whole_or_fail(col("count"), limit, doc, "rss_document").alias("document"))


# ---------------------------------------------------------------------------
# Webhook payloads
# ---------------------------------------------------------------------------

def webhook_batches(feed: Feed, batch_size: int = 1000) -> tuple[DataFrame, int]:
    """Payloads of at most ``batch_size`` items each, in feed order, and
    the number of items: batch = (global position - 1) // batch_size, the global
    position coming from ``global_rank`` (no single-partition window). Every payload has the
    same form, however many there are: ``batch`` (from 0) of ``batches``,
    ``count`` items here of ``total``, and ``items``. The sort runs when this is
    called (the total is part of every payload), so it is for batch feeds."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    with Staged(feed, {"text": item_json(feed)}, "webhook") as staged:
        ranked = global_rank(staged.text("text"), "__pos").df
    total = ranked.agg(F.max("__pos").alias("n")).first()["n"] or 0
    batches = -(-total // batch_size)
    df = ranked.select(F.floor((col("__pos") - 1) / F.lit(batch_size)).alias("batch"),
                       F.struct(col("__pos").alias("r"), col("text").alias("j")).alias("e"))
    agg = df.groupBy("batch").agg(F.count(F.lit(1)).alias("count"),
                                  F.array_sort(F.collect_list("e")).alias("es"),
                                  F.min(col("e")["r"]).alias("first_position"))
    return agg.select("batch", "count", "first_position", F.lit(total).cast("bigint").alias("total"),
                      F.concat(F.lit('{"batch":'), col("batch").cast("string"), F.lit(f',"batches":{batches},"count":'),
                               col("count").cast("string"), F.lit(',"items":['),
                               F.array_join(F.transform(col("es"), lambda e: e["j"]), ","),
                               F.lit(f'],"total":{total}}}')).alias("payload")), total


def webhook_payloads(feed: Feed, batch_size: int = 1000) -> DataFrame:
    """The payloads of ``webhook_batches``."""
    return webhook_batches(feed, batch_size)[0]
