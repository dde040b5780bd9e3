"""Query catalogue: every operator as a query over the given tables, with
the equivalent DuckDB SQL used as the correctness oracle.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over whole
tables. Order, where it is part of the result, is made visible as a
``rank`` column (after a limit, or through ``global_rank``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .feed import Feed
from .functions.text import (UNICODE_SPACE_CLASS, epoch_to_rfc1123z, parse_feed_date, strip_html,
                             utc_ntz_to_epoch)
from .operators.fields import map_fields, regex_replace, truncate
from .operators.filter import filter_items
from .operators.limit import limit_items
from .operators.merge import merge
from .operators.sort import rank_column, sort_items
from .plans.history import owner_logs, recent_runs, run_log
from .plans.rank import global_rank
from .sinks.documents import json_envelope, rss_channel, rss_document, rss_fragments, webhook_payloads
from .sinks.publish import current_output
from .sources.feed_source import feed_items, feed_summary, limit_per_source
from .sinks.versions import latest_versions, flows_to_run, published_outputs
from .sources.json_source import json_items, to_payload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def items(spark, sf_dir, name, order) -> Feed:
    return Feed.from_table(table(spark, sf_dir, name), order)


def ranked(feed: Feed, *cols: str) -> DataFrame:
    """Bounded feed (after a limit) -> visible columns + rank."""
    return feed.df.select(*cols, rank_column(feed))


# DuckDB spellings of the text rules (RE2 syntax)
SQL_WS = UNICODE_SPACE_CLASS.replace("\\x{B}", "\\v")
SQL_STRIP = "regexp_replace(regexp_replace(@X@, '<[^>]*>?|>', '', 'g'), '^" + SQL_WS + "+|" + SQL_WS + "+$', '', 'g')"
SQL_RTRIM = "regexp_replace(@X@, '" + SQL_WS + "+$', '', 'g')"


def sql_truncate(table_sql: str, key: str, field: str, n: int, suffix: str = "...") -> str:
    """Byte-budget truncation in DuckDB: longest character prefix within n
    bytes, dangling bytes of a cut character as U+FFFD each. ``key``: the
    columns carried through, as a comma-separated list."""
    strip = SQL_STRIP.replace("@X@", field)
    head = "left(whole, length(whole) - length(after) - 1)"
    return f"""
with s as (select {key}, {strip} as v from ({table_sql})),
c as (select {key}, v, list_max(list_filter(range(0, least(length(v), {n}) + 1),
                                            lambda i: strlen(left(v, i)) <= {n})) as nc from s),
p as (select {key}, v, left(v, nc) as whole, {n} - strlen(left(v, nc)) as k from c),
q as (select *, regexp_extract(whole, '[^ ]*$') as after from p)
select {key}, case
  when strlen(v) <= {n} then v
  when position(' ' in whole) > 0 and strlen(whole) - strlen(after) - 1 > {n // 2}
    then {SQL_RTRIM.replace("@X@", head)} || '{suffix}'
  when k > 0 then whole || repeat('�', cast(k as bigint)) || '{suffix}'
  else {SQL_RTRIM.replace("@X@", "whole")} || '{suffix}' end as {field}
from q"""


# ---------------------------------------------------------------------------
# F: filter
# ---------------------------------------------------------------------------

@query("filter_contains",
       "select page_id, url from pages where contains(lower(html), 'the')")
def q_filter_contains(spark, sf):
    return filter_items(items(spark, sf, "pages", "page_id"), "html", "contains", "the").df \
        .select("page_id", "url")


@query("filter_contains_case",
       "select event_id, event_type from events where contains(lower(event_type), 'click')")
def q_filter_contains_case(spark, sf):
    return filter_items(items(spark, sf, "events", "event_id"), "event_type", "contains", "CLICK").df \
        .select("event_id", "event_type")


@query("filter_equals_text", "select event_id from events where event_type = 'purchase'")
def q_filter_equals_text(spark, sf):
    return filter_items(items(spark, sf, "events", "event_id"), "event_type", "equals", "purchase").df \
        .select("event_id")


@query("filter_equals_number",
       "select event_id, value from events where cast(value as varchar) = '6.55'")
def q_filter_equals_number(spark, sf):
    return filter_items(items(spark, sf, "events", "event_id"), "value", "equals", "6.55").df \
        .select("event_id", "value")


@query("filter_not_equals_missing",
       "select d.doc_id, l.toxic from documents d left join labels l on d.doc_id = l.doc_id "
       "where coalesce(cast(l.toxic as varchar), '<nil>') <> '1'")
def q_filter_not_equals_missing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    joined = docs.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return filter_items(Feed.from_table(joined, "doc_id"), "toxic", "not-equals", "1").df \
        .select("doc_id", "toxic")


@query("filter_regex",
       "select doc_id from documents where regexp_matches(text, '\\bth[a-z]+\\.')")
def q_filter_regex(spark, sf):
    return filter_items(items(spark, sf, "documents", "doc_id"), "text", "regex", r"\bth[a-z]+\.",
                        spark).df.select("doc_id")


@query("filter_regex_invalid", "select event_id from events where false")
def q_filter_regex_invalid(spark, sf):
    return filter_items(items(spark, sf, "events", "event_id"), "event_type", "regex", "[", spark).df \
        .select("event_id")


def events_items(spark, sf) -> Feed:
    """events with ``props`` parsed by a declared schema (JSON object)."""
    ev = table(spark, sf, "events")
    ev = ev.withColumn("props", F.from_json("props", "k double"))
    return Feed.from_table(ev, "event_id")


@query("filter_nested",
       "select event_id from events where json_extract_string(props, '$.k') = '69'")
def q_filter_nested(spark, sf):
    return filter_items(events_items(spark, sf), "props.k", "equals", "69").df.select("event_id")


@query("filter_unknown_op", "select c_custkey from customer")
def q_filter_unknown_op(spark, sf):
    return filter_items(items(spark, sf, "customer", "c_custkey"), "c_name", "foo", "x").df.select("c_custkey")


@query("filter_empty_field", "select s_suppkey from supplier")
def q_filter_empty_field(spark, sf):
    return filter_items(items(spark, sf, "supplier", "s_suppkey"), "", "equals", "x").df.select("s_suppkey")


# ---------------------------------------------------------------------------
# T: sort / limit / top-k
# ---------------------------------------------------------------------------

@query("sort_numeric_top",
       "select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as rank "
       "from orders qualify rank <= 100")
def q_sort_numeric_top(spark, sf):
    f = limit_items(sort_items(items(spark, sf, "orders", "o_orderkey"), "o_totalprice", "desc"), 100)
    return ranked(f, "o_orderkey", "o_totalprice")


@query("sort_default_desc",
       "select p_partkey, p_retailprice, row_number() over (order by p_retailprice desc, p_partkey) as rank "
       "from part qualify rank <= 50")
def q_sort_default_desc(spark, sf):
    f = limit_items(sort_items(items(spark, sf, "part", "p_partkey"), "p_retailprice", ""), 50)
    return ranked(f, "p_partkey", "p_retailprice")


@query("merge_sort_default_asc",
       "select p_partkey, p_retailprice, row_number() over (order by p_retailprice, p_partkey) as rank "
       "from part qualify rank <= 50")
def q_merge_sort_default_asc(spark, sf):
    f = limit_items(merge([items(spark, sf, "part", "p_partkey")], sort_field="p_retailprice"), 50)
    return ranked(f, "p_partkey", "p_retailprice")


@query("sort_text_nulls", """
select c_custkey, s_suppkey,
       row_number() over (order by coalesce(c_name, '<nil>'), src, c_custkey, s_suppkey) as rank
from (select c_custkey, c_name, null::bigint as s_suppkey, 0 as src from customer
      union all select null::bigint, null, s_suppkey, 1 from supplier)""")
def q_sort_text_nulls(spark, sf):
    m = merge([items(spark, sf, "customer", "c_custkey"), items(spark, sf, "supplier", "s_suppkey")])
    f = global_rank(sort_items(m, "c_name", "asc"))
    return f.df.select("c_custkey", "s_suppkey", "rank")


@query("sort_stable_ties",
       "select o_orderkey, o_orderpriority, row_number() over (order by o_orderpriority desc, o_orderkey) "
       "as rank from orders qualify rank <= 200")
def q_sort_stable_ties(spark, sf):
    f = limit_items(sort_items(items(spark, sf, "orders", "o_orderkey"), "o_orderpriority", "desc"), 200)
    return ranked(f, "o_orderkey", "o_orderpriority")


LIMIT_CASES = [("zero", 0), ("negative", -1), ("half", 0.5), ("two_point_nine", 2.9),
               ("huge", 10 ** 9), ("text", "2"), ("three", 3)]


@query("limit_edges", """
select 'zero' as case_name, count(*) as n_rows from nation
union all select 'negative', count(*) from nation
union all select 'half', count(*) from (select * from nation limit 0)
union all select 'two_point_nine', count(*) from (select * from nation limit 2)
union all select 'huge', count(*) from nation
union all select 'text', count(*) from nation
union all select 'three', count(*) from (select * from nation limit 3)""")
def q_limit_edges(spark, sf):
    base = items(spark, sf, "nation", "n_nationkey")
    parts = [limit_items(base, c).df.select(F.lit(name).alias("case_name")) for name, c in LIMIT_CASES]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    names = spark.createDataFrame([(n,) for n, _ in LIMIT_CASES], "case_name string")
    counts = u.groupBy("case_name").agg(F.count(F.lit(1)).alias("n_rows"))
    return names.join(counts, "case_name", "left").select(
        "case_name", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))


# ---------------------------------------------------------------------------
# M: merge / dedupe
# ---------------------------------------------------------------------------

@query("merge_union", "select * from customer union all by name select * from supplier")
def q_merge_union(spark, sf):
    return merge([items(spark, sf, "customer", "c_custkey"), items(spark, sf, "supplier", "s_suppkey")]).items()


def _split_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    a = Feed.from_table(ev.where(F.col("event_type").isin("click", "view")), ["ts", "event_id"])
    b = Feed.from_table(ev.where(~F.col("event_type").isin("click", "view")), ["ts", "event_id"])
    return a, b


@query("merge_dedupe", """
select event_id, user_id from (
  select *, case when event_type in ('click', 'view') then 0 else 1 end as src from events)
qualify row_number() over (partition by user_id order by src, ts, event_id) = 1""")
def q_merge_dedupe(spark, sf):
    a, b = _split_events(spark, sf)
    return merge([a, b], dedupe_field="user_id").df.select("event_id", "user_id")


@query("merge_dedupe_missing", """
select c_custkey, s_suppkey, c_nationkey from (
  select c_custkey, null::bigint as s_suppkey, c_nationkey, 0 as src from customer
  union all select null, s_suppkey, null, 1 from supplier)
qualify row_number() over (partition by coalesce(cast(c_nationkey as varchar), '<nil>')
                           order by src, c_custkey, s_suppkey) = 1""")
def q_merge_dedupe_missing(spark, sf):
    m = merge([items(spark, sf, "customer", "c_custkey"), items(spark, sf, "supplier", "s_suppkey")],
              dedupe_field="c_nationkey")
    return m.df.select("c_custkey", "s_suppkey", "c_nationkey")


@query("merge_dedupe_absent_field", """
select n_nationkey from nation qualify row_number() over (order by n_nationkey) = 1""")
def q_merge_dedupe_absent_field(spark, sf):
    return merge([items(spark, sf, "nation", "n_nationkey")], dedupe_field="no_such_field").df \
        .select("n_nationkey")


@query("merge_repeat_edge",
       "select n_nationkey, n_name from nation union all select n_nationkey, n_name from nation")
def q_merge_repeat_edge(spark, sf):
    n = items(spark, sf, "nation", "n_nationkey")
    return merge([n, n]).df.select("n_nationkey", "n_name")


@query("dedupe_text_copies", """
select doc_id from documents qualify row_number() over (partition by text order by doc_id) = 1""")
def q_dedupe_text_copies(spark, sf):
    return merge([items(spark, sf, "documents", "doc_id")], dedupe_field="text").df.select("doc_id")


@query("merge_dedupe_sorted_top", """
select doc_id, item_id, row_number() over (order by n_chars desc nulls first, src, doc_id, item_id) as rank
from (select * from (select doc_id, null::bigint as item_id, n_chars, text, 0 as src from documents
                     union all select null, item_id, null, text, 1 from benchmark)
      qualify row_number() over (partition by text order by src, doc_id, item_id) = 1)
order by rank limit 40""")
def q_merge_dedupe_sorted_top(spark, sf):
    m = merge([items(spark, sf, "documents", "doc_id"), items(spark, sf, "benchmark", "item_id")],
              dedupe_field="text", sort_field="n_chars", sort_order="desc")
    return ranked(limit_items(m, 40), "doc_id", "item_id")


# ---------------------------------------------------------------------------
# P: map / regex / strip / truncate
# ---------------------------------------------------------------------------

@query("map_keep", """
select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, c_name as name, c_mktsegment as seg
from customer""")
def q_map_keep(spark, sf):
    return map_fields(items(spark, sf, "customer", "c_custkey"), "name:c_name, seg:c_mktsegment", True).items()


@query("map_only", "select c_name as name, c_nationkey as nation from customer")
def q_map_only(spark, sf):
    return map_fields(items(spark, sf, "customer", "c_custkey"), "name:c_name, nation : c_nationkey, bad",
                      False).items()


@query("map_swap", "select c_custkey, c_mktsegment as c_name, c_name as c_mktsegment from customer")
def q_map_swap(spark, sf):
    f = map_fields(items(spark, sf, "customer", "c_custkey"), "c_name:c_mktsegment, c_mktsegment:c_name", True)
    return f.df.select("c_custkey", "c_name", "c_mktsegment")


@query("map_existing_target", """
select d.doc_id, coalesce(cast(l.quality as varchar), d.source) as source
from documents d left join labels l on d.doc_id = l.doc_id""")
def q_map_existing_target(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    joined = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return map_fields(Feed.from_table(joined, "doc_id"), "source:quality", True).df.select("doc_id", "source")


@query("map_nested_extract", """
select event_id as id, cast(json_extract_string(props, '$.k') as double) as k, user_id as who from events""")
def q_map_nested_extract(spark, sf):
    return map_fields(events_items(spark, sf), "id:event_id, k:props.k, who:user_id, gone:props.zz").items() \
        .select("id", "k", "who")


@query("regex_replace_groups", """
select doc_id, regexp_replace(text, '([A-Z])(\\w+)', '\\2\\1', 'g') as text from documents""")
def q_regex_replace_groups(spark, sf):
    f = regex_replace(items(spark, sf, "documents", "doc_id"), "text", r"([A-Z])(\w+)", "$2$1", spark)
    return f.df.select("doc_id", "text")


@query("regex_replace_named", """
select p_partkey, regexp_replace(p_name, '(\\w+) (\\w+)', '\\2_\\1', 'g') as p_name from part""")
def q_regex_replace_named(spark, sf):
    f = regex_replace(items(spark, sf, "part", "p_partkey"), "p_name", r"(?P<first>\w+) (?P<second>\w+)",
                      "${second}_${first}", spark)
    return f.df.select("p_partkey", "p_name")


@query("regex_empty_matches", """
select doc_id, regexp_replace(regexp_replace(text, '[a-z]*', '-', 'g'), '(x)|\\b', '<\\1>', 'g') as text from documents""")
def q_regex_empty_matches(spark, sf):
    f = regex_replace(items(spark, sf, "documents", "doc_id"), "text", "[a-z]*", "-", spark)
    f = regex_replace(f, "text", r"(x)|\b", "<$1>", spark)
    return f.df.select("doc_id", "text")


@query("filter_deep_list", """
select l_orderkey, l_linenumber from lineitem
where l_linenumber % 2 = 1 and l_returnflag = 'R' and l_quantity > 25""")
def q_filter_deep_list(spark, sf):
    """Equality with a list of four levels that holds a map."""
    line = table(spark, sf, "lineitem")
    deep = F.to_json(F.struct(
        F.col("l_orderkey"), F.col("l_linenumber"),
        F.array(F.array(F.array(F.struct(F.col("l_returnflag").alias("m"), (F.col("l_linenumber") % 2).alias("a"),
                                         F.array((F.col("l_quantity") > 25).cast("boolean")).alias("q"))))).alias("v")))
    rows = line.select("l_orderkey", "l_linenumber", F.parse_json(deep).alias("j"))
    f = Feed(rows.select("l_orderkey", "l_linenumber", F.variant_get("j", "$.v", "variant").alias("v")))
    return filter_items(f, "v", "equals", "[[[map[a:1 m:R q:[true]]]]]").df.select("l_orderkey", "l_linenumber")


@query("strip_html", "select page_id, " + SQL_STRIP.replace("@X@", "html") + " as text from pages")
def q_strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", strip_html(F.col("html")).alias("text"))


@query("truncate_utf8", sql_truncate("select doc_id, text from documents", "doc_id", "text", 120))
def q_truncate_utf8(spark, sf):
    return truncate(items(spark, sf, "documents", "doc_id"), "text", 120).df.select("doc_id", "text")


@query("truncate_pages", sql_truncate("select page_id, html from pages", "page_id", "html", 150))
def q_truncate_pages(spark, sf):
    return truncate(items(spark, sf, "pages", "page_id"), "html", 150).df.select("page_id", "html")


@query("truncate_turns", sql_truncate("select conv_id, turn, text from conversations", "conv_id, turn", "text", 40))
def q_truncate_turns(spark, sf):
    return truncate(items(spark, sf, "conversations", ["conv_id", "turn"]), "text", 40).df \
        .select("conv_id", "turn", "text")


# ---------------------------------------------------------------------------
# flagship (entry)
# ---------------------------------------------------------------------------

@query("flagship_top_documents", """
select doc_id, source, n_chars, row_number() over (order by n_chars desc, doc_id) as rank
from documents where contains(lower(text), 'the') qualify rank <= 25""")
def flagship(spark, sf):
    f = items(spark, sf, "documents", "doc_id")
    f = filter_items(f, "text", "contains", "the")
    f = sort_items(f, "n_chars", "desc")
    f = limit_items(f, 25)
    return ranked(f, "doc_id", "source", "n_chars")


# ---------------------------------------------------------------------------
# S: JSON source
# ---------------------------------------------------------------------------

PAYLOAD_ITEMS = 50  # items per landed test payload (bounds every payload)


def event_payloads(spark, sf, items_path="data.items") -> DataFrame:
    """events landed as JSON documents of <= 50 items, nested under a path."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    ev = ev.withColumn("payload_id", F.floor(F.col("event_id") / PAYLOAD_ITEMS))
    return to_payload(ev, ["payload_id"], "event_id", items_path)


@query("json_items_path", """
select cast(event_id as double) as event_id, cast(user_id as double) as user_id, event_type, value
from events""")
def q_json_items_path(spark, sf):
    f = json_items(event_payloads(spark, sf), items_path="data.items", order_cols=["payload_id"])
    return f.df.select("event_id", "user_id", "event_type", "value")


@query("json_path_index", f"""
select cast(min(event_id) as double) as event_id from events group by event_id // {PAYLOAD_ITEMS}""")
def q_json_path_index(spark, sf):
    f = json_items(event_payloads(spark, sf), items_path="data.items.0", order_cols=["payload_id"])
    return f.df.select("event_id")


@query("json_single_object", """
select cast(event_id as double) as id, cast(json_extract_string(props, '$.k') as double) as k from events""")
def q_json_single_object(spark, sf):
    ev = table(spark, sf, "events")
    payloads = ev.select("event_id", F.to_json(F.struct("event_id", "user_id",
                                                        F.from_json("props", "k bigint").alias("props")))
                         .alias("payload"))
    f = json_items(payloads, order_cols=["event_id"])
    return map_fields(f, "id:event_id, k:props.k").items()


@query("json_filter_sort_top", """
select cast(event_id as double) as event_id, value,
       row_number() over (order by value desc, event_id) as rank
from events where event_type = 'purchase' qualify rank <= 30""")
def q_json_filter_sort_top(spark, sf):
    f = json_items(event_payloads(spark, sf), items_path="data.items", order_cols=["payload_id"])
    f = limit_items(sort_items(filter_items(f, "event_type", "equals", "purchase"), "value", "desc"), 30)
    return ranked(f, "event_id", "value")


# ---------------------------------------------------------------------------
# S / O: feed source and RSS output
# ---------------------------------------------------------------------------

FEED_GROUP = 16  # documents per landed test feed


def document_items(spark, sf) -> DataFrame:
    """documents shaped as feed items (text -> description, source -> feed)."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", "source", "lang", "text", "n_chars",
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("description"),
        F.concat(F.lit("http://example.com/"), F.col("source"), F.lit("/"),
                 F.col("doc_id").cast("string")).alias("link"),
        F.col("doc_id").cast("string").alias("guid"),
        F.col("lang").alias("author"),
        (F.col("n_chars") * 86400).alias("published_at"),
        F.array("lang", "source").alias("categories"),
        F.concat(F.lit("http://feeds.example.com/"), F.col("source"), F.lit("/"),
                 F.floor(F.col("doc_id") / FEED_GROUP).cast("string")).alias("feed_url"))


def feed_payloads(spark, sf, docs: DataFrame | None = None) -> DataFrame:
    """Land documents as RSS payloads of <= 16 items (built by the RSS output)."""
    docs = docs if docs is not None else document_items(spark, sf)
    feed = Feed.from_table(docs, "doc_id")
    out = rss_document(feed, title="Documents", description="documents as feed items",
                       link="http://example.com/", group_cols=["feed_url"], limit=FEED_GROUP)
    return out.select("feed_url", F.col("document").alias("payload"))


FEED_URL_SQL = "'http://feeds.example.com/' || source || '/' || cast(doc_id // 16 as varchar)"


@query("feed_roundtrip", """
select cast(doc_id as varchar) as guid, 'doc ' || cast(doc_id as varchar) as title, text as description,
       text as content, 'http://example.com/' || source || '/' || cast(doc_id as varchar) as link,
       lang as author, n_chars * 86400 as published_at, lang || ',' || source as categories
from documents""")
def q_feed_roundtrip(spark, sf):
    f = feed_items(feed_payloads(spark, sf))
    return f.df.select("guid", "title", "description", "content", "link", "author", "published_at",
                       F.array_join("categories", ",").alias("categories"))


@query("feed_summary", f"""
select {FEED_URL_SQL} as feed_url, 'Documents' as title, count(*) as item_count
from documents group by all""")
def q_feed_summary(spark, sf):
    return feed_summary(feed_payloads(spark, sf)).select("feed_url", "title", "item_count")


@query("feed_limit_per_source", f"""
select doc_id, {FEED_URL_SQL} as feed_url from documents
qualify row_number() over (partition by {FEED_URL_SQL} order by doc_id) <= 5""")
def q_feed_limit_per_source(spark, sf):
    f = feed_items(feed_payloads(spark, sf), limit=5)
    return f.df.select(F.col("guid").cast("bigint").alias("doc_id"), "feed_url")


@query("limit_per_source_table", """
select doc_id, source from documents qualify row_number() over (partition by source order by doc_id) <= 5""")
def q_limit_per_source_table(spark, sf):
    f = limit_per_source(items(spark, sf, "documents", ["source", "doc_id"]), 5)
    return f.df.select("doc_id", "source")


DATE_LAYOUTS = 5


@query("feed_dates", """
select event_id, case when event_id % 5 = 4 then (cast(floor(epoch(ts)) as bigint) // 60) * 60
                      else cast(floor(epoch(ts)) as bigint) end as published_at
from events""")
def q_feed_dates(spark, sf):
    # ts is TIMESTAMP_NTZ (UTC wall clock): formatting it needs no time zone
    ev = table(spark, sf, "events").select("event_id", "ts")
    k = F.pmod(F.col("event_id"), F.lit(DATE_LAYOUTS))
    shifted = F.col("ts") - F.expr("INTERVAL 7 HOURS")
    text = (F.when(k == 0, F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
            .when(k == 1, F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
            .when(k == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")))
            .when(k == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.concat(F.date_format(shifted, "dd MMM yy HH:mm"), F.lit(" -0700"))))
    return ev.select("event_id", parse_feed_date(text).alias("published_at"))


@query("rss_render_dates", """
select event_id, strftime(make_timestamp(cast(floor(epoch(ts)) as bigint) * 1000000),
                          '%a, %d %b %Y %H:%M:%S') || ' +0000' as pub_date
from events""")
def q_rss_render_dates(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", epoch_to_rfc1123z(utc_ntz_to_epoch(F.col("ts"))).alias("pub_date"))


def _sql_xml(x: str) -> str:
    e = f"regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFE}}\\x{{FFFF}}]', '�', 'g')"
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;"),
                 ("chr(9)", "&#x9;"), ("chr(10)", "&#xA;"), ("chr(13)", "&#xD;")]:
        src = a if a.startswith("chr(") else f"'{a}'"
        e = f"replace({e}, {src}, '{b}')"
    return e


def _sql_el(tag: str, x: str) -> str:
    return f"chr(10) || '      <{tag}>' || {_sql_xml(x)} || '</{tag}>'"


@query("rss_items", f"""
select doc_id, chr(10) || '    <item>'
  || {_sql_el('title', "'doc ' || cast(doc_id as varchar)")}
  || {_sql_el('description', 'text')}
  || {_sql_el('link', "'http://example.com/' || source || '/' || cast(doc_id as varchar)")}
  || case when n_chars > 0 then {_sql_el('pubDate', "strftime(make_timestamp(n_chars * 86400 * 1000000), '%a, %d %b %Y %H:%M:%S') || ' +0000'")} else '' end
  || {_sql_el('guid', 'cast(doc_id as varchar)')}
  || {_sql_el('author', 'lang')}
  || {_sql_el('category', 'lang')} || {_sql_el('category', 'source')}
  || chr(10) || '    </item>' as fragment
from documents""")
def q_rss_items(spark, sf):
    docs = document_items(spark, sf).drop("feed_url")
    f = rss_fragments(Feed.from_table(docs, "doc_id"), keep=["doc_id"])
    return f.df.select("doc_id", "fragment")


@query("json_envelope", """
select count(*) as count,
       '{' || chr(10) || '  "count": ' || count(*) || ',' || chr(10) || '  "items": [' || chr(10)
       || string_agg('    {' || chr(10)
                     || '      "id": ' || o_orderkey || ',' || chr(10)
                     || '      "price": ' || regexp_replace(cast(o_totalprice as varchar), '\\.0$', '')
                     || ',' || chr(10)
                     || '      "status": "' || o_orderstatus || '"' || chr(10) || '    }',
                     ',' || chr(10) order by rank)
       || chr(10) || '  ]' || chr(10) || '}' as document
from (select o_orderkey, o_totalprice, o_orderstatus,
             row_number() over (order by o_totalprice desc, o_orderkey) as rank
      from orders qualify rank <= 20)""")
def q_json_envelope(spark, sf):
    f = limit_items(sort_items(items(spark, sf, "orders", "o_orderkey"), "o_totalprice", "desc"), 20)
    m = map_fields(f, "id:o_orderkey, price:o_totalprice, status:o_orderstatus")
    return json_envelope(m, 20)


@query("webhook_batches", """
select (rn - 1) // 500 as batch, count(*) as count, min(rn) as first_position
from (select row_number() over (order by o_orderdate, o_orderkey) as rn from orders) group by all""")
def q_webhook_batches(spark, sf):
    f = items(spark, sf, "orders", ["o_orderdate", "o_orderkey"])
    return webhook_payloads(f, 500).select("batch", "count", "first_position")


# ---------------------------------------------------------------------------
# Saved and published outputs (events / orders as versions)
# ---------------------------------------------------------------------------

@query("latest_output", """
select user_id, event_type, event_id from events
qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""")
def q_latest_output(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    return latest_versions(ev, keys=["user_id", "event_type"], ts="ts", tie="event_id") \
        .select("user_id", "event_type", "event_id")


_ORDER_VERSIONS_SQL = """
with v as (select o_custkey as flow_id, case when o_orderstatus = 'F' then 'json' else 'rss' end as format,
                  o_orderkey, o_orderdate from orders),
l as (select * from v qualify row_number() over (partition by flow_id, format
                                                 order by o_orderdate desc, o_orderkey desc) = 1)"""


def _order_versions(spark, sf):
    o = table(spark, sf, "orders")
    v = o.select(F.col("o_custkey").alias("flow_id"),
                 F.when(F.col("o_orderstatus") == "F", "json").otherwise("rss").alias("format"),
                 "o_orderkey", F.col("o_orderdate").alias("created_at"))
    latest = latest_versions(v, ts="created_at", tie="o_orderkey")
    flows = table(spark, sf, "customer").select(F.col("c_custkey").alias("flow_id"),
                                                (F.col("c_acctbal") > 0).alias("is_public"))
    return flows, latest


@query("published_outputs", _ORDER_VERSIONS_SQL + """
select c.c_custkey as flow_id, l.o_orderkey from customer c join l on l.flow_id = c.c_custkey
where c.c_acctbal > 0 and l.format = 'json'""")
def q_published_outputs(spark, sf):
    flows, latest = _order_versions(spark, sf)
    return published_outputs(flows, latest, "json").select("flow_id", "o_orderkey")


@query("flows_to_run", _ORDER_VERSIONS_SQL + """
select c_custkey as flow_id from customer
where c_acctbal > 0 and c_custkey not in (select flow_id from l where format = 'json')""")
def q_flows_to_run(spark, sf):
    flows, latest = _order_versions(spark, sf)
    return flows_to_run(flows, latest, "json")


# ---------------------------------------------------------------------------
# R: run history (orders = runs, lineitem = log lines, customer = owners)
# ---------------------------------------------------------------------------

@query("recent_runs", """
select o_custkey as flow_id, o_orderkey as id,
       row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n
from orders qualify n <= 10""")
def q_recent_runs(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("flow_id"),
                                             F.col("o_orderkey").alias("id"),
                                             F.col("o_orderdate").alias("started_at"))
    return recent_runs(runs, 10).select("flow_id", "id", "n")


@query("run_log", """
select l_orderkey as execution_id, l_linenumber as seq,
       row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber) as line
from lineitem""")
def q_run_log(spark, sf):
    logs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("execution_id"),
                                               F.col("l_linenumber").alias("seq"),
                                               F.col("l_shipdate").alias("timestamp"))
    return run_log(logs).select("execution_id", "seq", "line")


@query("owner_logs", """
select l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey
where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def q_owner_logs(spark, sf):
    logs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("flow_id"))
    flows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return owner_logs(logs, runs, flows, F.col("c_mktsegment") == "BUILDING",
                      run_key=("l_orderkey", "id"), flow_key=("flow_id", "id"))


# ---------------------------------------------------------------------------
# C: flow composer, run record
# ---------------------------------------------------------------------------

FLOW_E2E = {
    "version": "1",
    "nodes": [
        {"id": "docs", "type": "table-source", "config": {"table": "documents", "order_by": "doc_id"}},
        {"id": "bench", "type": "table-source", "config": {"table": "benchmark", "order_by": "item_id"}},
        {"id": "m", "type": "merge", "config": {"dedupe_field": "text", "sort_field": "n_chars",
                                                "sort_order": "desc"}},
        {"id": "f", "type": "filter", "config": {"field": "text", "operator": "contains", "value": "the"}},
        {"id": "p", "type": "map", "config": {"mappings": "title:source, body:text, id:doc_id, item:item_id",
                                              "keep_original": False}},
        {"id": "t", "type": "truncate", "config": {"field": "body", "max_length": 100}},
        {"id": "l", "type": "limit", "config": {"count": 25}},
    ],
    "connections": [
        {"id": "1", "source": "docs", "target": "m"}, {"id": "2", "source": "bench", "target": "m"},
        {"id": "3", "source": "m", "target": "f"}, {"id": "4", "source": "f", "target": "p"},
        {"id": "5", "source": "p", "target": "t"}, {"id": "6", "source": "t", "target": "l"},
    ],
}

_FLOW_E2E_BASE = """
select doc_id, item_id, source, text, rank from (
  select *, row_number() over (order by n_chars desc nulls first, src, doc_id, item_id) as rank
  from (select * from (select doc_id, null::bigint as item_id, source, text, n_chars, 0 as src from documents
                       union all select null, item_id, null, text, null, 1 from benchmark)
        qualify row_number() over (partition by text order by src, doc_id, item_id) = 1)
  where contains(lower(text), 'the')
  qualify rank <= 25)"""


@query("flow_e2e", "select doc_id as id, item_id as item, source as title, text as body, rank from ("
       + sql_truncate(_FLOW_E2E_BASE, "doc_id, item_id, source, rank", "text", 100) + ")")
def q_flow_e2e(spark, sf):
    from .plans.flow import run_flow
    res = run_flow(spark, FLOW_E2E, {"documents": table(spark, sf, "documents"),
                                     "benchmark": table(spark, sf, "benchmark")})
    return ranked(res.outputs["l"], "id", "item", "title", "body")


FLOW_RECORD = {
    "nodes": [
        {"id": "src", "type": "table-source", "config": {"table": "events", "order_by": "event_id"}},
        {"id": "f", "type": "filter", "config": {"field": "event_type", "operator": "equals",
                                                 "value": "purchase"}},
        {"id": "out", "type": "json-output", "config": {}},
    ],
    "connections": [{"id": "1", "source": "src", "target": "f"}, {"id": "2", "source": "f", "target": "out"}],
}


@query("flow_run_record", """
select 'success' as status, count(*) as items_processed from events where event_type = 'purchase'""")
def q_flow_run_record(spark, sf):
    import uuid

    from .plans.flow import run_flow
    from .session import scratch_path
    base = scratch_path(spark, f"flow_run_record/{uuid.uuid4().hex}")
    res = run_flow(spark, FLOW_RECORD, {"events": table(spark, sf, "events")}, out_dir=f"{base}/out",
                   runs_table=f"{base}/runs", flow_id="events-purchases")
    runs = spark.read.parquet(f"{base}/runs")
    return runs.where(F.col("id") == res.id).select("status", "items_processed")


# ---------------------------------------------------------------------------
# X: incremental runs (Structured Streaming)
# ---------------------------------------------------------------------------

def _stream_out(spark, name):
    import uuid

    from .session import scratch_path
    return scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex}")


_PART = "case when event_id is null then cast(0 as bigint) else ((event_id % 3) + 3) % 3 end"


def _landings(spark, sf, base):
    """events landed in three parts, one after another: after each landing a
    stream over the folder, for a run that takes what is new (one micro-batch)."""
    from .streaming.incremental import read_stream
    ev = table(spark, sf, "events")
    for part in range(3):
        ev.where(F.coalesce(F.pmod("event_id", F.lit(3)), F.lit(0)) == part).write.mode("append").parquet(f"{base}/land")
        yield read_stream(spark, f"{base}/land/", ev.schema)


@query("stream_dedupe", "select distinct user_id from events")
def q_stream_dedupe(spark, sf):
    """First seen per key over three landings; the delay spans the data, so no key is forgotten."""
    from .streaming.incremental import dedupe_stream, incremental_run
    base = _stream_out(spark, "dedupe")
    for s in _landings(spark, sf, base):
        d = dedupe_stream(s.select("event_id", "user_id", "ts"), ["user_id"], "ts", "36500 days")
        incremental_run(d, lambda f: f, f"{base}/out", "dedupe", f"{base}/_ckpt")
    return spark.read.parquet(f"{base}/out").select("user_id")


@query("stream_dedupe_returning", f"""
select {_PART} as landing, event_id, user_id, event_type from events
qualify row_number() over (partition by user_id, event_type order by landing, event_id) = 1""")
def q_stream_dedupe_returning(spark, sf):
    """Keys that return in later landings, whatever the time between: the state table knows them."""
    from .streaming.state import dedupe_forever
    base = _stream_out(spark, "dedupe-returning")
    for s in _landings(spark, sf, base):
        dedupe_forever(s, ["user_id", "event_type"], ["event_id"], f"{base}/out", f"{base}/state", "returning", f"{base}/_ckpt")
    return spark.read.parquet(f"{base}/out").select(F.col("batch_id").cast("bigint").alias("landing"), "event_id", "user_id", "event_type")


@query("stream_top_overall", """
select event_id, value, row_number() over (order by value desc nulls last, event_id) as rank from events qualify rank <= 50""")
def q_stream_top_overall(spark, sf):
    """The top of all landings so far, carried from batch to batch."""
    from .feed import OrderKey
    from .streaming.state import latest_top, top_overall
    base = _stream_out(spark, "top-overall")
    order = [OrderKey("value", descending=True), OrderKey("event_id")]
    for s in _landings(spark, sf, base):
        top_overall(s.select("event_id", "value"), order, 50, f"{base}/state", "top-overall", f"{base}/_ckpt")
    return ranked(Feed(latest_top(spark, f"{base}/state", "event_id bigint, value double"), order), "event_id", "value")


@query("stream_skip_unchanged", f"""
with e as (select {_PART} as landing, event_id, user_id, event_type, ts, sha256(event_type) as h from events)
select landing, event_id, user_id, event_type from e
qualify lag(h) over (partition by user_id order by landing, ts, h, event_id) is distinct from h""")
def q_stream_skip_unchanged(spark, sf):
    """Events as fetches of their user's payload (the event type): only changes come out."""
    from .streaming.state import changed_payloads_stream
    base = _stream_out(spark, "skip-unchanged")
    for s in _landings(spark, sf, base):
        # the time is made unique by the id, so that equal payloads of one moment have an order
        fetched = F.struct("ts", F.sha2("event_type", 256).alias("h"), "event_id")
        changed_payloads_stream(s.withColumn("fetched", fetched), f"{base}/out", f"{base}/state", "skip", "user_id", "event_type",
                                "fetched", f"{base}/_ckpt")
    return spark.read.parquet(f"{base}/out").select(F.col("batch_id").cast("bigint").alias("landing"), "event_id", "user_id", "event_type")


@query("stream_incremental", """
select event_id, user_id as who, value as amount from events where event_type = 'purchase'""")
def q_stream_incremental(spark, sf):
    from .streaming.incremental import incremental_run, read_stream
    ev = table(spark, sf, "events")
    base = _stream_out(spark, "incremental")
    s = read_stream(spark, f"{sf.rstrip('/')}/events.parquet", ev.schema, single_file=True)

    def flow(f):
        f = filter_items(f, "event_type", "equals", "purchase", spark)
        return map_fields(f, "event_id:event_id, who:user_id, amount:value")
    incremental_run(s, flow, f"{base}/out", "incremental", f"{base}/_ckpt")
    return spark.read.parquet(f"{base}/out").select("event_id", "who", "amount")


@query("skip_unchanged", f"""
select {FEED_URL_SQL} as feed_url from documents group by all
having bool_or(lang = 'de' and upper(text) <> text)""")
def q_skip_unchanged(spark, sf):
    from .streaming.incremental import changed_payloads, payload_hash
    docs = document_items(spark, sf)
    current = feed_payloads(spark, sf, docs)
    edited = docs.withColumn("description", F.when(F.col("lang") == "de", F.upper("description"))
                             .otherwise(F.col("description")))
    previous = feed_payloads(spark, sf, edited)
    older = current  # an older fetch equal to today's: must not count, the newest fetch decides
    seen = older.select("feed_url", payload_hash().alias("payload_hash"), F.lit(0).alias("fetched_at")) \
        .unionByName(previous.select("feed_url", payload_hash().alias("payload_hash"),
                                     F.lit(1).alias("fetched_at")))
    return changed_payloads(current, seen).select("feed_url")


# ---------------------------------------------------------------------------
# more outputs: JSON lines, RSS documents per feed, webhook delivery
# ---------------------------------------------------------------------------

@query("json_lines_out", """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders
where o_orderstatus = 'O'""")
def q_json_lines_out(spark, sf):
    import uuid

    from .session import scratch_path
    from .sinks.documents import write_json_lines
    path = scratch_path(spark, f"json_lines_out/{uuid.uuid4().hex}")
    f = filter_items(items(spark, sf, "orders", "o_orderkey"), "o_orderstatus", "equals", "O")
    f = map_fields(f, "o_orderkey:o_orderkey, o_custkey:o_custkey, o_orderstatus:o_orderstatus, "
                      "o_totalprice:o_totalprice, o_orderpriority:o_orderpriority")
    write_json_lines(f, path)
    return spark.read.schema("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                             "o_orderpriority string").json(current_output(spark, path))


def _sql_text(text: str) -> str:
    """A Python string as a DuckDB expression (newlines via chr(10))."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_RSS_HEAD, _RSS_TAIL = (_sql_text(x) for x in rss_channel("Documents", "documents as feed items",
                                                          "http://example.com/"))


@query("rss_feed_documents", f"""
select feed_url, count(*) as count,
       {_RSS_HEAD} || string_agg(fragment, '' order by doc_id) || {_RSS_TAIL} as document
from (select {FEED_URL_SQL} as feed_url, doc_id, fragment
      from (@RSS_ITEMS@) join documents using (doc_id))
group by feed_url""".replace("@RSS_ITEMS@", ORACLE["rss_items"]))
def q_rss_feed_documents(spark, sf):
    docs = document_items(spark, sf)
    out = rss_document(Feed.from_table(docs, "doc_id"), title="Documents", description="documents as feed items",
                       link="http://example.com/", group_cols=["feed_url"], limit=FEED_GROUP)
    return out.select("feed_url", "count", "document")


@query("webhook_delivery", """
select (rn - 1) // 250 as batch, (select count(*) from orders) as total, count(*) as count, min(o_orderkey) as first_key, max(o_orderkey) as last_key
from (select o_orderkey, row_number() over (order by o_orderkey) as rn from orders) group by all""")
def q_webhook_delivery(spark, sf):
    import uuid

    from .session import scratch_path
    from .sinks.webhook import deliver
    target = scratch_path(spark, f"webhook_delivery/{uuid.uuid4().hex}")
    f = map_fields(items(spark, sf, "orders", "o_orderkey"), "key:o_orderkey")
    deliver(webhook_payloads(f, 250), target)
    sent = spark.read.text(target).select(
        F.from_json("value", "batch bigint, total bigint, count bigint, items array<struct<key bigint>>").alias("p"))
    return sent.select(F.col("p.batch").alias("batch"), F.col("p.total").alias("total"), F.col("p.count").alias("count"),
                       F.array_min(F.col("p.items.key")).alias("first_key"),
                       F.array_max(F.col("p.items.key")).alias("last_key"))


@query("json_limit_per_payload", f"""
select cast(event_id as double) as event_id from events
qualify row_number() over (partition by event_id // {PAYLOAD_ITEMS} order by event_id) <= 3""")
def q_json_limit_per_payload(spark, sf):
    f = json_items(event_payloads(spark, sf), items_path="data.items", order_cols=["payload_id"], limit=3)
    return f.df.select("event_id")


@query("flow_node_counts", """
select 'src' as node_id, count(*) as n from events
union all select 'f', count(*) from events where event_type = 'click'
union all select 'l', least(count(*), 100) from events where event_type = 'click'""")
def q_flow_node_counts(spark, sf):
    import uuid

    from .plans.flow import run_flow
    from .session import scratch_path
    base = scratch_path(spark, f"flow_node_counts/{uuid.uuid4().hex}")
    cfg = {"nodes": [
        {"id": "src", "type": "table-source", "config": {"table": "events", "order_by": "event_id"}},
        {"id": "f", "type": "filter", "config": {"field": "event_type", "operator": "equals", "value": "click"}},
        {"id": "l", "type": "limit", "config": {"count": 100}},
        {"id": "out", "type": "json-output", "config": {}}],
        "connections": [{"source": "src", "target": "f"}, {"source": "f", "target": "l"},
                        {"source": "l", "target": "out"}]}
    res = run_flow(spark, cfg, {"events": table(spark, sf, "events")}, out_dir=base, observe_nodes=True)
    # one row per node of the flow description (bounded by its size)
    return spark.createDataFrame(sorted(res.node_counts.items()), "node_id string, n bigint")


@query("stream_top_per_batch", """
select cast(part as bigint) as part, event_id, value,
       row_number() over (partition by part order by value desc, event_id) as rank
from (select *, """ + _PART + """ as part from events) where event_type = 'purchase' qualify rank <= 10""")
def q_stream_top_per_batch(spark, sf):
    """The top of each of three landings."""
    from .streaming.incremental import foreach_batch_top
    base = _stream_out(spark, "top")

    def per_batch(f):
        f = limit_items(sort_items(filter_items(f, "event_type", "equals", "purchase"), "value", "desc"), 10)
        return Feed(f.df.withColumn("rank", rank_column(f)), f.ordering)
    for s in _landings(spark, sf, base):
        foreach_batch_top(s, per_batch, f"{base}/out", "top", ["event_id"], f"{base}/_ckpt")
    return spark.read.parquet(f"{base}/out").select(F.col("batch_id").cast("bigint").alias("part"), "event_id", "value", "rank")


STREAM_FLOW = {
    "nodes": [
        {"id": "src", "type": "rss-source", "config": {"url": "landed"}},
        {"id": "f", "type": "filter", "config": {"field": "description", "operator": "contains", "value": "the"}},
        {"id": "s", "type": "sort", "config": {"field": "title", "order": "asc"}},
        {"id": "l", "type": "limit", "config": {"count": 20}},
        {"id": "out", "type": "json-output", "config": {}},
    ],
    "connections": [{"source": "src", "target": "f"}, {"source": "f", "target": "s"},
                    {"source": "s", "target": "l"}, {"source": "l", "target": "out"}],
}


@query("stream_flow_runs", """
select 'doc ' || cast(doc_id as varchar) as title from documents
where contains(lower(text), 'the') order by title limit 20""")
def q_stream_flow_runs(spark, sf):
    """X1 with a flow description: documents landed as RSS payloads, read as
    a stream, the whole flow run once per micro-batch (one landing here)."""
    from .streaming.incremental import read_stream, run_flow_incremental
    base = _stream_out(spark, "flow")
    feed_payloads(spark, sf).write.parquet(f"{base}/land")
    land = spark.read.parquet(f"{base}/land")
    s = read_stream(spark, f"{base}/land/", land.schema)
    run_flow_incremental(spark, STREAM_FLOW, "landed", s, f"{base}/out", "flow", f"{base}/_ckpt")
    return spark.read.schema("title string").json(current_output(spark, f"{base}/out/batch=0/out")).select("title")


# ---------------------------------------------------------------------------
# whole flows, outputs compared field by field and in order
# ---------------------------------------------------------------------------

def _scratch(spark, name: str) -> str:
    import uuid

    from .session import scratch_path
    return scratch_path(spark, f"{name}/{uuid.uuid4().hex}")


def _chain(*nodes: dict) -> dict:
    return {"nodes": list(nodes), "connections": [{"source": a["id"], "target": b["id"]} for a, b in zip(nodes, nodes[1:])]}


@query("flow_feed_items_json", """
select cast(doc_id as varchar) as guid, 'doc ' || cast(doc_id as varchar) as title, text as description,
       text as content, 'http://example.com/' || source || '/' || cast(doc_id as varchar) as link, lang as author,
       n_chars * 86400 as published_at, '' as updated, cast(0 as bigint) as updated_at, '' as image,
       lang || ',' || source as categories,
       'author,categories,content,description,guid,image,link,published,published_at,title,updated,updated_at' as fields
from documents""")
def q_flow_feed_items_json(spark, sf):
    """Every field of the written items of a feed flow, and no other."""
    from .plans.flow import run_flow
    base = _scratch(spark, "flow_feed_items_json")
    cfg = _chain({"id": "s", "type": "rss-source", "config": {"url": "landed"}}, {"id": "o", "type": "json-output"})
    run_flow(spark, cfg, {"landed": feed_payloads(spark, sf)}, out_dir=base)
    lines = spark.read.text(current_output(spark, f"{base}/o"))
    item = F.from_json("value", "guid string, title string, description string, content string, link string, author string, "
                                "published_at bigint, updated string, updated_at bigint, image string, categories array<string>")
    return lines.select(item.alias("i"), F.array_join(F.array_sort(F.json_object_keys("value")), ",").alias("fields")) \
        .select("i.*", "fields").withColumn("categories", F.array_join("categories", ","))


@query("flow_rss_output", """
select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as title,
       row_number() over (order by l_orderkey, l_linenumber) as rank from lineitem""")
def q_flow_rss_output(spark, sf):
    """An RSS document of any number of items, read back in document order."""
    from .plans.flow import run_flow
    base = _scratch(spark, "flow_rss_output")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(
        "-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("title"))
    cfg = _chain({"id": "s", "type": "table-source", "config": {"table": "t", "order_by": ["l_orderkey", "l_linenumber"]}},
                 {"id": "o", "type": "rss-output", "config": {"title": "Lines"}})
    run_flow(spark, cfg, {"t": rows}, out_dir=base)
    lines = spark.read.text(current_output(spark, f"{base}/o")).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    titles = lines.where(F.col("value").startswith("      <title>")) \
        .withColumn("title", F.regexp_extract("value", "<title>(.*)</title>", 1))
    return global_rank(Feed.from_table(titles, ["file", "at"])).df.select("title", "rank")


LARGE_LIMIT = 150_000


@query("flow_limit_large", f"""
select l_returnflag, count(*) as n, cast(sum(l_orderkey) as bigint) as keys from (
  select l.*, row_number() over (order by copy, l_orderkey, l_linenumber) as rn
  from lineitem l, (values (0), (1), (2), (3)) c(copy)) where rn <= {LARGE_LIMIT} group by l_returnflag""")
def q_flow_limit_large(spark, sf):
    """A limit beyond the top-k plan: four inputs merged, cut inside one of them."""
    from .plans.flow import run_flow
    base = _scratch(spark, "flow_limit_large")
    cfg = _chain({"id": "s", "type": "table-source", "config": {"table": "t", "order_by": ["l_orderkey", "l_linenumber"]}},
                 {"id": "m", "type": "merge", "config": {}}, {"id": "l", "type": "limit", "config": {"count": LARGE_LIMIT}},
                 {"id": "o", "type": "json-output"})
    cfg["connections"] += [{"source": "s", "target": "m"}] * 3
    run_flow(spark, cfg, {"t": table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")}, out_dir=base)
    out = spark.read.schema("l_orderkey bigint, l_returnflag string").json(current_output(spark, f"{base}/o"))
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("saved_versions_latest", """
select 'f' || cast(s_nationkey as varchar) as flow_id, max_by(s_name, s_suppkey) as content from supplier group by all""")
def q_saved_versions_latest(spark, sf):
    """Several saves with one time stamp: the last one is the published document."""
    from .sinks.versions import VERSION_SCHEMA, latest_documents, save_output
    base = _scratch(spark, "saved_versions_latest")
    rows = table(spark, sf, "supplier").select("s_nationkey", "s_name", F.row_number().over(
        Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("rn"), F.count(F.lit(1)).over(
        Window.partitionBy("s_nationkey")).alias("n"))
    for back in (2, 1, 0):  # the last three suppliers of each nation, oldest first
        docs = rows.where(F.col("rn") == F.col("n") - back).select(
            F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("flow_id"), F.col("s_name").alias("document"))
        save_output(spark, base, F.col("flow_id"), "json", docs, "text/plain", created_at=7)
    return latest_documents(spark.read.schema(VERSION_SCHEMA).parquet(base)).select("flow_id", "content")


@query("feed_atom_items", """
select cast(doc_id as varchar) as guid, 'doc ' || cast(doc_id as varchar) as title, text as content,
       'http://example.com/' || cast(doc_id as varchar) as link, lang as author,
       cast(1136214245 as bigint) as updated_at, 'audio/mpeg' as enclosure_type from documents""")
def q_feed_atom_items(spark, sf):
    """Documents landed as Atom payloads of <= 16 entries, with enclosures (S5) and content (S3)."""
    from .sinks.documents import xml_escape
    el = lambda tag, c: F.concat(F.lit(f"<{tag}>"), xml_escape(c), F.lit(f"</{tag}>"))
    key = F.col("doc_id").cast("string")
    entry = F.concat(F.lit("<entry>"), el("title", F.concat(F.lit("doc "), key)), el("id", key), el("content", F.col("text")),
                     F.lit("<summary>short</summary><updated>2006-01-02T15:04:05Z</updated><author>"), el("name", F.col("lang")),
                     F.lit("</author><link rel='enclosure' type='audio/mpeg' length='9' href='u'/><link href='http://example.com/"),
                     key, F.lit("'/></entry>"))
    landed = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / FEED_GROUP).alias("feed_url"), "doc_id",
                                                  entry.alias("entry")) \
        .groupBy("feed_url").agg(F.concat(
            F.lit("<?xml version='1.0'?><feed xmlns='http://www.w3.org/2005/Atom'>"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))), lambda e: e["entry"]), ""),
            F.lit("</feed>")).alias("payload"))
    return feed_items(landed, keep=[]).df.select("guid", "title", "content", "link", "author", "updated_at",
                                                 F.col("enclosures")[0]["type"].alias("enclosure_type"))


_ORDERS_IN_ORDER = "select o_orderkey, row_number() over (order by o_orderkey) as rank from orders"


@query("flow_unordered_output", f"""
select 'json' as form, cast(o_orderkey as varchar) as title, rank from ({_ORDERS_IN_ORDER})
union all select 'rss', cast(o_orderkey as varchar), rank from ({_ORDERS_IN_ORDER})""")
def q_flow_unordered_output(spark, sf):
    """A source without an ordering: items leave in the order in which its (uneven) partitions hold them."""
    from .plans.flow import run_flow
    base = _scratch(spark, "flow_unordered_output")
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(key, key.cast("string").alias("title"))
    parts = rows.repartitionByRange(6, F.floor(F.sqrt(key)), key).sortWithinPartitions(key)
    cfg = {"nodes": [{"id": "s", "type": "table-source", "config": {"table": "t"}}, {"id": "j", "type": "json-output"},
                     {"id": "r", "type": "rss-output", "config": {}}],
           "connections": [{"source": "s", "target": "j"}, {"source": "s", "target": "r"}]}
    run_flow(spark, cfg, {"t": parts}, out_dir=base)

    def in_order(form, pattern):
        lines = spark.read.text(current_output(spark, f"{base}/{form[0]}")).select(
            F.regexp_extract("value", pattern, 1).alias("title"), F.col("_metadata.file_path").alias("file"),
            F.monotonically_increasing_id().alias("at")).where(F.col("title") != "")
        return global_rank(Feed.from_table(lines, ["file", "at"])).df.select(F.lit(form).alias("form"), "title", "rank")
    return in_order("json", '"title":"([^"]*)"').unionByName(in_order("rss", "^      <title>([^<]*)</title>"))


@query("flow_published_again", """
select o_orderstatus, count(*) as n from orders where o_orderstatus <> 'F' group by all""")
def q_flow_published_again(spark, sf):
    """Two runs into one output: the pointer names the second, an empty third changes nothing."""
    from .plans.flow import run_flow
    base = _scratch(spark, "flow_published_again")
    cfg = _chain({"id": "s", "type": "table-source", "config": {"table": "t", "order_by": "o_orderkey"}}, {"id": "o", "type": "json-output"})
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for rows in (orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), orders.where("o_orderkey < 0")):
        run_flow(spark, cfg, {"t": rows}, out_dir=base)
    return spark.read.schema("o_orderstatus string").json(current_output(spark, f"{base}/o")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("webhook_ledger", """
select (rn - 1) // 100 as batch, count(*) as count, 1 as times
from (select row_number() over (order by c_custkey) as rn from customer) group by all""")
def q_webhook_ledger(spark, sf):
    """A delivery that was broken off and repeated: the ledger leaves every batch sent once."""
    from .sinks.documents import webhook_batches
    from .sinks.webhook import deliver
    base = _scratch(spark, "webhook_ledger")
    payloads, _ = webhook_batches(map_fields(items(spark, sf, "customer", "c_custkey"), "key:c_custkey"), 100)
    deliver(payloads.where("batch % 3 <> 1"), f"{base}/hook", ledger=f"{base}/ledger")  # what got through before
    for _ in range(2):
        deliver(payloads, f"{base}/hook", ledger=f"{base}/ledger")
    sent = spark.read.text(f"{base}/hook").select(F.from_json("value", "batch bigint, count bigint").alias("p"))
    return sent.groupBy(F.col("p.batch").alias("batch"), F.col("p.count").alias("count")).agg(F.count(F.lit(1)).cast("int").alias("times"))
