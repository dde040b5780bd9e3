"""Plan shape: no Python on the data path, top-k and two-phase dedupe,
pushed filters, and the catalogue's contract with the driver."""

import pytest

import __spark_entry__ as entry
from sluice import catalog  # the training-data operators may use Python; these may not
from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


SIDE_EFFECT = {"flow_run_record", "stream_dedupe", "stream_incremental", "stream_top_per_batch", "stream_dedupe_returning",
               "stream_top_overall", "stream_skip_unchanged",
               "json_lines_out", "webhook_delivery", "flow_node_counts", "stream_flow_runs", "flow_feed_items_json", "flow_unordered_output", "flow_published_again", "webhook_ledger",
               "flow_rss_output", "flow_limit_large", "saved_versions_latest"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SIDE_EFFECT))
def test_no_python_udf_in_plan(spark, name):
    p = plan(catalog.QUERIES[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_dedupe_is_two_phase(spark):
    p = plan(catalog.QUERIES["merge_dedupe"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p


def test_topk(spark):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["sort_numeric_top"](spark, SF_SMALL))


def test_equality_pushed_to_scan(spark):
    p = plan(catalog.QUERIES["filter_equals_number"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(value), EqualTo(value,6.55)]" in p


def test_entry_and_oracle_keys(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "source", "n_chars", "rank"]
    assert df.count() >= 0
    missing = set(catalog.QUERIES) - set(entry.oracle_sql())
    assert missing == set()


@pytest.mark.parametrize("name", ["merge_dedupe", "sort_text_nulls", "run_log", "webhook_batches",
                                  "dedupe_text_copies", "latest_output", "recent_runs",
                                  "limit_per_source_table", "merge_dedupe_sorted_top", "feed_summary"])
def test_same_result_at_other_partitionings(spark, name):
    fn = catalog.QUERIES[name]
    def rows():
        return sorted(repr(tuple(r)) for r in fn(spark, SF_SMALL).collect())
    base = rows()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows() == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_payloads_are_parsed_once(spark):
    from sluice.sources.feed_source import feed_items, feed_summary
    from sluice.sources.json_source import json_items
    landed = spark.createDataFrame([("a", '{"d":[[{"x":1}]]}')], "src string, payload string")
    for path in ("", "d", "d.0", "d.0.0", "d.0.0.x.3.4"):
        assert plan(json_items(landed, path, "x double").df).count("parseJson(") == 1, path
    feeds = spark.createDataFrame([("a", "<rss/>")], "feed_url string, payload string")
    for df in (feed_items(feeds).df, feed_summary(feeds)):
        assert plan(df).count("from_xml(") == 2  # one for each dialect


def test_text_dedupe_reads_its_input_once(spark):
    assert plan(catalog.QUERIES["dedupe_text_copies"](spark, SF_SMALL)).count("FileScan") == 1


def test_run_log_has_no_join_on_the_run_key(spark):
    p = plan(catalog.QUERIES["run_log"](spark, SF_SMALL))
    assert "SortMergeJoin" not in p and "ShuffledHashJoin" not in p


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_numbers_carry_over_partition_borders(spark, partitions):
    import random

    from pyspark.sql import functions as F

    from sluice.feed import Feed
    from sluice.plans.rank import rank_within
    r = random.Random(partitions)
    keys = ["hot"] * 300 + [None] * 90 + [f"k{i}" for i in range(40) for _ in range(r.randint(1, 9))]
    rows = [(k, i % 50, i) for i, k in enumerate(keys)]
    r.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = rank_within(Feed.from_table(spark.createDataFrame(rows, "k string, t int, n int"), ["t", "n"]), ["k"]).items()
        assert df.columns == ["k", "t", "n", "rank"]
        got = {x["n"]: x["rank"] for x in df.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {}
    for key in set(keys):
        for pos, (_, _, n) in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: x[1:]), 1):
            want[n] = pos
    assert got == want
    assert rank_within(Feed.from_table(spark.createDataFrame([], "k string, t int").select("*", F.lit(1).alias("z")), "t"), ["k"]).df.count() == 0
