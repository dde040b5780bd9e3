"""Hand-computed seeds (FIXTURES.md section 2) for filter, sort, limit, merge, map."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import feed_of, ordered_values
from sluice.operators.fields import map_fields, regex_replace
from sluice.operators.filter import filter_items
from sluice.operators.limit import limit_items
from sluice.operators.merge import merge
from sluice.operators.sort import sort_items


def ids(feed):
    return ordered_values(feed, "i")


# -- filter -----------------------------------------------------------------

def test_filter_missing_field_text_is_nil(spark):
    f = feed_of(spark, [(1, None), (2, "x")], "i int, a string")
    assert ids(filter_items(f, "a", "contains", "NIL")) == [1]
    assert ids(filter_items(f, "a", "equals", "")) == []
    assert ids(filter_items(f, "a", "not-equals", "x")) == [1]
    assert ids(filter_items(f, "nope", "not-equals", "x")) == [1, 2]
    assert ids(filter_items(f, "nope", "equals", "<nil>")) == [1, 2]


def test_filter_lists_bools_numbers(spark):
    f = feed_of(spark, [(1, ["a", "b"], True, 1000000.0, 7)], "i int, l array<string>, b boolean, d double, n bigint")
    assert ids(filter_items(f, "l", "equals", "[a b]")) == [1]
    assert ids(filter_items(f, "b", "equals", "true")) == [1]
    assert ids(filter_items(f, "d", "equals", "1e+06")) == [1]
    assert ids(filter_items(f, "d", "equals", "1000000")) == []
    assert ids(filter_items(f, "n", "equals", "7")) == [1]
    assert ids(filter_items(f, "n", "equals", "07")) == []


def test_filter_bad_regex_and_unknown_operator(spark):
    f = feed_of(spark, [(1, "a"), (2, "b")], "i int, a string")
    assert ids(filter_items(f, "a", "regex", "[", spark)) == []
    assert ids(filter_items(f, "a", "foo", "zzz")) == [1, 2]
    assert ids(filter_items(f, "", "equals", "zzz")) == [1, 2]
    assert ids(filter_items(f, "a", "", "zzz")) == [1, 2]


def test_filter_nested_path(spark):
    f = feed_of(spark, [(1, ("x", [("y",)])), (2, ("z", []))], "i int, author struct<name:string, l:array<struct<q:string>>>")
    assert ids(filter_items(f, "author.name", "equals", "x")) == [1]
    # a list in the path yields nil
    assert ids(filter_items(f, "author.l.q", "equals", "<nil>")) == [1, 2]


def test_filter_partition_law(spark):
    f = feed_of(spark, [(i, None if i % 3 == 0 else str(i % 4)) for i in range(40)], "i int, a string")
    eq = set(ids(filter_items(f, "a", "equals", "1")))
    ne = set(ids(filter_items(f, "a", "not-equals", "1")))
    assert eq.isdisjoint(ne) and eq | ne == set(range(40))


# -- sort / limit -------------------------------------------------------------

def test_sort_numeric_with_missing(spark):
    f = feed_of(spark, [(1, 3.0), (2, None), (3, 1.0)], "i int, v double")
    assert ids(sort_items(f, "v", "asc")) == [3, 1, 2]
    assert ids(sort_items(f, "v", "desc")) == [2, 1, 3]


def test_sort_text_bytes_and_nil(spark):
    f = feed_of(spark, [(1, "b"), (2, None), (3, "1"), (4, "Z")], "i int, v string")
    assert [r for r in ids(sort_items(f, "v", "asc"))] == [3, 2, 4, 1]


def test_sort_numeric_text_is_text(spark):
    f = feed_of(spark, [(1, "9"), (2, "10")], "i int, v string")
    assert ids(sort_items(f, "v", "asc")) == [2, 1]


def test_sort_order_defaults_and_stability(spark):
    f = feed_of(spark, [(1, 1), (2, 2), (3, 1)], "i int, v int")
    assert ids(sort_items(f, "v", "")) == [2, 1, 3]       # empty -> desc, ties keep order
    assert ids(sort_items(f, "v", "ASC")) == [1, 3, 2]    # anything but desc -> asc
    assert ids(sort_items(f, "", "asc")) == [1, 2, 3]


@pytest.mark.parametrize("count,n", [(0, 3), (-1, 3), (None, 3), ("2", 3), (3, 3), (0.5, 0), (2.9, 2), (1, 1)])
def test_limit_edges(spark, count, n):
    f = feed_of(spark, [(1,), (2,), (3,)], "i int")
    assert ids(limit_items(f, count)) == [1, 2, 3][:n]


def test_limit_after_sort_is_topk(spark):
    f = feed_of(spark, [(i, (i * 7) % 11) for i in range(30)], "i int, v int")
    top = ids(limit_items(sort_items(f, "v", "desc"), 5))
    full = ids(sort_items(f, "v", "desc"))
    assert top == full[:5]


def test_large_limit_uses_global_rank(spark):
    from sluice.operators import limit as L
    old = L.TOPK_MAX_ROWS
    L.TOPK_MAX_ROWS = 3
    try:
        f = feed_of(spark, [(i, (i * 7) % 11) for i in range(30)], "i int, v int")
        got = ids(limit_items(sort_items(f, "v", "asc"), 10))
        assert got == ids(sort_items(f, "v", "asc"))[:10]
    finally:
        L.TOPK_MAX_ROWS = old


# -- merge / dedupe -------------------------------------------------------------

def test_merge_concat_in_connection_order(spark):
    a = feed_of(spark, [(3,), (1,)], "i int", order=None)
    a = feed_of(spark, [(2, 3), (1, 1)], "pos int, i int", order="pos")
    b = feed_of(spark, [(1, 2)], "pos int, i int", order="pos")
    assert ids(merge([a, b])) == [1, 3, 2]
    assert ids(merge([b, a])) == [2, 1, 3]
    assert ids(merge([a, a])) == [1, 3, 1, 3]


def test_merge_sort_default_is_ascending(spark):
    a = feed_of(spark, [(1, 2), (2, 1)], "i int, v int")
    assert ids(merge([a], sort_field="v")) == [2, 1]
    assert ids(merge([a], sort_field="v", sort_order="desc")) == [1, 2]


def test_dedupe_canonical_key_first_wins(spark):
    a = feed_of(spark, [(1, 1, None, None)], "i int, id bigint, x int, y int")
    b = feed_of(spark, [(2, "1", None, None), (3, None, 0, None), (4, None, None, 0)],
                "i int, id string, x int, y int")
    assert ids(merge([a, b], dedupe_field="id")) == [1, 3]


def test_dedupe_uses_flat_key(spark):
    f = feed_of(spark, [(1, (1,)), (2, (2,))], "i int, a struct<b:int>")
    assert ids(merge([f], dedupe_field="a.b")) == [1]


def test_dedupe_idempotent(spark):
    f = feed_of(spark, [(i, i % 4) for i in range(20)], "i int, k int")
    once = merge([f], dedupe_field="k")
    twice = merge([once], dedupe_field="k")
    assert ids(once) == ids(twice) == [0, 1, 2, 3]


def test_merge_type_clash(spark):
    a = feed_of(spark, [(1, 1)], "i int, v int")
    b = feed_of(spark, [(2, 2.5)], "i int, v double")
    c = feed_of(spark, [(3, "x")], "i int, v string")
    # every item keeps its own type and value
    from sluice.sinks.documents import item_json
    m2 = merge([a, b, c])
    assert dict(m2.df.dtypes)["v"] == "variant"
    assert [r[0] for r in m2.df.orderBy(*m2.order_columns()).select(item_json(m2)).collect()] == [
        '{"i":1,"v":1}', '{"i":2,"v":2.5}', '{"i":3,"v":"x"}']
    big = feed_of(spark, [(4, 2 ** 53 + 1)], "i int, v bigint")
    m3 = merge([b, big])
    assert [r[0] for r in m3.df.orderBy(*m3.order_columns()).select(item_json(m3)).collect()][1] == \
        '{"i":4,"v":9007199254740993}'
    assert dict(merge([a, big]).df.dtypes)["v"] == "bigint"
    twins = merge([a, feed_of(spark, [(5, "1")], "i int, v string")], dedupe_field="v")
    assert ids(twins) == [1]  # the canonical texts agree


def test_nested_variant_text(spark):
    from sluice.sources.json_source import json_items
    f = json_items(spark.createDataFrame([(0, '[{"i":1,"v":[1,"a",null,{"b":2}]},{"i":2,"v":"x"},{"i":3,"v":{"k":[true],"a":1.5}}]')],
                                         "src int, payload string"))
    assert ordered_values(filter_items(f, "v", "equals", "[1 a <nil> map[b:2]]"), "i") == [1.0]
    assert ordered_values(filter_items(f, "v", "equals", "map[a:1.5 k:[true]]"), "i") == [3.0]


def test_variant_text_at_any_depth(spark):
    from sluice.functions.values import canonical_text
    deep = '[[[[{"b":[1,{"z":"q\\"\\\\n,{}:","a":[null,true,1e10,0.5]}],"a \\\\":""}, 12345678901234567890, "\\u00e9,"]]]]'
    df = spark.createDataFrame([(deep,), ("[[[[]]]]",), ("[[[{}]]]",), ('{"a":{"b":{"c":{"d":[1,[2,[3]]]}}}}',),
                                ('[[["' + "x\\\\," * 20000 + '"]]]',)], "j string")
    got = [r[0] for r in df.select(F.parse_json("j").alias("v")).select(
        canonical_text(F.col("v"), T.VariantType())).collect()]
    assert got[0] == '[[[[map[a \\: b:[1 map[a:[<nil> true 1e+10 0.5] z:q"\\n,{}:]]] 12345678901234567890 é,]]]]'
    assert got[1:4] == ["[[[[]]]]", "[[[map[]]]]", "map[a:map[b:map[c:map[d:[1 [2 [3]]]]]]]"]
    assert got[4] == "[[[" + "x\\," * 20000 + "]]]"


def test_regex_empty_matches(spark):
    f = feed_of(spark, [(1, "baaac"), (2, ""), (3, "\U0001f600b"), (4, "aab")], "i int, s string")
    value = lambda p, r: [x[0] for x in regex_replace(f, "s", p, r, spark).df.orderBy("i").select("s").collect()]
    assert value("a*", "x") == ["xbxcx", "x", "x\U0001f600xbx", "xbx"]
    assert value("a*?", "x") == ["xbxaxaxaxcx", "x", "x\U0001f600xbx", "xaxaxbx"]
    assert value("(a)|", "<$1>") == ["<>b<a><a><a>c<>", "<>", "<>\U0001f600<>b<>", "<a><a>b<>"]
    assert value(r"\b", "|") == ["|baaac|", "", "\U0001f600|b|", "|aab|"]


def test_zeros_differ_as_texts(spark):
    f = feed_of(spark, [(1, 0.0), (2, -0.0)], "i int, v double")
    assert ids(filter_items(f, "v", "equals", "0")) == [1]
    assert ids(filter_items(f, "v", "not-equals", "0")) == [2]


# -- map -------------------------------------------------------------------------

def test_map_only_mapped_fields(spark):
    f = feed_of(spark, [(1, 1, (2,))], "i int, a int, b struct<c:int>")
    out = map_fields(f, "t:a, u:b.c , bad, :z", False)
    assert set(out.item_columns) == {"t", "u", ""} or set(out.item_columns) == {"t", "u"}
    r = out.df.first()
    assert (r["t"], r["u"]) == (1, 2)


def test_map_swap_and_keep(spark):
    f = feed_of(spark, [(1, 1, 2)], "i int, a int, b int")
    r = map_fields(f, "a:b, b:a", True).df.first()
    assert (r["a"], r["b"]) == (2, 1)


def test_map_nil_source_keeps_existing(spark):
    f = feed_of(spark, [(1, 1)], "i int, a int")
    assert map_fields(f, "a:zzz", True).df.first()["a"] == 1
    out = map_fields(f, "a:zzz", False)
    assert out.df.first()["a"] is None


def test_map_empty_mappings_pass(spark):
    f = feed_of(spark, [(1, 1)], "i int, a int")
    assert map_fields(f, "", False) is f


def test_contains_lowercases_per_character(spark):
    f = feed_of(spark, [(1, "İSTANBUL"), (2, "ΟΔΟΣ"), (3, "odos")], "i int, a string")
    assert ids(filter_items(f, "a", "contains", "istanbul")) == [1]
    assert ids(filter_items(f, "a", "contains", "οδοσ")) == [2]
    assert ids(filter_items(f, "a", "contains", "ΟΔΟΣ")) == [2]


def test_contains_fix_only_when_needle_needs_it(spark):
    f = feed_of(spark, [(1, "İXΣ"), (2, "ix")], "i int, a string")
    assert ids(filter_items(f, "a", "contains", "x")) == [1, 2]      # plain lower suffices
    assert ids(filter_items(f, "a", "contains", "ix")) == [1, 2]
    assert ids(filter_items(f, "a", "contains", "xσ")) == [1]


def test_merge_keeps_nested_structure_when_only_fields_differ(spark):
    a = feed_of(spark, [(1, ("x",))], "i int, author struct<name:string>")
    b = feed_of(spark, [(2, ("y", "e@x"))], "i int, author struct<name:string, email:string>")
    m = merge([a, b])
    assert dict(m.df.dtypes)["author"].startswith("struct")
    assert ordered_values(filter_items(m, "author.name", "equals", "y"), "i") == [2]
    c = feed_of(spark, [(3, (1.5,))], "i int, author struct<name:double>")
    m2 = merge([a, c])                      # text vs number inside: each keeps its own
    assert dict(m2.df.dtypes)["author"] == "variant"
    assert ordered_values(filter_items(m2, "author.name", "equals", "1.5"), "i") == [3]
    assert ordered_values(filter_items(m2, "author", "equals", "map[name:x]"), "i") == [1]


def test_dedupe_text_missing_and_nil_literal_share_a_key(spark):
    f = feed_of(spark, [(1, "a"), (2, None), (3, "<nil>"), (4, "a"), (5, None), (6, "b")], "i int, k string")
    assert ids(merge([f], dedupe_field="k")) == [1, 2, 6]
    g = feed_of(spark, [(1, "<nil>"), (2, None)], "i int, k string")
    assert ids(merge([g], dedupe_field="k")) == [1]


def test_fields_that_differ_by_case(spark):
    from sluice.feed import FieldCaseError
    from sluice.sources.json_source import json_items
    f = feed_of(spark, [(1, "a")], "i int, title string")
    doc = spark.createDataFrame([(0, '[{"id":1,"ID":2}]')], "src int, payload string")
    other = feed_of(spark, [(2, "b")], "i int, Title string")
    for act in (lambda: map_fields(f, "Title:title", True), lambda: json_items(doc), lambda: merge([f, other])):
        with pytest.raises(FieldCaseError):
            act()
    old = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        row = map_fields(f, "Title:title", True).items().first()
        assert row.asDict() == {"i": 1, "title": "a", "Title": "a"}
        assert json_items(doc).items().first().asDict() == {"id": 1.0, "ID": 2.0}
        assert {tuple(r.asDict().items()) for r in merge([f, other]).items().collect()} == {
            (("i", 1), ("title", "a"), ("Title", None)), (("i", 2), ("title", None), ("Title", "b"))}
    finally:
        spark.conf.set("spark.sql.caseSensitive", old)
