import math
from collections import Counter, defaultdict

import pytest

from sluice.llm.q_sharding import GROWN, TOPOLOGY, op2_hash_tree_shards
from sluice.llm.sharding import Shard, assign_shards, children, default_topology, grow, number_slots


def shards(spark, topology, n=6000, seed="shard"):
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    return {r["doc_id"]: (r["region"], r["rack"], r["shard"]) for r in assign_shards(df, "doc_id", topology, seed).collect()}


def test_growth_moves_rows_into_the_new_shard_only(spark):
    before, after = shards(spark, TOPOLOGY), shards(spark, GROWN)
    moved = [k for k in before if before[k] != after[k]]
    assert {after[k][2] for k in moved} == {24}
    assert abs(len(moved) - 6000 / 25) < 5 * math.sqrt(6000 / 25)


def test_weights_set_the_shares_and_confine_movement(spark):
    base = [Shard(i // 4, i % 4 // 2, i, 1.0 + i % 3) for i in range(12)]
    got = Counter(s for _, _, s in shards(spark, base).values())
    total = sum(s.weight for s in base)
    for s in base:
        want = 6000 * s.weight / total
        assert abs(got[s.shard] - want) < 5 * math.sqrt(want)
    # a heavier shard in region 1: rows of other regions stay, or move into region 1
    changed = [Shard(s.region, s.rack, s.shard, s.weight * (3 if s.shard == 5 else 1)) for s in base]
    before, after = shards(spark, base), shards(spark, changed)
    for k, (region, rack, shard) in before.items():
        if after[k] != before[k]:
            assert after[k][0] == 1
        if region != 1 and after[k][0] == region:
            assert after[k] == before[k]


def test_a_shard_without_weight_gets_no_rows(spark):
    topology = default_topology(6)[:-1] + [Shard(0, 1, 5, 0.0)]
    assert 5 not in {s for _, _, s in shards(spark, topology, 500).values()}
    with pytest.raises(ValueError):
        children([Shard(0, 0, 1), Shard(0, 0, 1)])
    with pytest.raises(ValueError):
        children([Shard(0, 0, 1, 0.0)])
    assert len(grow(topology)) == 7


def test_edge_rows_and_clashing_names(spark):
    rows = [(None, "x", 1), (None, "y", 2), (7, "z", 3), (7, "z", 3), (8, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, shard string, __n int")
    out = assign_shards(df, "doc_id", TOPOLOGY).collect()
    assert len(out) == 5 and len({r["shard"] for r in out if r["doc_id"] == 7}) == 1
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    assert sorted(r["__n"] for r in out) == [1, 2, 3, 3, 4]
    assert assign_shards(df.limit(0), "doc_id", TOPOLOGY).collect() == []


def test_slots_are_gapless_with_a_hot_row(spark):
    hot = spark.range(150_000).selectExpr("cast(5 as long) as doc_id", "0 as shard")
    rest = spark.range(500).selectExpr("id as doc_id", "cast(id % 3 as int) as shard")
    none = spark.createDataFrame([(None, 1)] * 3, "doc_id long, shard int")
    out = number_slots(hot.unionAll(rest).unionAll(none), "shard", "doc_id")
    slots = defaultdict(list)
    for r in out.collect():
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == 150_503
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert number_slots(none.limit(0), "shard", "doc_id").collect() == []


def test_one_key_with_many_rows_is_spread(spark):
    rows = spark.range(20_000).selectExpr("cast(7 as long) as doc_id", "id as size", "0 as shard")
    out = number_slots(rows, "shard", "doc_id").orderBy("slot").collect()
    assert [r["slot"] for r in out] == list(range(20_000))
    jumps = sum(a["size"] > b["size"] for a, b in zip(out, out[1:]))
    assert jumps > 1000  # many buckets, each in order of its own


def test_query_covers_all_documents(spark):
    import zlib
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op2_hash_tree_shards(spark, sf).collect()
    assert {r["doc_id"] for r in out} == set(docs) and len(out) == len(docs)
    for r in out:
        data = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "key"
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
