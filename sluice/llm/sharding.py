"""Sharding by a hierarchical weighted hash tree (native).

A topology is a tree region -> rack -> shard with a weight on every shard;
a node weighs what its shards weigh together. A row descends the tree: at
each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the
row's key and the child's path, and the smallest draw wins (each child wins
in proportion to its weight). A draw depends on its own child only, so:

* changing a weight inside a subtree moves rows into or out of that subtree
  alone; draws elsewhere stay as they were;
* ``grow`` adds capacity as a region of its own, so one more shard takes rows
  into itself only and never exchanges rows between the others.

Defined cases: a null key is hashed as the text ``\\N``; rows with the same
key (repeated rows) meet in one shard; children of weight 0 never win; an
empty table gives an empty result; the added columns replace input columns
of the same name.

Everything is a column expression (one pass, no shuffle). ``number_slots``
adds gapless positions inside each shard with two shuffles of slim rows:
equal rows are counted first (a hot key collapses before it moves), and the
positions come from windows over (shard, bucket), never over a whole shard.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted

#: Buckets per shard for the numbering: three hex digits of the key's hash.
BUCKETS = 4096


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def default_topology(shards: int = 24, racks_per_region: int = 3, shards_per_rack: int = 4) -> list[Shard]:
    per_region = racks_per_region * shards_per_rack
    return [Shard(i // per_region, i % per_region // shards_per_rack, i) for i in range(shards)]


def grow(topology: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, as a region of its own."""
    return topology + [Shard(max(s.region for s in topology) + 1, 0,
                             max(s.shard for s in topology) + 1, weight)]


def children(topology: list[Shard]) -> dict[str, list[dict]]:
    """Parent path -> its children (path, number, weight), nodes of weight 0 left out."""
    if len({s.shard for s in topology}) != len(topology):
        raise ValueError("a shard number appears twice in the topology")
    tree: dict[str, dict[str, dict]] = {}
    for s in topology:
        if s.weight < 0:
            raise ValueError("weights must not be negative")
        if s.weight == 0:
            continue
        region, rack = f"r{s.region}", f"r{s.region}/k{s.rack}"
        for parent, path, number in (("", region, s.region), (region, rack, s.rack),
                                     (rack, f"{rack}/s{s.shard}", s.shard)):
            node = tree.setdefault(parent, {}).setdefault(path, {"p": path, "i": number, "w": 0.0})
            node["w"] += s.weight
    if not tree:
        raise ValueError("the topology has no shard with a weight")
    return {parent: list(nodes.values()) for parent, nodes in tree.items()}


def _uniform(key: Column, seed: str, path: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of key, seed and path."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{seed}|"), path)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def assign_shards(df: DataFrame, key: str, topology: list[Shard], seed: str = "shard",
                  names: tuple[str, str, str] = ("region", "rack", "shard")) -> DataFrame:
    """``df`` with region, rack and shard numbers for its key column."""
    text_key = F.coalesce(quoted(key).cast("string"), F.lit("\\N"))
    tree = F.from_json(F.lit(json.dumps(children(topology))), "map<string,array<struct<p:string,i:int,w:double>>>")

    def winner(parent: Column) -> Column:
        draws = F.transform(tree[parent], lambda c: F.struct(
            (-F.log(_uniform(text_key, seed, c["p"])) / c["w"]).alias("draw"), c["i"].alias("i"), c["p"].alias("p")))
        return F.array_min(draws)

    region_at, rack_at, shard_at = (fresh(n) for n in names)
    out = df.withColumn(region_at, winner(F.lit("")))
    out = out.withColumn(rack_at, winner(quoted(region_at)["p"]))
    out = out.withColumn(shard_at, winner(quoted(rack_at)["p"]))
    return out.withColumns({n: quoted(a)["i"] for n, a in zip(names, (region_at, rack_at, shard_at))}) \
        .drop(region_at, rack_at, shard_at)


def number_slots(df: DataFrame, shard: str, key: str, slot: str = "slot", by: list[str] | None = None) -> DataFrame:
    """Slim rows with a gapless position from 0 inside each shard, ordered by
    the row's hash bucket, the key and the remaining columns. The bucket comes from
    the columns ``by`` (all but the shard if not given), so one key with many
    different rows is spread over all buckets. Rows equal in all columns take
    neighbouring positions. A null key comes first in its bucket."""
    names = df.columns
    df = df.toDF(*[f"c{i}" for i in range(len(names))])
    spread = [f"c{names.index(c)}" for c in by or [c for c in names if c != shard]]
    key, shard = f"c{names.index(key)}", f"c{names.index(shard)}"
    columns = [quoted(c) for c in df.columns]
    bucket = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(quoted(c).cast("string"), F.lit("\\N")) for c in spread])), 1, 3), 16, 10).cast("int")
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__bucket", bucket)
    # at most (shards x BUCKETS) rows, whatever the input: small enough to broadcast
    sizes = counted.groupBy(quoted(shard), "__bucket").agg(F.sum("__n").alias("__size"))
    offsets = sizes.withColumn("__offset", F.sum("__size").over(
        Window.partitionBy(quoted(shard)).orderBy("__bucket")) - F.col("__size")) \
        .select(quoted(shard).alias("__s"), F.col("__bucket").alias("__b"), "__offset")
    order = [quoted(key).asc_nulls_first()] + [quoted(c).asc_nulls_first() for c in df.columns if c not in (key, shard)]
    inside = counted.withColumn("__before", F.sum("__n").over(
        Window.partitionBy(quoted(shard), "__bucket").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n"))
    # null-safe, so that neither side gets a filter of its own and both share one exchange
    placed = inside.join(F.broadcast(offsets), quoted(shard).eqNullSafe(F.col("__s"))
                         & F.col("__bucket").eqNullSafe(F.col("__b")))
    first = F.col("__offset") + F.col("__before")
    # copies are spread in runs of 65,536 so that no array grows with a hot row
    runs = placed.select(*columns, first.alias("__first"), "__n",
                         F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(__n - 1) div 65536"))).alias("__run"))
    return runs.select(*columns, F.explode(F.sequence(
        F.col("__first") + F.col("__run") * 65536,
        F.col("__first") + F.least(F.col("__n"), (F.col("__run") + 1) * 65536) - 1)).alias("slot")) \
        .toDF(*names, slot)
