"""op2: all documents into shards 0 to 23 by the weighted hash tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes
from .sharding import assign_shards, children, default_topology, grow, number_slots

TOPOLOGY = default_topology(24)
GROWN = grow(TOPOLOGY)


def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    data = text_bytes(docs["text"])
    slim = docs.select("doc_id", (F.octet_length(data).cast("long") + 8).alias("size"),
                       F.crc32(data).alias("text_crc32"))
    placed = assign_shards(slim, "doc_id", TOPOLOGY)
    placed = assign_shards(placed, "doc_id", GROWN, names=("__g_region", "__g_rack", "grown_shard")) \
        .drop("__g_region", "__g_rack")
    return number_slots(placed, "shard", "doc_id", by=["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", "slot", "grown_shard")


def _nodes(topology) -> str:
    return " union all ".join(f"select '{parent}' as parent, '{c['p']}' as path, {c['i']}::int as num, {c['w']!r}::double as w"
                              for parent, cs in children(topology).items() for c in cs)


def _descend(prefix: str, topology) -> str:
    """DuckDB CTEs: the winning child at three levels for every id."""
    out, parents = f"{prefix}_nodes as ({_nodes(topology)})", "(select k, '' as path from ids)"
    for level in ("region", "rack", "shard"):
        out += f""",
{prefix}_{level} as (select k, arg_min(path, (draw, num)) as path, arg_min(num, (draw, num)) as num from (
  select p.k, n.path, n.num, -ln((('0x' || substr(md5(p.k || '|shard|' || n.path), 1, 13))::bigint::double + 0.5)
    / 4503599627370496.0) / n.w as draw from {parents} p join {prefix}_nodes n on n.parent = p.path) group by k)"""
        parents = f"{prefix}_{level}"
    return out


#: CRC-32 in SQL: the table from its polynomial, then one step per byte.
SQL_CRC = """tab(i, v, k) as (select i, i::bigint, 0 from range(256) r(i) union all
  select i, case when v & 1 = 1 then xor(3988292384, v >> 1) else v >> 1 end, k + 1 from tab where k < 8),
crc_table as (select list(v order by i) as t from tab where k = 8)"""


def sql_crc(data: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
  list_transform(range(octet_length({data})), lambda i: ('0x' || hex({data}[i + 1:i + 1]))::bigint)),
  lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)))"""


SQL = f"""with recursive {SQL_CRC},
ids as (select distinct coalesce(doc_id::varchar, '\\N') as k from documents),
{_descend("cur", TOPOLOGY)},
{_descend("grown", GROWN)},
d as (select doc_id, coalesce(doc_id::varchar, '\\N') as k, encode(coalesce(text, '')) as b from documents),
s as (select doc_id, k, octet_length(b)::bigint + 8 as size, {sql_crc("b")}::bigint as text_crc32 from d, crc_table)
select doc_id, size, text_crc32, 'key' as law, r.num as region, q.num as rack, c.num as shard,
  row_number() over (partition by c.num order by substr(md5(k || '|' || size || '|' || text_crc32), 1, 3), doc_id nulls first, size, text_crc32) - 1 as slot,
  g.num as grown_shard
from s join cur_region r using (k) join cur_rack q using (k) join cur_shard c using (k) join grown_shard g using (k)"""

QUERIES = {"op2_hash_tree_shards": op2_hash_tree_shards}
ORACLE = {"op2_hash_tree_shards": SQL}
