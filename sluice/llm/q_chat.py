"""op1: every conversation from every participant's perspective."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import PART_ROWS, PART_TURNS, perspectives
from .common import table


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return views.withColumn("mask", spans)


SQL = f"""with t as (select distinct conv_id, turn, replace(case when coalesce(role, '') = '' then 'unknown' else
    translate(role, chr(13) || chr(10), '  ') end, '<|im_', '< |im_') as role,
  replace(coalesce(text, ''), '<|im_', '< |im_') as text from conversations),
h as (select *, md5(length(role) || '|' || role || '|' || text) as tie, coalesce(floor(turn / {PART_TURNS})::bigint, {1 << 40})
    as bucket from t),
b as (select conv_id as bc, bucket as bb, count(*) as n from h group by all),
r as (select h.*, bucket * {PART_TURNS * 4096} + case when n > {PART_ROWS}
    then (coalesce(turn, 0) % {PART_TURNS} + {PART_TURNS}) % {PART_TURNS} * 4096 + ('0x' || substr(tie, 1, 3))::bigint else 0 end as part
    from h join b on conv_id is not distinct from bc and bucket = bb),
s as (select distinct conv_id as c, role as speaker from t where role <> 'system'),
p as (select conv_id, speaker, part, turn, tie, role = speaker as own, text || '<|im_end|>' as body,
  case when role = speaker then '<|im_start|>assistant' || chr(10) when role = 'system' then '<|im_start|>system' || chr(10)
    else '<|im_start|>user name=' || role || chr(10) end as head from r join s on conv_id is not distinct from c),
o as (select *, sum(length(head) + length(body) + 1) over (partition by conv_id, speaker, part
    order by turn nulls last, tie rows unbounded preceding) - length(body) - 1 as start from p)
select conv_id, speaker, part, count(*)::int as n_turns,
  string_agg(head || body || chr(10), '' order by turn nulls last, tie) as text,
  coalesce(string_agg((start::bigint)::varchar || '-' || ((start + length(body))::bigint)::varchar, ','
    order by turn nulls last, tie) filter (where own), '') as mask
from o group by conv_id, speaker, part"""

QUERIES = {"op1_perspective_rotation": op1_perspective_rotation}
ORACLE = {"op1_perspective_rotation": SQL}
