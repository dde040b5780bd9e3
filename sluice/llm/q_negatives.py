"""op11: hard negatives of every fiftieth embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .hard_negatives import mine

EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 50, 5, 3, 50, 95


def op11_hilbert_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.when(usable, F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)))
    return mine(rows, F.col("vec_id"), label, whole, EVERY, POSITIVES, NEGATIVES, LOW, HIGH)


_SQL = f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, c.vec_id as id, a.label = c.label as same,
         cast(list_inner_product(a.q, c.q) as bigint) as score
  from (select * from v where vec_id % {EVERY} = 0) a join v c on c.vec_id <> a.vec_id),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= {POSITIVES})
select p.anchor_id, p.positive_id,
       cast(row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.id) as int) as rank,
       n.id as negative_id, p.positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
 and 100 * n.score between {LOW} * p.positive_score and {HIGH} * p.positive_score
qualify rank <= {NEGATIVES}"""

QUERIES = {"op11_hilbert_hard_negatives": op11_hilbert_hard_negatives}
ORACLE = {"op11_hilbert_hard_negatives": _SQL}
