"""op3: inclusion probability and decision of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mixing import ROUNDS, topic_of, with_probabilities

TARGETS = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    "topic": {"prose": 0.86, "legal": 0.04, "contact": 0.06, "table": 0.04},
}
BUDGET = 0.6


def dimensions(docs: DataFrame) -> dict:
    return {"source": docs["source"], "lang": docs["lang"], "topic": topic_of(docs["text"])}


def op3_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return with_probabilities(docs.withColumn("topic", topic_of(docs["text"])), TARGETS, dimensions(docs), BUDGET) \
        .select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


def _sql() -> str:
    named = lambda d: ", ".join(f"'{v}'" for v in TARGETS[d])
    out = f"""with d as (select doc_id, source, lang, text, case when text like '%icense%' or text like '%opyright%' then 'legal'
    when text like '%@%' or text like '%://%' then 'contact' when text like '% | %' then 'table' else 'prose' end as topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents),
r as (select *, case when source in ({named("source")}) then source else 'other' end as c0,
  case when lang in ({named("lang")}) then lang else 'other' end as c1, topic as c2 from d),
cells as (select c0, c1, c2, sum(n_tokens)::double as n from r group by all)"""
    for i, d in enumerate(TARGETS):
        values = ", ".join(f"('{v}', {s!r}::double)" for v, s in TARGETS[d].items())
        out += f""",
m{i} as (select c{i}, sum(n) as n from cells group by 1),
t{i} as (select v, s from (values {values}) x(v, s)),
o{i} as (select coalesce((select n from m{i} where c{i} = 'other'), 0) / (select sum(n) from m{i}) as o),
g{i} as (select c{i}, {BUDGET!r} * (select sum(n) from cells) * case when c{i} = 'other' then o
    else (1 - o) * s / (select sum(s) from t{i} where v in (select c{i} from m{i})) end as goal
  from m{i} left join t{i} on v = c{i}, o{i})"""
    out += f""",
w0 as materialized (select c0, c1, c2, n, n * {BUDGET!r} as w from cells)"""
    k = 0
    for _ in range(ROUNDS):
        for i in range(len(TARGETS)):
            out += f""",
w{k + 1} as materialized (select c0, c1, c2, n, least(n, w * case when sum(w) over (partition by c{i}) > 0
  then goal / sum(w) over (partition by c{i}) else 0 end) as w from w{k} join g{i} using (c{i}))"""
            k += 1
    return out + f""",
p as (select c0, c1, c2, round(case when n > 0 then w / n else {BUDGET!r} end, 6) as probability from w{k})
select doc_id, source, lang, topic, n_tokens, probability,
  ('0x' || substr(md5(coalesce(doc_id::varchar, md5(coalesce(text, ''))) || '|mix'), 1, 13))::bigint::double
    / 4503599627370496.0 < probability as kept
from r join p using (c0, c1, c2)"""


QUERIES = {"op3_raked_mixture": op3_raked_mixture}
ORACLE = {"op3_raked_mixture": _sql()}
