"""op5: measures and verdicts for all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import quoted, table
from .quality import Policy, judge

POLICY = Policy()


def op5_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = judge(docs, table(spark, sf_dir, "labels"), policy=POLICY, keep_text=False)
    return out.select("doc_id", *[quoted(f"m_{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_capitals", "stratum")])


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CELLS = " union all ".join(
    f"select '{r.name}' as rule, {c} as cutoff, stratum, good, 1000 * {r.part} > {c} * {r.whole} as hit from holdout"
    for r in POLICY.rules for c in r.cutoffs)
_OVER = " or ".join(
    f"coalesce(1000 * {r.part} > (select max(cutoff) from chosen c where c.stratum = f.stratum and c.rule = '{r.name}') * {r.whole}, false)"
    for r in POLICY.rules)

SQL = f"""with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents),
w as (select rid, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {_SPACES}, '')) > 0) as lines from d),
five as (select rid, i, array_to_string(words[i:i + 4], ' ') as win
  from (select rid, words, unnest(range(1, len(words) - 3)) as i from w)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, win) as c from five) where c > 1),
rep as (select rid, sum(least(5, i - before)) as n from (
  select rid, i, coalesce(lag(i) over (partition by rid order by i), -9) as before from twice) group by rid),
f as (select d.rid, doc_id, t, len(words)::bigint as n_words, length(translate(t, {_SPACES}, ''))::bigint as word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
  len(lines)::bigint as n_lines, (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::bigint as n_capitals,
  case when lang in ({", ".join(f"'{s}'" for s in POLICY.strata)}) then lang else 'other' end as stratum
  from d join w using (rid) left join rep using (rid)),
marks as (select doc_id, max(quality) as good from labels where quality is not null group by doc_id),
holdout as (select stratum, t, max(good) as good, {", ".join(f"max({m}) as {m}" for m in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"))}
  from f join marks using (doc_id) group by stratum, t),
counted as (select stratum, rule, cutoff, count(*) filter (good = 1) as n, count(*) filter (good = 1 and hit) as k,
  count(*) filter (good <> 1 and hit) as bad from ({_CELLS}) group by all),
tested as (select *, case when k < n * {POLICY.rule_risk!r} then
  list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0)
    + i * ln({POLICY.rule_risk!r}) + (n - i) * ln(1 - {POLICY.rule_risk!r})))) else 1 end as tail from counted),
chosen as (select stratum, rule, arg_max(cutoff, (bad, cutoff)) as cutoff from tested
  where tail <= {POLICY.test_error!r} and bad > 0 group by all),
v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {_OVER} as over from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not over as kept, n_lines, n_capitals, stratum from v"""

QUERIES = {"op5_risk_controlled_quality": op5_risk_controlled_quality}
ORACLE = {"op5_risk_controlled_quality": SQL}
