"""op8: known licence texts among the documents, their paragraphs and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .licenses import COPYRIGHT_LINE, EQUIVALENT, KNOWN, known_licenses, scan


def op8_canonical_digest_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_licenses(spark))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    spelled = "map {" + ", ".join(f"{quote(a)}: {quote(b)}" for a, b in EQUIVALENT.items()) + "}"
    lines = f"""list_transform(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')),
    {quote(COPYRIGHT_LINE)}, '\\1', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10)),
    lambda x: array_to_string(list_transform(list_filter(string_split(x, ' '), lambda w: w <> ''),
      lambda w: coalesce(spelled[w], w)), ' '))"""
    known = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    whole = "array_to_string(list_filter(lines, lambda x: x <> ''), ' ')"
    return f"""with s as (select {spelled} as spelled),
known as (select license_id, {whole} as c from (select license_id, {lines} as lines
  from (values {known}) k(license_id, text), s)),
d as (select doc_id, {lines} as lines from documents, s),
u as (select doc_id, 'text' as unit, {whole} as c from d union all
  select doc_id, 'paragraph', trim(replace(unnest(regexp_split_to_array(array_to_string(lines, chr(10)), '\\n\\n+')),
    chr(10), ' ')) from d union all
  select doc_id, 'line', unnest(lines) from d)
select doc_id, license_id, unit, count(*) as n from u join (select distinct * from known where c <> '') using (c)
group by all"""


QUERIES = {"op8_canonical_digest_licenses": op8_canonical_digest_licenses}
ORACLE = {"op8_canonical_digest_licenses": _sql()}
