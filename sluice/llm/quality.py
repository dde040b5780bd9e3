"""Quality rules with risk-controlled cutoffs (native).

Text measures (counts of words, symbols, capitals, repeated lines and
repeated five-word windows) feed ratio rules. A rule rejects a document when
its ratio is above a cutoff, and the cutoffs are chosen from labelled
documents, per stratum, so that good documents are rejected rarely:

* for stratum s, rule r and cutoff c, ``k`` of the ``n`` good holdout
  documents would be rejected. "The false rejection rate is above a" is
  refuted when ``P(Bin(n, a) <= k) <= d`` (exact binomial tail);
* ``a`` is the total risk divided by the number of rules (union bound over
  the rules), ``d`` the allowed error divided by strata x rules
  (Bonferroni). Cutoffs of a rule are tested from lenient to strict; ``k``
  only grows along the way, so the passing cutoffs are the start of that
  fixed sequence and need no further division;
* among the passing cutoffs the one that rejects most bad holdout documents
  wins, the most lenient one at a tie. A rule with no passing cutoff, or
  whose passing cutoffs reject no bad document, rejects nothing there.

With probability of at least ``1 - error`` every stratum's false rejection by
the rules stays below ``risk`` (the base rule rejects by itself, outside this
guarantee); with few labels the rules reject nothing.

Defined cases: a null text is the empty text (0 words; fails the base rule);
an unknown or null stratum value belongs to the stratum ``other``; equal
texts count once in the holdout (copies are not independent trials; good if
any label of theirs says so); null labels are no labels; several labels of a
document: good if any is; empty tables give empty results; columns of the
input keep their names and values whatever they are called, but for those
named as an added column, which is the one that stays; very long texts are
measured whole, one text in memory at a time.

All of it is DataFrame expressions. The measures are computed once and
written to the shared folder; the labels join on slim columns; the cutoffs
are at most (strata) rows, which bounds the broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD_SPACE, fresh, materialize, quoted

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """Reject when 1000 * part > cutoff * whole; cutoffs from lenient to strict."""
    name: str
    part: str
    whole: str
    cutoffs: tuple[int, ...]


@dataclass(frozen=True)
class Policy:
    rules: tuple[Rule, ...] = (
        Rule("symbols", "n_symbols", "word_chars", (300, 200, 150, 100, 50, 20)),
        Rule("capitals", "n_capitals", "word_chars", (700, 600, 500, 400, 300, 200)),
        Rule("repeats", "n_repeat_words", "n_words", (180, 150, 120, 90, 60)),
        Rule("dup_lines", "n_dup_lines", "n_lines", (700, 500, 400, 300, 200)),
        Rule("word_length", "word_chars", "n_words", (25000, 20000, 15000, 12000, 10000)),
    )
    strata: tuple[str, ...] = field(default=("en", "de", "fr", "es"))
    risk: float = 0.05
    error: float = 0.05

    @property
    def rule_risk(self) -> float:
        return self.risk / len(self.rules)

    @property
    def test_error(self) -> float:
        return self.error / ((len(self.strata) + 1) * len(self.rules))


def with_measures(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``df`` with the measures of a text column (long) as ``prefix`` + name."""
    t = F.coalesce(quoted(text), F.lit(""))
    at = lambda n: f"{prefix}{n}"
    names = {n: fresh(n) for n in ("words", "lines", "windows", "sorted")}
    tmp = names.__getitem__
    long = lambda c: c.cast("long")
    words = F.filter(F.split(t, WORD_SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    df = df.withColumns({tmp("words"): words, tmp("lines"): lines})
    n = F.size(quoted(tmp("words")))
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(
        F.slice(quoted(tmp("words")), i, 5)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumns({
        at("n_words"): long(n),
        at("word_chars"): long(F.length(F.translate(t, SPACE_CHARS, ""))),
        at("n_symbols"): long(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))),
        at("n_capitals"): long(F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}+", ""))),
        at("n_lines"): long(F.size(quoted(tmp("lines")))),
        at("n_dup_lines"): long(F.size(quoted(tmp("lines"))) - F.size(F.array_distinct(quoted(tmp("lines"))))),
        tmp("windows"): windows,
    }).drop(tmp("words"), tmp("lines"))
    repeated = F.size(F.array_distinct(quoted(tmp("windows")))) < F.size(quoted(tmp("windows")))
    df = df.withColumn(tmp("sorted"), F.when(repeated, F.sort_array(F.transform(
        quoted(tmp("windows")), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop(tmp("windows"))
    s = quoted(tmp("sorted"))
    # windows with an equal neighbour in hash order, as sorted positions
    starts = F.sort_array(F.transform(F.filter(s, lambda e, j: F.coalesce(
        F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))),
        lambda e: e["i"]))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
                          lambda acc, p: F.struct((acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n"),
                                                  p.alias("last")), lambda acc: acc["n"])
    return df.withColumn(at("n_repeat_words"), long(F.coalesce(covered, F.lit(0)))).drop(tmp("sorted"))


def base_failed(prefix: str = "") -> Column:
    words, repeats = quoted(prefix + "n_words"), quoted(prefix + "n_repeat_words")
    return (words < 10) | (100 * repeats > 20 * words)


def _rejects(rule: Rule, cutoff: Column, prefix: str) -> Column:
    return 1000 * quoted(prefix + rule.part) > cutoff * quoted(prefix + rule.whole)


def stratum_of(value: Column, policy: Policy) -> Column:
    return F.when(value.cast("string").isin(*policy.strata), value.cast("string")).otherwise(F.lit("other"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) by summing the terms in logarithms. From the mean
    upwards it is returned as 1: never significant."""
    import math
    step, first = F.lit(math.log(p) - math.log1p(-p)), n * F.lit(math.log1p(-p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + step
        top, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(low - top))).alias("total"))

    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
                        F.struct(first.alias("term"), first.alias("total")), add, lambda acc: F.exp(acc["total"]))
    return F.when(k < n * p, total).otherwise(F.lit(1.0))


def choose_cutoffs(holdout: DataFrame, policy: Policy, prefix: str = "") -> DataFrame:
    """One row per stratum seen in the holdout (``stratum``, ``good`` and the
    measures) and rule: n, the chosen cutoff (null: none) and its k and tail."""
    good = quoted("good") == 1
    sums = [F.count_if(good).alias("n")]
    for r in policy.rules:
        for c in r.cutoffs:
            hit = _rejects(r, F.lit(c), prefix)
            sums += [F.count_if(good & hit).alias(f"k_{r.name}_{c}"), F.count_if(~good & hit).alias(f"b_{r.name}_{c}")]
    wide = holdout.groupBy("stratum").agg(*sums)
    cells = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(c).alias("cutoff"), quoted(f"k_{r.name}_{c}").alias("k"),
                               quoted(f"b_{r.name}_{c}").alias("bad")) for r in policy.rules for c in r.cutoffs])
    tested = wide.select("stratum", "n", F.explode(cells).alias("cell")).select("stratum", "n", "cell.*") \
        .withColumn("tail", binomial_tail(F.col("n"), F.col("k"), policy.rule_risk))
    passing = (F.col("tail") <= policy.test_error) & (F.col("bad") > 0)
    best = F.max_by(F.struct("cutoff", "k", "bad", "tail"), F.when(passing, F.struct("bad", "cutoff")))
    return tested.groupBy("stratum", "rule", "n").agg(best.alias("b")).select("stratum", "rule", "n", "b.*")


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
          quality: str = "quality", policy: Policy = Policy(), prefix: str = "m_", keep_text: bool = True) -> DataFrame:
    """``df`` with its measures (under ``prefix``), ``<prefix>base_failed`` and
    ``<prefix>kept``. ``labels``: key and quality (1 good, 0 bad). Without
    ``keep_text`` the text column is left out and never written."""
    p = fresh("m")  # no input column is called so
    added = [prefix + m for m in (*MEASURES, "stratum", "base_failed", "kept")]
    columns = [c for c in df.columns if (keep_text or c != text) and c not in added]
    measured = with_measures(df, text, p).withColumns({
        f"{p}stratum": stratum_of(quoted(stratum), policy),
        f"{p}digest": F.xxhash64(F.md5(F.coalesce(quoted(text), F.lit(""))))})
    stored, _ = materialize(measured if keep_text else measured.drop(text), "quality")
    marks = labels.select(quoted(key).alias("__key"), quoted(quality).alias("__good")).dropna() \
        .groupBy("__key").agg(F.max("__good").alias("__good"))
    slim = stored.select(quoted(key).alias("__key"), *[quoted(p + m) for m in MEASURES],
                         quoted(f"{p}stratum").alias("stratum"), quoted(f"{p}digest"))
    holdout = slim.join(marks, "__key").groupBy("stratum", f"{p}digest").agg(
        F.max("__good").alias("good"), *[F.max(quoted(p + m)).alias(p + m) for m in MEASURES])
    chosen = choose_cutoffs(holdout, policy, p).dropna(subset=["cutoff"]) \
        .groupBy(quoted("stratum").alias(f"{p}stratum")).agg(F.map_from_entries(
            F.collect_list(F.struct("rule", "cutoff"))).alias(f"{p}cutoffs"))
    joined = stored.join(F.broadcast(chosen), f"{p}stratum", "left")  # at most (strata + 1) rows
    over = F.lit(False)
    for r in policy.rules:
        over = over | F.coalesce(_rejects(r, quoted(f"{p}cutoffs")[r.name], p), F.lit(False))
    failed = base_failed(p)
    return joined.select(*[quoted(c) for c in columns], *[quoted(p + m).alias(prefix + m) for m in MEASURES],
                         quoted(f"{p}stratum").alias(f"{prefix}stratum"), failed.alias(f"{prefix}base_failed"),
                         (~failed & ~over).alias(f"{prefix}kept"))


def keep_good(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    prefix = fresh("m")
    return judge(df, labels, prefix=prefix, **options).filter(quoted(prefix + "kept")).select(*[quoted(c) for c in df.columns])
