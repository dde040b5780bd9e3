"""Mixing sources to target weights by iterative proportional fitting.

Token weights of cells (source x language x topic) are raked: each marginal
in turn is scaled to its target share of the token budget, with no cell above
the tokens it has, until the marginals settle (every one within ``TOLERANCE``
of all tokens, or ``ROUNDS`` rounds; ``residuals`` shows what is left). A cell's
weight divided by its tokens is the inclusion probability of its documents;
a document is kept when a hash of its id falls below it, so that the kept
tokens follow the targets in expectation and a re-run keeps the same rows.

A value that no target names belongs to ``other``, which keeps its natural
share unless a target is given for it. Targets of values that do not occur
are shared out among those that do. Where the tokens cannot fill a target (a
probability would exceed 1) the cell is taken whole; ``achieved`` shows what
came of each target.

Counts cover all documents in one pass of partial sums, written to the shared
folder. Up to ``max_cells`` cells that occur are raked on the driver and
broadcast back; more are raked as a table, the same steps with the marginals
(one row per target value) broadcast, and joined back by cell. Sampling is a
narrow pass over all rows, so a hot source is never gathered anywhere.

Defined cases: null values of a dimension belong to ``other``; null and empty
texts have 0 tokens, and a cell without tokens gets the mean probability; a
null id is hashed by its text instead; repeated rows share one decision;
empty tables give empty results; columns keep their names and values, added
ones replace input columns of the same name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, fresh, materialize, quoted

ROUNDS = 25
TOLERANCE = 1e-12
MAX_CELLS = 1_000_000
OTHER = "other"


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from marks in the text, first match: legal, contact, table, prose."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains("icense") | t.contains("opyright"), "legal") \
        .when(t.contains("@") | t.contains("://"), "contact") \
        .when(t.contains(" | "), "table").otherwise("prose")


def value_of(dimension: Column, target: dict[str, float]) -> Column:
    """The dimension's value where the target names it, else ``other``."""
    text = dimension.cast("string")
    return F.when(text.isin(*[str(v) for v in target]), text).otherwise(F.lit(OTHER))


def goals(tokens: dict[str, float], target: dict[str, float], budget_tokens: float) -> dict[str, float]:
    """Token goal of each value that occurs."""
    total = sum(tokens.values())
    if OTHER in target or OTHER not in tokens:
        share, rest = dict(target), 1.0
    else:
        rest = 1.0 - tokens[OTHER] / total if total else 0.0
        share = dict(target)
    present = {v: share.get(v, 0.0) for v in tokens if v != OTHER or OTHER in target}
    named = sum(present.values())
    out = {v: budget_tokens * rest * s / named if named else 0.0 for v, s in present.items()}
    if OTHER in tokens and OTHER not in target:
        out[OTHER] = budget_tokens * (1.0 - rest)
    return out


def rake(cells: list[tuple], tokens: np.ndarray, targets: list[dict[str, float]], budget: float,
         rounds: int = ROUNDS) -> np.ndarray:
    """Raked token weights of the cells (tuples of dimension values)."""
    total = float(tokens.sum())
    weight = tokens * budget
    dims = []
    for d, target in enumerate(targets):
        names = sorted({c[d] for c in cells})
        at = {n: i for i, n in enumerate(names)}
        code = np.array([at[c[d]] for c in cells], dtype=np.int64)
        sums = np.bincount(code, weights=tokens, minlength=len(names))
        goal = goals(dict(zip(names, sums.tolist())), target, total * budget)
        dims.append((code, np.array([goal[n] for n in names])))
    for _ in range(rounds):
        off = 0.0
        for code, goal in dims:
            have = np.bincount(code, weights=weight, minlength=len(goal))
            off = max(off, float(np.abs(goal - have).max(initial=0.0)))
            scale = np.divide(goal, have, out=np.zeros(len(goal)), where=have > 0)
            weight = np.minimum(tokens, weight * scale[code])
        if off <= TOLERANCE * total:
            break
    return weight


def rake_table(cells: DataFrame, names: list[str], targets: list[dict[str, float]], budget: float,
               rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (the columns ``names`` and tokens ``n``) with the raked weight
    ``w``: what ``rake`` does, for any number of cells. A marginal has at most
    one row per target value and one for ``other``, which bounds what is
    collected and broadcast; the weights are written once a round."""
    spark, goal_of = cells.sparkSession, []
    for name, target in zip(names, targets):
        sums = {r[0]: float(r[1] or 0) for r in cells.groupBy(name).agg(F.sum("n")).collect()}
        goal_of.append(goals(sums, target, sum(sums.values()) * budget))
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    out = cells.withColumn("w", F.col("n") * F.lit(float(budget)))
    for _ in range(rounds):
        off = 0.0
        for name, goal in zip(names, goal_of):
            have = {r[0]: r[1] for r in out.groupBy(name).agg(F.sum("w")).collect()}
            off = max([off, *(abs(goal[v] - h) for v, h in have.items())])
            scale = spark.createDataFrame([(v, goal[v] / h if h > 0 else 0.0) for v, h in have.items()],
                                          f"`{name}` string, scale double")
            out = out.join(F.broadcast(scale), name).withColumn("w", F.least("n", F.col("w") * F.col("scale"))) \
                .select(*names, "n", "w")
        out, _ = materialize(out, "raked")
        if off <= TOLERANCE * total:
            break
    return out


def uniform(key: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the row's id."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.md5(F.coalesce(text, F.lit("")))),
                                        F.lit(f"|{seed}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def with_probabilities(df: DataFrame, targets: dict[str, dict[str, float]], dimensions: dict[str, Column],
                       budget: float, key: str = "doc_id", text: str = "text", tokens: Column | None = None,
                       seed: str = "mix", max_cells: int = MAX_CELLS) -> DataFrame:
    """``df`` with ``n_tokens``, ``probability`` and ``kept``. ``dimensions``
    gives the column of each targeted dimension, ``budget`` the share of all
    tokens to keep in expectation."""
    targets = {d: {str(k): v for k, v in t.items()} for d, t in targets.items()}
    names = {d: fresh(d) for d in targets}
    n_at, p_at = fresh("n"), fresh("p")
    cell = {names[d]: value_of(dimensions[d], t) for d, t in targets.items()}
    keep = [c for c in df.columns if c not in ("n_tokens", "probability", "kept")]
    rows = df.withColumns({**cell, n_at: n_tokens(quoted(text)) if tokens is None else tokens})
    counted, _ = materialize(rows.groupBy(*names.values()).agg(
        F.coalesce(F.sum(n_at), F.lit(0)).cast("double").alias("n")), "cells")
    few = counted.limit(max_cells + 1).collect()
    if len(few) <= max_cells:
        cells = [tuple(r[:len(names)]) for r in few]
        weight = rake(cells, np.array([r["n"] for r in few], dtype=float), list(targets.values()), budget)
        raked = df.sparkSession.createDataFrame(
            [(*c, r["n"], float(w)) for c, r, w in zip(cells, few, weight)],
            T.StructType([T.StructField(n, T.StringType()) for n in names.values()]
                         + [T.StructField("n", T.DoubleType()), T.StructField("w", T.DoubleType())]))
    else:
        raked = rake_table(counted, list(names.values()), list(targets.values()), budget)
    p = F.round(F.when(F.col("n") > 0, F.col("w") / F.col("n")).otherwise(F.lit(float(budget))), 6)
    table = raked.select(*[quoted(n).alias(f"{n}_c") for n in names.values()], p.alias(p_at))
    if len(few) <= max_cells:
        table = F.broadcast(table)
    cond = F.lit(True)
    for n in names.values():
        cond = cond & (quoted(n) == quoted(f"{n}_c"))
    joined = rows.join(table, cond, "left")
    return joined.select(*[quoted(c) for c in keep], quoted(n_at).alias("n_tokens"), quoted(p_at).alias("probability"),
                         (uniform(quoted(key), quoted(text), seed) < quoted(p_at)).alias("kept"))


def sample(df: DataFrame, targets: dict[str, dict[str, float]], dimensions: dict[str, Column], budget: float,
           **options) -> DataFrame:
    """The kept documents with their own columns."""
    row = fresh("row")
    marked = with_probabilities(df.withColumn(row, F.struct(*[quoted(c) for c in df.columns])), targets,
                                dimensions, budget, **options)
    return marked.filter("kept").select(f"{row}.*")


def achieved(marked: DataFrame, value: Column) -> DataFrame:
    """Share of the kept tokens of each value of a dimension."""
    sums = marked.groupBy(value.alias("value")).agg(F.sum(F.when(F.col("kept"), F.col("n_tokens"))).alias("tokens"))
    total = marked.agg(F.sum(F.when(F.col("kept"), F.col("n_tokens"))).alias("all"))
    return sums.join(F.broadcast(total)).select("value", (F.col("tokens") / F.col("all")).alias("share"))


def residuals(marked: DataFrame, targets: dict[str, dict[str, float]], dimensions: dict[str, Column],
              budget: float) -> DataFrame:
    """What raking left: per dimension and value the token goal, the tokens
    expected from the probabilities, and their difference as a share of the
    budget (one row per value that occurs; a goal beyond the tokens shows here)."""
    rows = []
    for d, target in targets.items():
        target = {str(k): v for k, v in target.items()}
        sums = marked.groupBy(value_of(dimensions[d], target).alias("v")).agg(
            F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("probability")).alias("e")).collect()
        have = {r["v"]: float(r["n"] or 0) for r in sums}
        wanted = sum(have.values()) * budget
        goal = goals(have, target, wanted)
        rows += [(d, r["v"], goal[r["v"]], float(r["e"] or 0),
                  (float(r["e"] or 0) - goal[r["v"]]) / wanted if wanted else 0.0) for r in sums]
    return marked.sparkSession.createDataFrame(
        rows, "dimension string, value string, goal double, expected double, residual double")
