"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words (outer punctuation cut
off) and their prefixes; each is hashed into ``BUCKETS``. The machine scores

    logit = b + sum_i w_i + 1/2 * (|sum_i v_i|^2 - sum_i |v_i|^2)

so that pairs of terms count beyond their own weights: an insult next to a
group mention weighs more (or less) than the two apart, which a linear model
cannot say.

Fitting takes a bounded, documented sample of labelled rows (``per_class``
documents of each class, those with the smallest hash of their id), weighted
back to the class shares of all training labels. Only terms get weights that
are in at least ``MIN_DOCS`` sampled documents and whose shares in the two
classes differ by ``MIN_Z`` standard errors or more: without that choice the
pair term of long texts is noise. The sample's hashed terms are the
only thing that reaches the driver; scoring runs in the scan tasks over all
rows without a shuffle, with the model (bounded by the buckets) broadcast.

Defined cases: a null or empty text has no terms and scores the intercept; a
null label or id is no label; a document labelled twice is toxic if any label
says so; repeated rows score alike; without labels of both classes every
text scores the smoothed share of toxic labels; an empty table gives an empty
result; further columns are carried through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

BUCKETS = 1 << 18
PREFIXES = (4, 5)
MIN_DOCS = 3
MIN_Z = 4.0
MEMO = 400_000
#: Outer characters that do not belong to a term.
_EDGES = ".,;:!?*&%$#|<>()[]{}\"'`~-_+=/\\"


def word_terms(word: str) -> tuple[int, ...]:
    """Buckets of a word: the word itself and its prefixes."""
    w = word.strip(_EDGES)
    if not w:
        return ()
    keys = ["w " + w] + [f"{n} {w[:n]}" for n in PREFIXES if len(w) > n]
    return tuple(zlib.crc32(k.encode()) % BUCKETS for k in keys)


def text_terms(text: str) -> np.ndarray:
    """Distinct buckets of a text, sorted."""
    found: set[int] = set()
    for w in set(text.lower().split()):
        found.update(word_terms(w))
    return np.array(sorted(found), dtype=np.int32)


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; empty runs sum to 0."""
    out = np.zeros((len(sizes),) + values.shape[1:], dtype=np.float64)
    if len(values):
        full = sizes > 0
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


@dataclass
class Machine:
    bias: float
    slot: np.ndarray      # bucket -> row of the weights, -1: no weight
    w: np.ndarray         # (rows,)
    v: np.ndarray         # (rows, factors)

    def logits(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """rows: weight rows of the documents' terms, one document after another."""
        starts = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else np.zeros(0, dtype=np.int64)
        v = self.v[rows]
        total = _sums(v, starts, sizes)
        pairs = 0.5 * ((total ** 2).sum(1) - _sums((v ** 2).sum(1), starts, sizes))
        return self.bias + _sums(self.w[rows], starts, sizes) + pairs


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(documents: list[np.ndarray], toxic: np.ndarray, share: float, factors: int = 6, rounds: int = 200,
        rate: float = 0.05, l2: float = 1e-3, seed: int = 7) -> Machine:
    """Full-batch Adam on the weighted logistic loss. ``share``: share of
    toxic labels that the weights restore."""
    prior = float(np.log(share / (1 - share)))
    slot = np.full(BUCKETS, -1, dtype=np.int32)
    if not len(documents) or toxic.min() == toxic.max():
        return Machine(prior, slot, np.zeros(0), np.zeros((0, factors)))
    y = toxic.astype(np.float64)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
    terms = np.concatenate(documents)
    owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    n1, n0 = y.sum(), (1 - y).sum()
    in1 = np.bincount(terms, weights=y[owner], minlength=BUCKETS)
    in0 = np.bincount(terms, minlength=BUCKETS) - in1
    p = (in1 + in0) / len(y)
    z = (in1 / n1 - in0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    used = np.flatnonzero((in1 + in0 >= MIN_DOCS) & (np.abs(z) >= MIN_Z))
    slot[used] = np.arange(len(used), dtype=np.int32)
    known = slot[terms] >= 0
    rows, owner = slot[terms[known]].astype(np.int64), owner[known]
    sizes = np.bincount(owner, minlength=len(documents))
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    by_term = np.argsort(rows, kind="stable")
    term_sizes = np.bincount(rows, minlength=len(used))
    term_starts = np.r_[0, np.cumsum(term_sizes)[:-1]]
    term_owner = owner[by_term]
    rng = np.random.default_rng(seed)
    m = Machine(prior, slot, np.zeros(len(used)), rng.normal(0, 0.02, (len(used), factors)))
    state = {k: [0.0, 0.0] for k in ("bias", "w", "v")}
    for t in range(1, rounds + 1):
        v = m.v.astype(np.float32)[rows]
        total = _sums(v, starts, sizes)
        pairs = 0.5 * ((total ** 2).sum(1) - _sums((v ** 2).sum(1), starts, sizes))
        del v
        error = weight * (sigmoid(m.bias + _sums(m.w[rows], starts, sizes) + pairs) - y)
        g_w = _sums(error[term_owner], term_starts, term_sizes)
        g_v = _sums((error[:, None] * total).astype(np.float32)[term_owner], term_starts, term_sizes) - m.v * g_w[:, None]
        grads = {"bias": error.sum(), "w": g_w + l2 * m.w / 10, "v": g_v + l2 * m.v}
        for k, g in grads.items():
            state[k][0] = 0.9 * state[k][0] + 0.1 * g
            state[k][1] = 0.999 * state[k][1] + 0.001 * g * g
            step = rate * (state[k][0] / (1 - 0.9 ** t)) / (np.sqrt(state[k][1] / (1 - 0.999 ** t)) + 1e-8)
            setattr(m, k, getattr(m, k) - step)
    m.bias = float(m.bias)
    return m


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int) -> tuple:
    """(term arrays, labels, share of toxic labels) of the bounded sample."""
    marks = labels.select(quoted(key).alias("k"), quoted(label).cast("int").alias("y")).dropna() \
        .groupBy("k").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in marks.groupBy((F.col("y") > 0).cast("int").alias("y"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    chosen = None
    for toxic in (True, False):
        part = marks.filter((F.col("y") > 0) == F.lit(toxic)).orderBy(F.xxhash64("k"), "k").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    terms = F.pandas_udf(lambda s: pd.Series([text_terms(t) for t in s]), "array<int>")
    # at most 2 * per_class rows: small enough to broadcast, and one text for each id afterwards
    rows = docs.select(quoted(key).alias("k"), F.coalesce(quoted(text), F.lit("")).alias("t")) \
        .join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.max("t").alias("t")) \
        .select("k", (F.col("y") > 0).cast("int").alias("y"), terms("t").alias("terms")).collect()
    rows.sort(key=lambda r: r["k"])
    return [np.asarray(r["terms"], dtype=np.int32) for r in rows], np.array([r["y"] for r in rows], dtype=np.int64), share


def fit_machine(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                per_class: int = 3000, **options) -> Machine:
    documents, toxic, share = training_sample(docs, labels, key, text, label, per_class)
    return fit(documents, toxic, share, **options)


def scorer(spark, machine: Machine):
    """A column function text -> probability of the toxic label (double)."""
    shared = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, memo = shared.value, {}
        for texts in batches:
            rows, sizes = [], []
            for t in texts:
                found: set[int] = set()
                for word in set(t.lower().split()):
                    known = memo.get(word)
                    if known is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        at = m.slot[list(word_terms(word))]
                        known = memo[word] = tuple(at[at >= 0].tolist())
                    if known:
                        found.update(known)
                rows.append(np.array(sorted(found), dtype=np.int64))
                sizes.append(len(found))
            flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
            yield pd.Series(sigmoid(m.logits(flat, np.array(sizes, dtype=np.int64))))

    def scored(text: Column) -> Column:
        return probability(F.coalesce(text, F.lit("")))

    return scored
