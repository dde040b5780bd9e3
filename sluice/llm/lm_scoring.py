"""Language-model scores by prediction by partial matching (PPM).

The model is a trie of byte contexts up to ``order`` bytes long, with counts
from the learning documents. A byte is predicted from the longest context
seen; where the byte never followed it, an escape (method C: as likely as
the number of different bytes that did follow) leads to the next shorter
context, in which the bytes that the longer one already offered are excluded.
Below order 0 every byte not yet offered is equally likely. Texts are scored
as lower-cased (A-Z) UTF-8 bytes between a start and an end mark (byte 0).

Beside it a plain word model is scored: log10((c + 0.5) / (N + 0.5 (V + 1)))
summed over the text's words and one end token.

How it runs: neither the trie nor the vocabulary has a bound, so none of
them is broadcast. Documents are grouped into blocks of about ``BLOCK``
bytes. A first pass over the blocks lists what each block needs (its distinct
words and byte sequences, with their counts in learning documents), cut into
key ranges; the ranges meet across blocks, where the counts are added and
the probabilities computed; the values return to their blocks, and a second
pass scores the documents. Between Spark's shuffles the work is numpy on one
block or one key range, whose sizes stay the same as the input grows.

Defined cases: a null text is the empty text (an end mark only); a null id is
the empty text for the learning rule of the query; repeated rows count and
score each; a byte 0 inside a text reads like the mark; words are compared by
64-bit hashes; without learning documents all bytes are equally likely; an
empty table gives an empty result; only the named columns are read and
returned, so further columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted, release

ORDER = 4
BLOCK = 8 << 20
#: Positions handled at once inside a block.
SLICE = 2 << 20
RANGES = 64
RANGE_BYTES = 32 << 20
GROUPS = 256
WORDS, GRAMS = 0, 1

_NEEDS = "block long, kind int, r int, keys binary, counts binary"
_VALUES = "block long, kind int, r int, vals binary, types long"


def _texts(column) -> list[bytes]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [b"" if t is None else t.lower() for t in column.cast(pa.binary()).to_pylist()]


def word_keys(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; the empty word stands for the end token."""
    import xxhash
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)).view(np.int64)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(ranges)).astype(np.int64)


def in_ranges(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by (range, key), and their ranges in that order."""
    r = _range_of(keys, ranges)
    order = np.lexsort((keys, r))
    return order, r[order]


def gram_slices(texts: list[bytes], order: int):
    """Byte sequences (order + 1 bytes, the last one predicted) of the texts,
    a slice of positions at a time: (sequences, index of their text)."""
    ends = np.cumsum([len(t) + order + 1 for t in texts])  # one past the end mark's pads
    flat = np.frombuffer(b"\0" * order + (b"\0" * (order + 1)).join(texts) + b"\0" * (order + 1), dtype=np.uint8)
    size = int(ends[-1]) if len(texts) else 0  # positions order .. order + size of flat
    for lo in range(0, size, SLICE):
        hi = min(size, lo + SLICE)
        part = flat[lo:hi + order].astype(np.int64)
        grams = part[order:].copy()
        for k in range(1, order + 1):
            grams |= part[order - k:len(part) - k] << (8 * k)
        at = np.arange(lo, hi)
        owner = np.searchsorted(ends, at, side="right").astype(np.int32)
        real = at < ends[owner] - order  # the pads after the end mark are not predicted
        yield grams[real], owner[real]


def block_needs(texts: list[bytes], learn: np.ndarray, order: int) -> tuple:
    """Distinct words' keys and byte sequences of a block with their learning counts."""
    counts: dict[bytes, int] = {b"": int(learn.sum())} if texts else {}
    from collections import Counter
    taught = Counter()
    for t, l in zip(texts, learn):
        if l:
            taught.update(t.split())
        else:
            for w in t.split():
                counts.setdefault(w, 0)
    counts.update(taught)
    words = word_keys(list(counts))
    word_counts = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    del counts, taught
    found, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.float64)]
    for grams, owner in gram_slices(texts, order):
        codes, unique = pd.factorize(grams)
        found.append(unique)
        weights.append(np.bincount(codes, weights=learn[owner], minlength=len(unique)))
    grams, back = np.unique(np.concatenate(found), return_inverse=True)
    gram_counts = np.bincount(back, weights=np.concatenate(weights), minlength=len(grams)).astype(np.int64)
    return words, word_counts, grams, gram_counts


def trie_log_probs(keys: np.ndarray, counts: np.ndarray, order: int, order1: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each sequence after the bytes
    before it. ``keys`` hold every sequence known for each of their two-byte
    contexts; ``order1`` (256 x 256) counts bytes after single bytes."""
    counts = counts.astype(np.float64)
    order0 = order1.sum(0).astype(np.float64)
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in range(2, order + 1):
        k, back = np.unique(keys & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        known[d] = k, np.bincount(back, weights=counts, minlength=len(k))

    def count(d: int, key: np.ndarray) -> np.ndarray:
        if d >= 2:
            k, c = known[d]
            return c[np.searchsorted(k, key)]
        return order1[key >> 8 & 255, key & 255].astype(np.float64) if d == 1 else order0[key & 255]

    def context(d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each sequence: what followed its d-byte context (count, distinct
        bytes) and the count of those bytes one order below."""
        if d == 0:
            return (np.full(len(keys), order0.sum()), np.full(len(keys), float((order0 > 0).sum())), np.zeros(len(keys)))
        if d == 1:
            seen = order1 > 0
            last = keys >> 8 & 255
            return order1.sum(1).astype(np.float64)[last], seen.sum(1).astype(np.float64)[last], (seen @ order0)[last]
        k, c = known[d]
        ctx, back = np.unique(k >> 8, return_inverse=True)
        seen = c > 0
        below = np.where(seen, count(d - 1, k & ((1 << 8 * d) - 1)), 0.0)
        at = np.searchsorted(ctx, keys >> 8 & ((1 << 8 * d) - 1))
        return tuple(np.bincount(back, weights=x, minlength=len(ctx))[at] for x in (c, seen.astype(np.float64), below))

    out, open_ = np.zeros(len(keys)), np.ones(len(keys), dtype=bool)
    less_n, less_q = np.zeros(len(keys)), np.zeros(len(keys))
    with np.errstate(divide="ignore", invalid="ignore"):
        for d in range(order, -1, -1):
            n, q, below = context(d)
            c = count(d, keys & ((1 << 8 * (d + 1)) - 1))
            rest_n, rest_q = n - less_n, q - less_q
            hit = open_ & (c > 0)
            out[hit] += np.log10(c[hit] / (rest_n + rest_q)[hit])
            open_ &= ~hit
            escape = open_ & (rest_q > 0)
            out[escape] += np.log10((rest_q / (rest_n + rest_q))[escape])
            less_n, less_q = below, q
    out[open_] -= np.log10(256.0 - (order0 > 0).sum())
    return out


def _chunks(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> pa.Table:
    order, r = in_ranges(keys, ranges)
    keys, counts = keys[order], counts[order].astype(np.uint32)
    cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
    stops = np.r_[cuts[1:], len(r)]
    n = len(cuts)
    return pa.table({"block": pa.array([block] * n, pa.int64()), "kind": pa.array([kind] * n, pa.int32()),
                     "r": pa.array(r[cuts].tolist(), pa.int32()),
                     "keys": pa.array([keys[a:b].tobytes() for a, b in zip(cuts, stops)], pa.binary()),
                     "counts": pa.array([counts[a:b].tobytes() for a, b in zip(cuts, stops)], pa.binary())})


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, key, count) entries of a key range, from the chunks of its blocks."""
    blocks = table.column("block").to_numpy()
    keys = [np.frombuffer(b, np.int64) for b in table.column("keys").to_pylist()]
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
    return np.repeat(blocks, [len(k) for k in keys]), np.concatenate(keys), counts.astype(np.float64)


def _returned(kind: int, r: int, block: np.ndarray, keys: np.ndarray, value: np.ndarray, types: int) -> pa.Table:
    """A row per block with its values in key order (chunks of one block made one)."""
    order = np.lexsort((keys, block))
    block, keys, value = block[order], keys[order], value[order]
    first = np.r_[True, (block[1:] != block[:-1]) | (keys[1:] != keys[:-1])]
    block, value = block[first], value[first]
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    stops = np.r_[cuts[1:], len(block)]
    n = len(cuts)
    return pa.table({"block": pa.array(block[cuts], pa.int64()), "kind": pa.array([kind] * n, pa.int32()),
                     "r": pa.array([r] * n, pa.int32()),
                     "vals": pa.array([value[a:b].tobytes() for a, b in zip(cuts, stops)], pa.binary()),
                     "types": pa.array([types] + [0] * (n - 1), pa.int64())})


def _needs_of_blocks(order: int, ranges: int):
    def run(batches):
        current, texts, learn = None, [], []

        def flush():
            words, word_counts, grams, gram_counts = block_needs(texts, np.array(learn, dtype=np.float64), order)
            for kind, keys, counts in ((WORDS, words, word_counts), (GRAMS, grams, gram_counts)):
                yield from _chunks(current, kind, keys, counts, ranges).to_batches()
            release()

        for batch in batches:  # sorted by block
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else []
            for a, b in zip(cuts, np.r_[cuts[1:], len(blocks)] if len(blocks) else []):
                if blocks[a] != current and texts:
                    yield from flush()
                    texts, learn = [], []
                current = int(blocks[a])
                texts += _texts(batch.column("text").slice(a, b - a))
                learn += batch.column("learn").slice(a, b - a).to_pylist()
        if texts:
            yield from flush()
    return run


def _word_totals(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    block, keys, counts = _gathered(table)
    unique, back = np.unique(keys, return_inverse=True)
    totals = np.bincount(back, weights=counts, minlength=len(unique)).astype(np.int64)
    return _returned(WORDS, key[0].as_py(), block, keys, totals[back], int((totals > 0).sum()))


def _gram_totals(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    _, keys, counts = _gathered(table)
    unique, back = np.unique(keys, return_inverse=True)
    totals = np.bincount(back, weights=counts, minlength=len(unique)).astype(np.int64)
    return pa.table({"r": pa.array([key[0].as_py()] * len(unique), pa.int32()), "key": unique, "c": totals})


def _gram_values(key, needs: pa.Table, probs: pa.Table) -> pa.Table:
    block, keys, _ = _gathered(needs)
    known = probs.column("key").to_numpy()
    order = np.argsort(known)
    value = probs.column("lp").to_numpy()[order][np.searchsorted(known[order], keys)]
    return _returned(GRAMS, key[0].as_py(), block, keys, value, 0)


def _score_block(order: int, ranges: int, n_tokens: int, n_types: int, columns: list[str], schema: pa.Schema):
    scale = n_tokens + 0.5 * (n_types + 1)

    def run(key, docs: pa.Table, values: pa.Table) -> pa.Table:
        texts = _texts(docs.column("text"))
        parts = {(k, r): v for k, r, v in zip(*(values.column(c).to_pylist() for c in ("kind", "r", "vals")))}

        def lookup(keys: np.ndarray, kind: int, dtype) -> np.ndarray:
            at, r = in_ranges(keys, ranges)
            flat = np.frombuffer(b"".join(parts[kind, x] for x in dict.fromkeys(r.tolist())), dtype)
            out = np.empty(len(keys), dtype)
            out[at] = flat
            return out

        number: dict[bytes, int] = {b"": 0}
        for t in texts:
            for w in t.split():
                if w not in number:
                    number[w] = len(number)
        counts = lookup(word_keys(list(number)), WORDS, np.int64)
        logs, seen = np.log10((counts + 0.5) / scale), counts > 0
        sizes, base, n_known = [], [], []
        for t in texts:
            words = t.split()
            ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
            sizes.append(len(ids) + 1)
            base.append(float(logs[ids].sum() + logs[0]))
            n_known.append(int(seen[ids].sum() + seen[0]))
        del number, logs, seen, counts

        slices = []
        for grams, owner in gram_slices(texts, order):
            codes, unique = pd.factorize(grams)
            slices.append((codes.astype(np.int32), unique, owner))
        grams = np.unique(np.concatenate([s[1] for s in slices]))
        probs = lookup(grams, GRAMS, np.float64)
        score = np.zeros(len(texts))
        for codes, unique, owner in slices:
            score += np.bincount(owner, weights=probs[np.searchsorted(grams, unique)][codes], minlength=len(texts))
        out = {c: docs.column(c) for c in columns}
        out |= {"n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())}
        del slices, grams, probs, texts, parts, docs, values
        release()
        return pa.table({f.name: out[f.name] for f in schema}).cast(schema)
    return run


def score_texts(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Per row: ``key``, learn (boolean), n_tokens, n_known, train_tokens,
    base_score (word model) and score (PPM), all log10."""
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    rows = docs.select(quoted(key).alias("doc_key"), F.coalesce(learn, F.lit(False)).alias("learn"),
                       F.coalesce(quoted(text), F.lit("")).alias("text"))
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("text") + 1).alias("b")) \
        .agg(F.sum("b").alias("total"), F.max("b").alias("most")).first()
    total, most = sizes["total"] or 0, sizes["most"] or 0
    per_part = max(1, math.ceil(most / BLOCK))
    ranges = max(RANGES, math.ceil(total / RANGE_BYTES))
    # blocks stay inside a scan partition, so the table is written without a shuffle; once
    # written, a row's block is fixed
    blocks = rows.withColumn("block", F.spark_partition_id().cast("long") * per_part
                             + F.floor(F.rand(11) * per_part)).sortWithinPartitions("block")
    rows, _ = materialize(blocks, "lm-texts")
    needs, _ = materialize(rows.select("block", "learn", "text").mapInArrow(_needs_of_blocks(order, ranges), _NEEDS),
                           "lm-needs", 1000)
    words = needs.filter(F.col("kind") == WORDS).groupBy("r").applyInArrow(_word_totals, _VALUES)
    words, _ = materialize(words, "lm-words")
    gram_needs = needs.filter(F.col("kind") == GRAMS)
    grams, _ = materialize(gram_needs.groupBy("r").applyInArrow(_gram_totals, "r int, key long, c long"), "lm-grams")

    n_types = words.agg(F.sum("types")).first()[0] or 0
    n_tokens = rows.filter("learn").agg(F.sum(F.size(F.filter(F.split(
        "text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")) + 1)).first()[0] or 0
    # byte pairs: at most 65,536 rows whatever the input
    order1 = np.zeros((256, 256))
    for row in grams.groupBy((F.col("key").bitwiseAND(F.lit(65535))).alias("k")).agg(F.sum("c").alias("c")).collect():
        order1[row["k"] >> 8, row["k"] & 255] = row["c"]
    shared = docs.sparkSession.sparkContext.broadcast(order1)

    def with_probs(table: pa.Table) -> pa.Table:
        keys, counts = table.column("key").to_numpy(), table.column("c").to_numpy()
        return pa.table({"r": table.column("r"), "key": keys, "lp": trie_log_probs(keys, counts, order, shared.value)})

    # all sequences with the same two bytes before the last meet in one group
    group = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(F.lit(65535))), F.lit(GROUPS))
    probs = grams.groupBy(group.alias("g")).applyInArrow(with_probs, "r int, key long, lp double")
    gram_values = gram_needs.groupBy("r").cogroup(probs.groupBy("r")).applyInArrow(_gram_values, _VALUES)
    out = rows.select("doc_key", "learn").withColumns({
        "n_tokens": F.lit(0).cast("long"), "n_known": F.lit(0).cast("long"),
        "base_score": F.lit(0.0), "score": F.lit(0.0)}).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    scored = rows.groupBy("block").cogroup(words.unionByName(gram_values).groupBy("block")).applyInArrow(
        _score_block(order, ranges, n_tokens, n_types, ["doc_key", "learn"], to_arrow_schema(out)), out)
    return scored.select(F.col("doc_key").alias(key), "learn", "n_tokens", "n_known",
                         F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
