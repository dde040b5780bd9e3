"""Near-duplicate classes by DartMinHash signatures.

A text is the weighted set of its five-word shingles (weight 1 + ln(count);
a text of one to four words is one shingle). Over the region element x weight
x time falls a fixed random rain of darts, the same for all texts: one dart
per unit of area on average, hashed from the element and the unit cell it
falls in, each aimed at one of ``COORDINATES`` coordinates. A text sees the
darts below its weights, and its signature holds the earliest dart of each
coordinate: two texts agree on a coordinate with the probability of their
weighted Jaccard similarity. Time is walked in unit steps only until every
coordinate has a dart, so long texts need one step and the cost follows the
number of shingles, not shingles x coordinates.

Signatures are cut into ``BANDS`` bands of ``ROWS``; texts equal in a band
share a bucket (a pair at similarity 0.8 shares none with probability 7e-5).
Candidate pairs are verified exactly (similarity of 0.8 or more) and linked;
classes are connected components of verified links:

* equal texts collapse to one node before anything is paired;
* first each node is compared with one other: of all nodes that it shares a
  bucket with, the one that meets most nodes altogether (copies of a text meet
  the original more often than each other). One pair per node, however large
  the bucket;
* then, while a bucket holds several components, its nodes are compared with
  those of its first 4, 128, 4,096, ... nodes (by the same order) that belong to
  another component, until every pair of the bucket is inside a component,
  compared, or known to be below the threshold. Known without comparing: by
  the triangle inequality (Jaccard distance is a metric) over a node both were
  compared with; by the weight of shingles that no other open text has, and of
  shingles outside a node both were compared with, which bound what two texts
  can have in common; and by ``SKETCH_BITS`` signature bits that
  differ in more places than a pair at 0.8 does (missed with probability 1e-5).
  A family of copies thus costs pairs in proportion to its size, and no link is
  lost beyond the stated probabilities.

Buckets, pairs, labels and links stay in tables; the driver sees counts only.

Defined cases: a null text is the empty text; equal texts (also the empty
ones) are one class; words are separated by ``[\\x20\\x09-\\x0D]``; a class is
named by its smallest non-null id (null if it has none); repeated rows get
their class each; an empty table gives an empty result; ``deduplicate`` keeps
the row with the smallest id (ties: smallest remaining columns that can be
ordered), null ids last, and leaves further columns alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, quoted, release

WINDOW = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Bits kept of each coordinate; a pair at similarity 0.8 differs in 48 +- 10 of the 480.
SKETCH_BITS, SKETCH_DIFFER = 4, 91
SKETCH_WORDS = 8
RUN_CHARS = 1_500_000
MEMO = 150_000
#: Rows of a batch sent to Python: texts, and pairs with two shingle sets.
TEXT_ROWS, PAIR_ROWS = 1000, 200

_G = np.uint64(0x9E3779B97F4A7C15)


def _times_g(i: int) -> np.uint64:
    """i * _G modulo 2^64, for single numbers."""
    return np.uint64(i * int(_G) & 0xFFFFFFFFFFFFFFFF)


_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: P(Poisson(1) <= n) for the number of darts in a unit cell.
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, n + 1))) for n in range(16)])


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle hashes and counts of texts; remembers word hashes."""

    def __init__(self):
        import xxhash
        self.hash, self.memo = xxhash.xxh64_intdigest, {}

    def elements(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words, memo = text.split(), self.memo
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = self.hash(w)
        h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(WINDOW, len(h))
        total = h[:len(h) - n + 1].copy()
        for i in range(1, n):
            total = _mix(total + _times_g(i)) ^ h[i:len(h) - n + 1 + i]
        return np.unique(_mix(total), return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(texts, COORDINATES) earliest darts; rows of empty sets stay ``_EMPTY``."""
    k = COORDINATES
    best = np.full(len(sets) * k, _EMPTY)
    elements = np.concatenate([s[0] for s in sets]) if sets else np.zeros(0, np.uint64)
    if not len(elements):
        return best.reshape(len(sets), k)
    weight = weights(np.concatenate([s[1] for s in sets]))
    owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    cells = np.ceil(weight).astype(np.int64)
    cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    owner, below = np.repeat(owner, cells), np.repeat(weight, cells) - cell  # darts lie at x < below
    seed = _mix(np.repeat(elements, cells) + _G * cell.astype(np.uint64))
    step = 0
    while len(seed):
        rain = _mix(seed ^ _mix(np.array([_times_g(step + 1)])))
        number = np.searchsorted(_POISSON, (rain >> np.uint64(11)).astype(np.float64) / float(1 << 53))
        found = np.full(len(best), _EMPTY) if len(seed) > len(best) // 4 else None
        slots, darts = [], []
        for q in range(int(number.max())):
            at = np.flatnonzero(number > q)
            dart = _mix(rain[at] + _times_g(q + 1))  # high bits: when within the step; all bits: which
            aim = _mix(dart)
            x = (aim >> np.uint64(32)).astype(np.float64) / float(1 << 32)
            hit = x < below[at]
            slots.append(owner[at[hit]] * k + (aim[hit] % np.uint64(k)).astype(np.int64))
            darts.append(dart[hit])
        if slots:
            slot, dart = np.concatenate(slots), np.concatenate(darts)
            if found is None:  # few texts are left: sort instead of a pass over all slots
                order = np.lexsort((dart, slot))
                slot, dart = slot[order], dart[order]
                first = np.r_[True, slot[1:] != slot[:-1]] if len(slot) else np.zeros(0, bool)
                slot, dart = slot[first], dart[first]
                free = best[slot] == _EMPTY
                best[slot[free]] = dart[free]
            else:
                np.minimum.at(found, slot, dart)
                best = np.where(best == _EMPTY, found, best)
        open_ = (best.reshape(-1, k)[np.unique(owner)] == _EMPTY).any(axis=1)
        still = np.zeros(len(sets), bool)
        still[np.unique(owner)[open_]] = True
        stay = still[owner]
        seed, owner, below = seed[stay], owner[stay], below[stay]
        step += 1
    return best.reshape(len(sets), k)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) bucket keys; the band number is part of the key."""
    parts = signature.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _G, parts.shape[:2]).copy()
    for i in range(ROWS):
        key = _mix(key ^ parts[:, :, i]) + _G
    return key.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """(texts, SKETCH_WORDS) the lowest bits of every coordinate, packed."""
    low = (signature & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.uint8)
    packed = np.zeros((len(signature), SKETCH_WORDS * 8), dtype=np.uint8)
    packed[:, :COORDINATES // 2] = low[:, ::2] << SKETCH_BITS | low[:, 1::2]
    return packed.view(np.int64)


def compare(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Weighted Jaccard of two shingle sets (sorted elements, counts), and the
    weight of the first on the elements of the second."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0.0
    wa, wb = weights(a[1]), weights(b[1])
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(wa[i], wb[j]).sum()
    return float(low / (wa.sum() + wb.sum() - low)), float(wa[i].sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    return compare(a, b)[0]


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= RUN_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _sign(batches):
    shingler = Shingler()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for a, b in _runs(texts):
            sets = [shingler.elements(t) for t in texts[a:b]]
            full = np.array([len(s[0]) > 0 for s in sets])
            signed = signatures(sets)
            listed = lambda x: pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(full * x.shape[1])].astype(np.int32)), pa.array(x[full].reshape(-1)))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").slice(a, b - a), batch.column("node").slice(a, b - a), listed(band_keys(signed)),
                listed(sketches(signed)), pa.array([float(weights(c).sum()) for _, c in sets], pa.float64())],
                ["id", "node", "bands", "sketch", "total"])
    del shingler
    release()


def _shingle(batches):
    shingler = Shingler()
    for batch in batches:
        sets = [shingler.elements(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("node"), pa.array([e.tobytes() for e, _ in sets], pa.binary()),
            pa.array([c.astype(np.uint32).tobytes() for _, c in sets], pa.binary())], ["node", "elements", "counts"])
    del shingler
    release()


def _verify(batches):
    def sets(batch, e, c):
        return ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint32))
                for x, y in zip(batch.column(e), batch.column(c)) for x, y in ((x.as_py(), y.as_py()),))

    for batch in batches:
        found = [compare(x, y) for x, y in zip(sets(batch, "e_a", "c_a"), sets(batch, "e_b", "c_b"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array([f[0] for f in found], pa.float64()),
             pa.array([f[1] for f in found], pa.float64())], ["a", "b", "similarity", "inside"])


def _elements(batches):
    """One row per element of a node: batches of about ``ELEMENT_ROWS`` rows, of many nodes."""
    def out(held):
        nodes, keys, counts = zip(*held)
        sizes = list(map(len, keys))
        named = pa.array(nodes, pa.string()).take(pa.array(np.repeat(np.arange(len(nodes)), sizes)))
        return pa.RecordBatch.from_arrays([named, pa.array(np.concatenate(keys)), pa.array(weights(np.concatenate(counts)))],
                                          ["node", "element", "weight"])
    for batch in batches:
        held, rows = [], 0
        for node, e, c in zip(*(batch.column(x).to_pylist() for x in ("node", "elements", "counts"))):
            held.append((node, np.frombuffer(e, np.int64), np.frombuffer(c, np.uint32)))
            rows += len(held[-1][1])
            if rows >= ELEMENT_ROWS:
                yield out(held)
                held, rows = [], 0
        if held:
            yield out(held)


def flatten(parents: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) of a forest (node, up); ``up`` must not lead in a circle.
    Pointers are doubled until they all end at roots."""
    spark = parents.sparkSession
    up, at = materialize(parents.select("node", "up"), "dedup-up")
    while True:
        higher = up.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
        jumped = up.join(higher, F.col("up") == F.col("n2"), "left")
        nxt, nxt_at = materialize(jumped.select("node", F.coalesce("up2", "up").alias("up"),
                                                F.col("up2").isNotNull().alias("moved")), "dedup-up")
        moved = not nxt.filter("moved").isEmpty()
        discard(spark, at)
        up, at = nxt.select("node", "up"), nxt_at
        if not moved:
            return up.withColumnRenamed("up", "root"), at


def connect(edges: DataFrame) -> tuple[DataFrame, str]:
    """Components of an undirected edge table (a, b): a table (node, root)
    with root the smallest node, for all nodes in edges. Roots hook onto their
    smallest neighbouring root, the pointers are flattened, edges move to the
    roots, until no edge is left."""
    spark = edges.sparkSession
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels, at = materialize(ends.select("node", F.col("node").alias("root")), "dedup-labels")
    left, left_at = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"),
                                                             F.least("a", "b").alias("b")).distinct(), "dedup-edges")
    while not left.isEmpty():
        # every root with a smaller neighbour points to the smallest one
        up, up_at = flatten(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")))
        to = up.select(F.col("node").alias("n2"), F.col("root").alias("up2"))
        new, new_at = materialize(labels.join(to, F.col("root") == F.col("n2"), "left").select(
            "node", F.coalesce("up2", "root").alias("root")), "dedup-labels")
        a = left.join(to, F.col("a") == F.col("n2"), "left").select(F.coalesce("up2", "a").alias("a"), "b")
        moved_edges = a.join(to, F.col("b") == F.col("n2"), "left").select("a", F.coalesce("up2", "b").alias("b"))
        rest, rest_at = materialize(moved_edges.filter("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "dedup-edges")
        discard(spark, at, left_at, up_at)
        labels, at, left, left_at = new, new_at, rest, rest_at
    discard(spark, left_at)
    return labels, at


def _check_pairs(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(a, b, similarity, inside, alike) for candidate pairs (a, b); inside is
    the weight of a on b's shingles."""
    side = lambda s: shingles.select(F.col("node").alias(s), F.col("elements").alias(f"e_{s}"),
                                     F.col("counts").alias(f"c_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b") \
        .select("a", "b", "e_a", "c_a", "e_b", "c_b").mapInArrow(_verify, "a string, b string, similarity double, inside double") \
        .withColumn("alike", F.col("similarity") >= SIMILARITY - 1e-12)


def _joined(roots: DataFrame, links: DataFrame) -> tuple[DataFrame, str]:
    """``roots`` after components joined by ``links`` have become one."""
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(at("a"), "a", "left").join(at("b"), "b", "left") \
        .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct()
    merged, merged_at = connect(between)
    to = merged.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
    moved = roots.join(to, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root"))
    # a component of one node had no row of its own yet
    alone = merged.join(roots.select("node"), "node", "left_anti")
    out = materialize(moved.unionByName(alone), "dedup-labels")
    discard(roots.sparkSession, merged_at)
    return out


_KNOWN = ("total", "shared", "hub", "far", "inside", "outside", "sketch", "bands")


def _known(open_: DataFrame, shingles: DataFrame, signed: DataFrame, hubs: DataFrame):
    """The open nodes' shingles, and what bounds their similarities: weight,
    weight that any other open node shares, the node they were compared with,
    their distance from it and their weight on its shingles, the weight that
    others may share outside of those, and the sketch."""
    nodes, nodes_at = materialize(open_.select("node").distinct(), "dedup-nodes")
    own, own_at = materialize(shingles.join(nodes, "node"), "dedup-shingles")
    elements = own.mapInArrow(_elements, "node string, element long, weight double")
    private = elements.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"),
                                              F.min("weight").alias("weight")).filter("n = 1") \
        .groupBy("node").agg(F.sum("weight").alias("private"))
    marks = signed.join(nodes, "node").groupBy("node").agg(F.first("total").alias("total"), F.first("sketch").alias("sketch"),
                                                          F.first("bands").alias("bands"))
    hubs = hubs.join(nodes.select(F.col("node").alias("hub"), F.lit(True).alias("hub_open")), "hub", "left")
    shared = F.col("total") - F.coalesce("private", F.lit(0.0))
    inside = F.coalesce("inside", "total")
    # an open hub's shingles are nobody's private ones; of another hub this is not known
    outside = F.when(F.col("hub_open"), F.greatest(F.lit(0.0), shared - inside)) \
        .otherwise(F.least(F.col("total") - inside, shared))
    known, known_at = materialize(
        marks.join(private, "node", "left").join(hubs, "node", "left").select(
            "node", "total", shared.alias("shared"), F.coalesce("hub", "node").alias("hub"),
            F.coalesce("far", F.lit(0.0)).alias("far"), inside.alias("inside"), outside.alias("outside"), "sketch",
            "bands"), "dedup-known")
    return own, known, [nodes_at, own_at, known_at]


def _may_be_alike() -> Column:
    """Whether a node and a pivot of another component may reach the
    threshold. Each pair comes up once: under its better-ranked node as the
    pivot, in the first of the buckets that both are in."""
    slack = 1e-9
    same_hub = F.col("hub") == F.col("hub_b")
    common = F.least("shared", "shared_b")
    common = F.when(same_hub, F.least(common, F.least("inside", "inside_b") + F.least("outside", "outside_b"))) \
        .otherwise(common)
    reach = common >= SIMILARITY * (F.col("total") + F.col("total_b") - common) - slack
    apart = same_hub & (F.abs(F.col("far") - F.col("far_b")) > 1 - SIMILARITY + slack)
    differ = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    before = (F.col("score_b") > F.col("score")) | ((F.col("score_b") == F.col("score")) & (F.col("node_b") < F.col("node")))
    once = F.col("bucket") == F.array_min(F.array_intersect("bands", "bands_b"))
    return (F.col("comp") != F.col("comp_b")) & before & reach & ~apart & (differ <= SKETCH_DIFFER) & once


#: Words of the filter that spares texts outside any bucket the shuffle.
FILTER_WORDS = 1 << 20
#: Rows of a batch of elements that goes back to Spark.
ELEMENT_ROWS = 100_000


def _likely(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose node may be in ``chosen``: a Bloom filter of 64-bit
    words as a table of at most ``FILTER_WORDS`` rows, which bounds its
    broadcast. The more nodes are chosen, the more rows pass needlessly."""
    def places(node: str) -> tuple[Column, Column]:
        h = F.xxhash64(F.col(node), F.lit("filter"))
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, n), F.lit(64)).cast("int"))
                for n in (20, 28, 36)]
        return F.pmod(h, F.lit(FILTER_WORDS)), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])

    word, mask = places("node")
    bits = chosen.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    return rows.withColumns({"word": word, "mask": mask}).join(F.broadcast(bits), "word") \
        .filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).drop("word", "mask", "bits")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, node (128-bit hash of the text) and
    component (a node); texts of one component are near-duplicates."""
    spark = docs.sparkSession
    t = F.coalesce(quoted(text), F.lit(""))
    rows = docs.select(quoted(key).alias("id"), F.md5(F.encode(t, "UTF-8")).alias("node"), t.alias("text"))
    signed, _ = materialize(rows.mapInArrow(_sign, f"id {docs.schema[key].dataType.simpleString()}, node string, "
                                                   "bands array<bigint>, sketch array<bigint>, total double"), "dedup-signed", TEXT_ROWS)
    nodes = signed.groupBy("node").agg(F.first("bands").alias("bands"), F.min("id").alias("id"))
    members = nodes.select("node", "id", F.explode("bands").alias("bucket"))
    # equal texts are one node; buckets of one node pair nothing
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members, members_at = materialize(members.join(shared, "bucket"), "dedup-members")
    # the node that meets most others is the likely centre of a family
    weight = members.groupBy("node").agg(F.sum("size").alias("score"), F.min("id").alias("id"))
    members, buckets_at = materialize(members.select("bucket", "node").join(weight, "node"), "dedup-buckets")
    discard(spark, members_at)

    chosen = members.select("node", "id").distinct()
    picked = _likely(rows, chosen).join(chosen.select(F.col("node").alias("n2"), F.col("id").alias("id2")),
                       (F.col("node") == F.col("n2")) & F.col("id").eqNullSafe(F.col("id2"))) \
        .groupBy("id", "node").agg(F.first("text").alias("text"))
    shingles, _ = materialize(picked.select("node", "text").mapInArrow(
        _shingle, "node string, elements binary, counts binary"), "dedup-shingles", TEXT_ROWS)

    centre = members.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("c"))
    pairs = members.join(centre, "bucket").groupBy(F.col("node").alias("a")).agg(F.max("c").alias("c")) \
        .select("a", F.col("c.node").alias("b")).filter("a <> b")
    tested, tested_at = materialize(_check_pairs(pairs, shingles), "dedup-pairs", PAIR_ROWS)
    # every node points to one of a higher (score, node), so the links are a forest
    roots, roots_at = flatten(tested.filter("alike").select(F.col("a").alias("node"), F.col("b").alias("up")))
    hubs = tested.select(F.col("a").alias("node"), F.col("b").alias("hub"), (1 - F.col("similarity")).alias("far"), "inside")
    all_tested, held = [tested], [tested_at, buckets_at]
    done, reach, known = 0, 4, None
    while True:
        named = members.join(roots, "node", "left").select(
            "bucket", "node", "score", F.coalesce("root", "node").alias("comp"))
        mixed = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
            .filter("lo < hi").select("bucket")
        open_, open_at = materialize(named.join(mixed, "bucket"), "dedup-open")
        if known is None:  # later open nodes are among these, so what is known of them stays true
            shingles, known, known_at = _known(open_, shingles, signed, hubs)
            held += known_at
        ranked = open_.withColumn("rank", F.row_number().over(
            Window.partitionBy("bucket").orderBy(F.desc("score"), "node"))).filter(F.col("rank") <= reach + 1)
        pivots, pivots_at = materialize(ranked, "dedup-pivots")
        more = not pivots.filter(F.col("rank") > reach).isEmpty()
        other = pivots.filter((F.col("rank") > done) & (F.col("rank") <= reach)) \
            .join(known, "node").select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("node", "score", "comp", *_KNOWN)])
        new = open_.join(known, "node").join(other, "bucket").filter(_may_be_alike()) \
            .select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b")).distinct()
        old = all_tested[0]
        for t in all_tested[1:]:
            old = old.unionAll(t)
        new = new.join(old.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
        new, new_pairs_at = materialize(new, "dedup-pairs")
        discard(spark, open_at, pivots_at)
        if not new.isEmpty():
            tested, tested_at = materialize(_check_pairs(new, shingles), "dedup-pairs", PAIR_ROWS)
            all_tested.append(tested)
            held.append(tested_at)
            links = tested.filter("alike").select("a", "b")
            if not links.isEmpty():
                roots, roots_at, old_at = *_joined(roots, links), roots_at
                discard(spark, old_at)
        discard(spark, new_pairs_at)
        if not more:
            break
        done, reach = reach, reach * 32
    discard(spark, *held)
    return signed.select("id", "node").join(roots, "node", "left") \
        .select("id", "node", F.coalesce("root", "node").alias("component"))


def class_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, class_id (smallest id of the class) and
    class_size (rows)."""
    found = near_classes(docs, key, text)
    sizes = found.groupBy(F.col("component").alias("c2")).agg(F.min("id").alias("class_id"),
                                                              F.count(F.lit(1)).alias("class_size"))
    return found.join(sizes, F.col("component") == F.col("c2")) \
        .select(F.col("id").alias(key), "class_id", "class_size")


def _orderable(df: DataFrame) -> list[Column]:
    return [quoted(f.name) for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant", "interval")]


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate class."""
    found = near_classes(docs, key, text)
    first = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("node").alias("node"))
    node, kept_id, kept_node, row = (fresh(x) for x in ("node", "kept_id", "kept_node", "row"))
    kept = found.groupBy("component").agg(F.min(first).alias("k")).select(
        F.col("k.id").alias(kept_id), F.col("k.node").alias(kept_node))
    rows = docs.withColumn(node, F.md5(F.encode(F.coalesce(quoted(text), F.lit("")), "UTF-8"))).join(
        kept, (quoted(node) == quoted(kept_node)) & quoted(key).eqNullSafe(quoted(kept_id)))
    one = rows.withColumn(row, F.row_number().over(
        Window.partitionBy(kept_id, kept_node).orderBy(*_orderable(docs))))
    return one.filter(quoted(row) == 1).select(*[quoted(c) for c in docs.columns])
