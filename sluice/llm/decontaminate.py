"""Benchmark decontamination: CGK embedding, repeated bit sampling, edit check.

Finds passages of documents within a small word edit distance of a benchmark
item (``max_edits`` of its word count). Words are what Unicode white space
parts; their case is folded, canonical equivalents (composed and decomposed
accents) are one, and outer punctuation of any script is cut off.

The CGK embedding walks over a window of words: in step j it writes the current
word and moves on with a random bit drawn for (j, word), waiting at the
window's last word. Two windows read with the same bits fall into step again
after an edit, so a small edit distance becomes a small Hamming distance. A
repetition has its own bits and samples ``SAMPLES`` of the steps; document
windows that agree with an item in all of them are candidates.

Items are classed by length (about 1.5 x apart). A class embeds its shortest
length, at most ``LONGEST_WINDOW`` words, at every word of a text that can begin a
match (each word that occurs in no item costs an edit; windows with too many
are left out, which loses none). A class repeats until the measured share of trial pairs (an item and a
copy with ``max_edits`` random edits, other words behind it) found at least once
reaches ``RECALL``, or ``MOST_REPEATS`` times; ``Index.recall`` holds the share.

What sampling misses is found exactly: a match with e edits leaves one of any
e + 1 pieces of the item unedited, so every item is also cut into ``edits
allowed + 1`` pieces, embedded whole (first ``LONGEST`` words) and looked up at
every word. That loses no match, at any item length. Candidates of
both ways are verified by exact edit distance over the words that a match
can cover; ``by_sample`` and ``by_piece`` say which way found it.

Runs inside the scan tasks, one pass over the documents without a shuffle.
The items travel as a broadcast of at most ``BLOCK_WORDS`` words. A larger
benchmark is split by item hash: ``find_matches`` and ``decontaminate`` work block
after block, each block's broadcast released before the next is made.

Defined cases: a null text has no words; null and empty items are not searched,
and every other one is, however short (items too short for an edit are found
verbatim); ``min_words`` lets a caller leave out shorter items;
an item that occurs several times in a text is reported once, at its best and
first place; equal items are each reported; very long texts are searched whole, several batches of
words at a time; repeated rows are searched each;
empty tables give no matches; ``decontaminate`` returns the input columns
whatever their names.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, quoted
from .near_dedup import _mix, _times_g

BLOCK_WORDS = 2_000_000
MAX_EDITS = 0.1
MIN_WORDS = 1
LONGEST = 12
LONGEST_WINDOW = 64
SAMPLES = 4
RECALL = 0.95
MOST_REPEATS = 128
TRIALS = 200
MEMO = 400_000
WINDOWS_AT_ONCE = 400_000
RUN_CHARS = 3_000_000
#: Cut off at both ends of a word: Unicode punctuation but for "@", and some ASCII symbols.
_EDGES = "$|<>`~+=" + "".join(c for c in map(chr, range(0x20000)) if unicodedata.category(c)[0] == "P" and c != "@")
MATCHES = "array<struct<item_id:bigint,first_word:int,n_words:int,edits:int,by_sample:boolean,by_piece:boolean>>"


def normal(word: str) -> str:
    if word.isascii():
        return word.lower().strip(_EDGES)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", word).casefold()).strip(_EDGES)


def words_of(text: bytes) -> list[str]:
    return [w for w in map(normal, text.decode(errors="replace").split()) if w]


def edits_allowed(n: int, share: float) -> int:
    return int(n * share + 1e-9)


def pieces(n: int, edits: int) -> list[tuple[int, int]]:
    """Begin and end of ``edits + 1`` pieces of ``n`` words."""
    cuts = [k * n // (edits + 1) for k in range(edits + 2)]
    return list(zip(cuts, cuts[1:]))


def best_match(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Smallest edit distance of ``item`` to a run of words of ``text``, with
    the first such run's start and words (the shortest at a tie); None if above
    ``most``. A cell holds cost * 2^32 + start, so that the earlier start wins."""
    one = 1 << 32
    row = np.arange(len(text) + 1)
    steps = row * one
    for i, word in enumerate(item):
        nxt = np.empty_like(row)
        nxt[0] = (i + 1) * one
        nxt[1:] = np.minimum(row[:-1] + (text != word) * one, row[1:] + one)
        row = np.minimum.accumulate(nxt - steps) + steps
        if row.min() >= (most + 1) * one:
            return None
    end = int(row.argmin())
    cost, start = divmod(int(row[end]), one)
    return cost, start, end - start


def embedded(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of the CGK embedding of the ``size`` words from each start."""
    at = np.zeros(len(starts), dtype=np.int64)
    out = np.full(len(starts), _times_g(size * 1009))
    for j in range(2 * size):
        word = ids[starts + at].astype(np.uint64)
        out = _mix(out ^ (word + np.uint64(1)))
        bit = _mix(word ^ _times_g(j + 1)) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), size - 1)
    return out


def length_class(n: int) -> int:
    """Largest of 1, 2, 3, 4, 6, 8, 12, 16, 24, ... not above n, nor above the longest window."""
    p = 1 << (n.bit_length() - 1)
    return min(LONGEST_WINDOW, p + p // 2 if p > 1 and n >= p + p // 2 else p)


class Walks:
    """The repetitions of a length class: bits per step and sampled steps."""

    def __init__(self, size: int, repeats: int):
        self.size, self.repeats, self.steps = size, repeats, max(SAMPLES, math.ceil(1.6 * size))
        self.rows: list[list[int]] = [[] for _ in range(self.steps)]  # repetitions that sample a step
        for r in range(repeats):
            for j in np.random.default_rng([size, r]).choice(self.steps, size=SAMPLES, replace=False):
                self.rows[j].append(r)
        number = lambda values: np.array([_times_g(x) for x in values], dtype=np.uint64)[:, None]
        self.first = number(r + size * 1009 for r in range(repeats))
        self.turns = [number((r << 20) + j + 1 for r in range(repeats)) for j in range(self.steps)]

    def keys(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hash of the sampled words of the embedding of the ``size`` words from
        each start: one row per repetition."""
        at = np.zeros((self.repeats, len(starts)), dtype=np.int64)
        out = np.repeat(self.first, len(starts), axis=1)
        for j, rows in enumerate(self.rows):
            word = ids[starts + at].astype(np.uint64)
            if rows:
                out[rows] = _mix(out[rows] ^ (word[rows] + np.uint64(1)))
            bit = _mix(word ^ self.turns[j]) >> np.uint64(63)
            at = np.minimum(at + bit.astype(np.int64), self.size - 1)
        return out


def random_edits(rng: np.random.Generator, words: np.ndarray, edits: int, others: np.ndarray) -> np.ndarray:
    """A copy with ``edits`` random substitutions, insertions and deletions."""
    out = words.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(out))))
        if kind == 0:
            out[at] = int(rng.choice(others))
        elif kind == 1:
            out.insert(at, int(rng.choice(others)))
        else:
            del out[at]
    return np.array(out, dtype=np.int64)


class Index:
    """Items of one block and their pieces, by embedded length."""

    def __init__(self, items: list[tuple[int, bytes]], share: float, min_words: int):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        for item_id, text in items:
            words = words_of(text)
            if len(words) >= max(1, min_words):
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
                self.items.append((item_id, np.array(ids, dtype=np.int64), edits_allowed(len(ids), share)))
        self.lengths = np.array([len(ids) for _, ids, _ in self.items], dtype=np.int64)
        self.edits = np.array([e for _, _, e in self.items], dtype=np.int64)
        classes: dict[int, list[tuple[int, int]]] = {}
        for i, (_, ids, e) in enumerate(self.items):
            for begin, end in pieces(len(ids), e):
                classes.setdefault(min(end - begin, LONGEST), []).append((i, begin))
        self.classes = [(size, *self._table(size, np.array(members, dtype=np.int64)))
                        for size, members in sorted(classes.items())]
        sizes: dict[int, list[int]] = {}
        for i, (_, ids, _) in enumerate(self.items):
            sizes.setdefault(length_class(len(ids)), []).append(i)
        self.recall: dict[int, float] = {}
        self.windows = [self._sampled(size, members) for size, members in sorted(sizes.items())]

    def _sampled(self, size: int, members: list[int]):
        """Walks, keys and items of a length class; measures its recall."""
        rng = np.random.default_rng(size)
        others = np.arange(len(self.vocabulary) + 1)
        pairs = [self.items[members[int(i)]][1:] for i in rng.integers(len(members), size=TRIALS)]
        behind = [rng.choice(others, size) for _ in pairs]
        copies = [np.concatenate([random_edits(rng, ids, e, others), b])[:size] for (ids, e), b in zip(pairs, behind)]
        plain, edited = np.concatenate([ids[:size] for ids, _ in pairs]), np.concatenate(copies)
        at = np.arange(TRIALS) * size
        repeats, share = 4, 0.0
        while True:
            walks = Walks(size, repeats)
            share = float((walks.keys(plain, at) == walks.keys(edited, at)).any(axis=0).mean())
            if share >= RECALL or repeats >= MOST_REPEATS:
                break
            repeats = min(MOST_REPEATS, repeats * 3 // 2)
        self.recall[size] = share
        flat = np.concatenate([self.items[i][1][:size] for i in members])
        keys = walks.keys(flat, np.arange(len(members)) * size)
        order = np.argsort(keys, axis=1, kind="stable")
        return walks, max(self.items[i][2] for i in members), np.take_along_axis(keys, order, axis=1), np.array(members)[order]

    def _table(self, size: int, members: np.ndarray):
        flat = np.concatenate([self.items[i][1][at:at + size] for i, at in members])
        starts = np.arange(len(members)) * size
        opens, ends = (np.zeros(len(self.vocabulary) + 1, dtype=bool) for _ in range(2))
        opens[flat[starts]] = True
        ends[flat[starts + size - 1]] = True
        keys = embedded(flat, starts, size)
        order = np.argsort(keys, kind="stable")
        return opens, ends, keys[order], members[order]

    def search(self, texts: list[str], memo: dict[str, int]) -> list[list[tuple]]:
        """Matches of each text: (item id, first word, words, edits, by sample, by piece)."""
        vocabulary, parts, lengths = self.vocabulary, [], []
        gap = np.zeros(1, dtype=np.int64)  # no piece reaches over it
        for t in texts:
            words = t.split()
            for w in set(words):
                if w not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                        break
                    n = normal(w)
                    memo[w] = vocabulary.get(n, 0) if n else -1
            try:
                ids = np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))
            except KeyError:  # the memo was just cleared: look the words up directly
                ids = np.array([vocabulary.get(n, 0) if n else -1 for n in map(normal, words)], dtype=np.int64)
            ids = ids[ids >= 0]
            parts += [ids, gap]
            lengths.append(len(ids))
        out: list[list[tuple]] = [[] for _ in texts]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        begins = np.cumsum([0] + [n + 1 for n in lengths])
        seen = np.r_[0, np.cumsum(flat > 0)]
        # rows (text, item, where the item would begin, way)
        hits = [(self._hits(flat, seen, begins, *table), 2) for table in self.classes if len(flat) >= table[0]]
        hits += [(self._agreeing(flat, seen, begins, *table), 1) for table in self.windows if len(flat) >= table[0].size]
        if not hits:
            return out
        rows = np.concatenate([h for h, _ in hits])
        way = np.repeat([w for _, w in hits], [len(h) for h, _ in hits])
        places, place = np.unique(rows, axis=0, return_inverse=True)
        doc, member, at = places.T
        ways = np.zeros(len(places), dtype=np.int64)
        np.bitwise_or.at(ways, place.ravel(), way)
        first = begins[doc]
        low = np.maximum(at - self.edits[member], first)
        high = np.minimum(at + self.lengths[member] + self.edits[member], begins[doc + 1] - 1)
        able = np.flatnonzero(seen[high] - seen[low] >= self.lengths[member] - self.edits[member])
        doc, member, at, low, high, ways = (x[able] for x in (doc, member, at, low, high, ways))
        cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (member[1:] != member[:-1])]) if len(doc) else []
        known: dict[tuple[int, bytes], tuple[int, int, int] | None] = {}
        for a, b in zip(cuts, [*cuts[1:], len(doc)]):
            d, m = int(doc[a]), int(member[a])
            got = self._best(flat, m, at[a:b], low[a:b], high[a:b], known)
            if got is not None:
                edits, start, words = got
                by = int(np.bitwise_or.reduce(ways[a:b]))
                out[d].append((self.items[m][0], start - int(begins[d]), words, edits, bool(by & 1), bool(by & 2)))
        return [sorted(found) for found in out]

    def _hits(self, flat: np.ndarray, seen: np.ndarray, begins: np.ndarray, size: int, opens: np.ndarray,
              ends: np.ndarray, keys: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Rows (text, item, where the item would begin) of the pieces found."""
        last = len(flat) - size + 1
        starts = np.flatnonzero(opens[flat[:last]] & ends[flat[size - 1:]] & (seen[size:] - seen[:last] == size))
        found = embedded(flat, starts, size)
        low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
        n = high - low
        which = np.repeat(np.arange(len(starts)), n)
        entry = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]
        doc = np.searchsorted(begins, starts[which], side="right") - 1
        return np.stack([doc, members[entry, 0], starts[which] - members[entry, 1]], axis=1)

    def _agreeing(self, flat: np.ndarray, seen: np.ndarray, begins: np.ndarray, walks: Walks, most: int,
                  keys: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Rows (text, item, where the item would begin) of the windows that
        agree with an item in all samples of a repetition."""
        size = walks.size
        last = len(flat) - size + 1
        starts = np.flatnonzero((seen[size:] - seen[:last] >= size - most) & (flat[:last] > 0 if not most else True))
        found = [np.zeros((0, 3), dtype=np.int64)]
        step = max(1, WINDOWS_AT_ONCE // walks.repeats)
        for a in range(0, len(starts), step):
            some = starts[a:a + step]
            theirs = walks.keys(flat, some)
            for r in range(walks.repeats):
                low, high = np.searchsorted(keys[r], theirs[r], "left"), np.searchsorted(keys[r], theirs[r], "right")
                n = high - low
                which = np.repeat(np.arange(len(some)), n)
                entry = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]
                doc = np.searchsorted(begins, some[which], side="right") - 1
                found.append(np.stack([doc, members[r][entry], some[which]], axis=1))
        return np.concatenate(found)

    def _best(self, flat: np.ndarray, member: int, at: np.ndarray, low: np.ndarray, high: np.ndarray,
              known: dict) -> tuple[int, int, int] | None:
        """Best match of an item in a text: (edits, start, words)."""
        _, ids, most = self.items[member]
        for begin, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
            if begin >= a and np.array_equal(flat[begin:min(begin + len(ids), b)], ids):
                return 0, begin, len(ids)
        if not most:
            return None
        best = None
        breaks = np.flatnonzero(low[1:] > high[:-1]) + 1  # both ascend: stretches that overlap are read as one
        for a, b in zip(np.r_[0, breaks], np.r_[breaks, len(at)] - 1):
            begin, text = int(low[a]), flat[low[a]:high[b]]
            key = member, text.tobytes()
            if key not in known:
                known[key] = best_match(ids, text, most)
            if known[key] is not None:
                cost, start, words = known[key]
                if best is None or (cost, begin + start, words) < best:
                    best = cost, begin + start, words
        return best


def _udf(shared):
    @F.pandas_udf(MATCHES)
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, memo = shared.value, {}
        for texts in batches:
            out, run, chars = [], [], 0
            for t in texts:
                run.append(t)
                chars += len(t)
                if chars >= RUN_CHARS:
                    out += index.search(run, memo)
                    run, chars = [], 0
            out += index.search(run, memo)
            names = ("item_id", "first_word", "n_words", "edits", "by_sample", "by_piece")
            yield pd.Series([[dict(zip(names, m)) for m in found] for found in out])
    return matches


def _blocks(items: DataFrame, key: str, text: str, max_edits: float, min_words: int, block_words: int):
    """The items as blocks of at most about ``block_words`` words: their number
    and a function that makes the broadcast of one."""
    if not 0 <= max_edits < 1:
        raise ValueError("max_edits is a share of an item's words, at least 0 and below 1")
    spark = items.sparkSession
    slim = items.select(quoted(key).cast("long").alias("k"), F.coalesce(quoted(text), F.lit("")).alias("t"))
    total = slim.agg(F.sum(F.size(F.split("t", "\\s+")))).first()[0] or 0
    n = max(1, math.ceil(2 * total / block_words))

    def shared(b: int):
        block = slim.filter(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b) if n > 1 else slim
        rows = sorted(((r["k"], r["t"].encode()) for r in block.collect()), key=lambda r: (r[0] is None, r))
        return spark.sparkContext.broadcast(Index(rows, max_edits, min_words))
    return n, shared


def find_items(items: DataFrame, key: str = "item_id", text: str = "text", max_edits: float = MAX_EDITS,
               min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS):
    """A column function text -> array of matches for a table of items; it
    holds all blocks, so a large benchmark is better searched by ``find_matches``."""
    n, shared = _blocks(items, key, text, max_edits, min_words, block_words)
    udfs = [_udf(shared(b)) for b in range(n)]

    def found(value: Column) -> Column:
        value = F.coalesce(value, F.lit(""))
        return F.concat(*[u(value) for u in udfs]) if len(udfs) > 1 else udfs[0](value)

    return found


def _one_by_one(items: DataFrame, key: str = "item_id", text: str = "text", max_edits: float = MAX_EDITS,
                min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS):
    """Blocks one after another: (column function, last block?, release)."""
    n, shared = _blocks(items, key, text, max_edits, min_words, block_words)
    for b in range(n):
        block = shared(b)
        udf = _udf(block)
        yield (lambda value: udf(F.coalesce(value, F.lit("")))), b == n - 1, block.destroy


def find_matches(docs: DataFrame, key: str, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row per document and item found in it: ``key`` and the fields of a match."""
    out, m = None, fresh("match")
    for found, last, release in _one_by_one(items, **options):
        rows = docs.select(quoted(key), F.explode(found(quoted(text))).alias(m)).select(quoted(key), f"{m}.*")
        if not last:
            rows, _ = materialize(rows, "matches")
            release()
        out = rows if out is None else out.unionByName(rows)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item."""
    columns, n, path = [quoted(c) for c in docs.columns], fresh("found"), None
    for found, last, release in _one_by_one(items, **options):
        before = path
        docs = docs.withColumn(n, F.size(found(quoted(text)))).filter(quoted(n) == 0).select(*columns)
        if not last:
            docs, path = materialize(docs, "clean")
            release()
            if before is not None:
                discard(docs.sparkSession, before)
    return docs
