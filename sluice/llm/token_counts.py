"""Token counts by rank-synchronous array merging.

Byte-level BPE counts without encoding a text on its own. The pre-tokens of
a batch are held as one ragged numpy array of symbols; in every round each
sequence finds its lowest-rank adjacent pair, and all sequences apply theirs
at the same time (every occurrence, from the left). Sequences without a
known pair leave the array; the symbols that remain are the token count.

A merge made from a symbol always ranks after the merge that made the
symbol, so applying all occurrences of the lowest pair at once gives the
tokens of one-at-a-time merging.

Runs as an Arrow-batched column function inside Spark's scan tasks: no
shuffle, memory bounded by the batch (cut into runs of ``RUN_CHARS``) and by
a bounded memo of pre-token counts; only the vocabulary is broadcast (its
size is the tokenizer's). Added tokens inside a text count as one token each,
as the library's default does.

Defined cases: a null or empty text has 0 tokens; very long texts and very
long pre-tokens are counted whole; repeated rows, null ids and further
columns are carried through; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the split pattern of byte-level BPE files. White space is
#: spelled as the Unicode property, which is what the library matches.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
RUN_CHARS = 4_000_000
MEMO = 300_000
_NONE = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: bytes
    that print stand for themselves, the others take code points from 256 on."""
    prints = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Ranks and results of the merges, as sorted arrays."""

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        if not plain or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE files without a normalizer are supported")
        vocab = model["vocab"]
        self.first = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.base = int(max(vocab.values())) + 1
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.added = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], _NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token (none of them empty)."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        out = sizes.copy()
        symbols = self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        while len(symbols) > 1:
            inside = owner[1:] == owner[:-1]
            ranks = np.full(len(symbols), _NONE)
            ranks[:-1][inside] = self.rank(symbols[:-1][inside], symbols[1:][inside])
            starts = np.flatnonzero(np.r_[True, ~inside])
            lengths = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(ranks, starts)
            done = lowest == _NONE
            out[owner[starts[done]]] = lengths[done]
            take = (ranks == np.repeat(lowest, lengths)) & (ranks != _NONE)
            at = np.flatnonzero(take)
            # in a run of overlapping equal pairs every second one is applied, from the left
            opens = np.r_[True, np.diff(at) != 1]
            number = np.arange(len(at))
            at = at[(number - number[np.flatnonzero(opens)][np.cumsum(opens) - 1]) % 2 == 0] if len(at) else at
            symbols[at] = self.result[ranks[at]]
            stay = ~np.repeat(done, lengths)
            stay[at + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        if len(symbols):
            out[owner] = 1
        return out


class Counter:
    """Counts texts batch by batch; lives in one Python worker."""

    def __init__(self, merges: MergeTable):
        import regex
        self.merges, self.memo = merges, {}
        self.split = regex.compile(SPLIT).findall
        self.added = regex.compile("|".join(map(regex.escape, merges.added))) if merges.added else None

    def pieces(self, text: str) -> tuple[list[str], int]:
        if self.added is None or not self.added.search(text):
            return self.split(text), 0
        parts = self.added.split(text)
        return [p for part in parts for p in self.split(part)], len(parts) - 1

    def run(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        new = list({p for ps, _ in cut for p in ps if p not in self.memo})
        if len(self.memo) + len(new) > MEMO:
            self.memo = {}
            new = list({p for ps, _ in cut for p in ps})
        if new:
            self.memo.update(zip(new, self.merges.count([p.encode() for p in new]).tolist()))
        memo = self.memo
        return [sum(map(memo.__getitem__, ps)) + extra for ps, extra in cut]

    def count(self, texts: list[str]) -> list[int]:
        out, run, chars = [], [], 0
        for t in texts:
            run.append(t)
            chars += len(t)
            if chars >= RUN_CHARS:
                out += self.run(run)
                run, chars = [], 0
        return out + self.run(run)


def token_counter(spark: SparkSession, tokenizer_file: str):
    """A column function text -> number of tokens (long) for a byte-level BPE file."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(MergeTable(json.load(f)))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(shared.value)
        for texts in batches:
            yield pd.Series(counter.count(["" if t is None else t for t in texts.tolist()]), dtype="int64")

    def counted(text: Column) -> Column:
        return n_tokens(F.coalesce(text, F.lit("")))

    return counted
