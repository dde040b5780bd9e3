"""Cross-tokenizer alignment of every distinct text.

Two tokenizers cut the same bytes: A is a byte-level BPE file (tokenizers
library) reading a space and the text, B a sentencepiece model, which adds that
space itself. Byte offsets where a token of A and one of B both end cut the
tokens into groups; the two tokens that end a group are linked.

Exact-text deduplication: the documents are shuffled by their full text (with
partial counts, so copies of a text meet as one row per task), each distinct
text is tokenised and aligned once, and its links count as often as the text
occurs. Measures join back to the documents by the text's SHA-256.

Two tokens that end together are one the other's suffix, so the pairs that can
ever be linked follow from the vocabularies: at most the summed bytes of all
tokens, whatever the corpus (``Vocabularies.pairs``; 10^5 to 10^6). A link is a
number in that list. Corpus counts are summed per task in one array of that
size, then by a shuffle; their broadcast has the same bound.

Tasks hold a run of ``RUN_CHARS`` characters at a time. What comes from the
shuffle is written to the shared folder once.

Defined cases: null and empty texts, and texts whose tokens do not spell the
bytes of space and text (U+2581 in a text, which B reads as a space), have no
tokens: zeros, empty groups; they take no part in the counts. Long texts are
aligned whole; repeated texts, also a third of all rows, are aligned once and
each row gets the measures; null doc_ids stay rows; input columns may have any
names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, quoted, release
from .sentence_pieces import SPACE, runs
from .token_counts import SPLIT, MergeTable, byte_symbols

RUN_CHARS = 1_000_000
MEMO_IDS = 2_000_000
ALIGNED = "text_sha256 string, copies bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, links array<int>"


def _bytes_a(spec: dict) -> list[bytes | None]:
    """Bytes of A's tokens by id; None for added tokens."""
    value = {s: b for b, s in enumerate(byte_symbols())}
    vocab = spec["model"]["vocab"]
    out: list[bytes | None] = [None] * (max(vocab.values()) + 1)
    added = {t["content"] for t in spec.get("added_tokens") or []}
    for token, i in vocab.items():
        if token not in added:
            out[i] = bytes(value[c] for c in token)
    return out


def _bytes_b(sp) -> list[bytes | None]:
    """Bytes of B's pieces by id; None for control pieces and the unknown one."""
    def surface(i: int) -> bytes | None:
        if sp.is_control(i) or sp.is_unknown(i):
            return None
        name = sp.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if sp.is_byte(i) else name.replace(SPACE, " ").encode()
    return [surface(i) for i in range(sp.get_piece_size())]


class PreTokens:
    """Ids of byte-level pre-tokens. No merge crosses a pre-token and each is
    one again when it stands alone, so the library sees only those that a
    bounded memo does not hold."""

    def __init__(self, library):
        import regex
        self.library, self.split = library, regex.compile(SPLIT).findall
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        found = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.memo.update(zip(pieces, range(len(self.memo), len(self.memo) + len(pieces))))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lengths) - lengths]
        self.lengths = np.r_[self.lengths, lengths]
        self.flat = np.r_[self.flat, np.fromiter((i for ids in found for i in ids), np.int64, int(lengths.sum()))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        cut = [self.split(t) for t in texts]
        pieces = [p for ps in cut for p in ps]
        new = list(set(pieces) - self.memo.keys())
        if len(self.flat) + sum(map(len, new)) > MEMO_IDS:
            self._forget()
            new = list(set(pieces))
        if new:
            self._learn(new)
        which = np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[which] - ends + lengths, lengths) + np.arange(int(lengths.sum()))]
        last = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        return ids, np.diff(np.r_[0, ends][np.r_[0, last]])


class Vocabularies:
    """Both tokenizers of one Python worker, and the pairs that can be linked."""

    def __init__(self, tokenizer: bytes, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        import sentencepiece
        from tokenizers import Tokenizer
        spec = json.loads(tokenizer)
        MergeTable(spec)  # refuses all but plain byte-level files
        library = Tokenizer.from_str(tokenizer.decode())
        library.encode_special_tokens = True
        self.a = PreTokens(library)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a, self.bytes_b = _bytes_a(spec), _bytes_b(self.b)
        self.len_a, self.len_b = (np.array([len(t) if t else 0 for t in ts]) for ts in (self.bytes_a, self.bytes_b))
        self.keys = self._linkable()
        # text of an id with what may follow it, all tables end to end: A's "," and "|", B's ",", ";" and end of text
        names_a, names_b = ([str(i) for i in range(len(ts))] for ts in (self.bytes_a, self.bytes_b))
        self.spelled = [n + mark for names, marks in ((names_a, ",|"), (names_b, (",", ";", ""))) for mark in marks for n in names]

    def _linkable(self) -> np.ndarray:
        """Sorted a * (size of B) + b of every pair of which one token ends the other."""
        size = len(self.bytes_b)
        ends: list[dict[bytes, list[int]]] = [{}, {}]
        for known, tokens in zip(ends, (self.bytes_a, self.bytes_b)):
            for i, t in enumerate(tokens):
                if t:
                    known.setdefault(t, []).append(i)
        found = {a * size + b for a, t in enumerate(self.bytes_a) if t for k in range(len(t)) for b in ends[1].get(t[k:], ())}
        found |= {a * size + b for b, t in enumerate(self.bytes_b) if t for k in range(len(t)) for a in ends[0].get(t[k:], ())}
        return np.array(sorted(found), dtype=np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids in A and in B of every pair that can be linked."""
        return np.divmod(self.keys, len(self.bytes_b))

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """Per text: tokens of A, tokens of B, groups, their text, links."""
        want = [(" " + t).encode() if t else b"" for t in texts]
        a, n_a = self.a.encode([" " + t if t else "" for t in texts])
        ids_b = self.b.encode(texts, num_threads=1)
        b = np.fromiter((i for ids in ids_b for i in ids), np.int64, sum(map(len, ids_b)))
        n_b = np.fromiter(map(len, ids_b), np.int64, len(ids_b))
        spelled = np.array([bool(w) for w in want])
        for ids, n, table in ((a, n_a, self.bytes_a), (b, n_b, self.bytes_b)):
            ids, stops = ids.tolist(), np.cumsum(n)
            for k, (x, y) in enumerate(zip((stops - n).tolist(), stops.tolist())):
                spelled[k] = spelled[k] and self._spells(ids[x:y], table, want[k])
        if not spelled.all():  # texts without tokens
            a, b = a[np.repeat(spelled, n_a)], b[np.repeat(spelled, n_b)]
            n_a, n_b = n_a * spelled, n_b * spelled
        # both spell the same bytes, so offsets over the whole run agree
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        at = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[at] == ends_a) if len(b) else np.zeros(0, np.int64)
        last_b = at[last_a]
        links = np.searchsorted(self.keys, a[last_a] * len(self.bytes_b) + b[last_b]).astype(np.int32)
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        bounds = np.r_[0, np.searchsorted(last_a, stop_a)]
        words = self._groups(a, b, last_a, last_b, stop_b[n_b > 0] - 1)
        both = stop_a + stop_b
        return [(int(n_a[k]), int(n_b[k]), int(bounds[k + 1] - bounds[k]), "".join(words[both[k] - n_a[k] - n_b[k]:both[k]]),
                 links[bounds[k]:bounds[k + 1]]) for k in range(len(texts))]

    @staticmethod
    def _spells(ids: list[int], table: list[bytes | None], want: bytes) -> bool:
        try:
            return b"".join(map(table.__getitem__, ids)) == want
        except TypeError:  # a token without bytes
            return False

    def _groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, text_ends: np.ndarray) -> list[str]:
        """The ids as text with their marks, every group's A before its B."""
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 1
        mark_b[text_ends] = 2
        group_a = np.searchsorted(last_a, np.arange(len(a)))
        group_b = np.searchsorted(last_b, np.arange(len(b)))
        out = np.zeros(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.r_[0, last_b + 1][group_a]] = a + mark_a * len(self.bytes_a)
        out[np.arange(len(b)) + np.r_[last_a + 1, 0][group_b]] = b + mark_b * len(self.bytes_b) + 2 * len(self.bytes_a)
        return list(map(self.spelled.__getitem__, out.tolist()))


@lru_cache(maxsize=2)
def vocabularies(tokenizer: bytes, model: bytes) -> Vocabularies:
    """The tokenizers of this Python worker, which lives on between tasks."""
    return Vocabularies(tokenizer, model)


@dataclass
class Alignment:
    """``texts``: one row per distinct text (``text_sha256``, ``copies``, the
    measures); ``pairs``: ``a_id``, ``b_id`` and ``n``, the links of the corpus."""
    texts: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, tokenizer_file: str, model_file: str, text: str = "text", keep_groups: bool = True) -> Alignment:
    """Align both tokenizations of every distinct text. With ``keep_groups``
    the column ``groups`` holds ``a1,a2|b1;a3|b2,b3`` (ids in order), else it is
    left out and only ``groups_sha256`` is stored."""
    spark = docs.sparkSession
    with open(tokenizer_file, "rb") as f, open(model_file, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read()))
    distinct = docs.select(quoted(text).alias("text")).where(F.col("text") != "").groupBy("text") \
        .agg(F.count(F.lit(1)).alias("copies")).select(F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), "copies", "text")
    schema = pa.schema([("text_sha256", pa.string()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                        ("n_groups", pa.int64()), ("groups", pa.string()), ("links", pa.list_(pa.int32()))])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(*shared.value)
        for batch in batches:
            digests, copies, at = batch.column(0), batch.column(1), 0
            for run in runs(batch.column(2).to_pylist(), RUN_CHARS):
                n_a, n_b, n_groups, groups, links = zip(*both.align(run))
                offsets = np.cumsum([0, *n_groups]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [digests.slice(at, len(run)), copies.slice(at, len(run)), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)),
                     pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(links)))], schema=schema)
                at += len(run)
            release()

    rows = distinct.mapInArrow(aligned, ALIGNED)
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.encode("groups", "UTF-8"), 256)).otherwise(F.lit("")).alias("groups_sha256")
    stored, path = materialize(rows.select("text_sha256", "copies", "n_a", "n_b", "n_groups", digest,
                                           *(["groups"] if keep_groups else []), "links"), "aligned")
    counts = _link_counts(stored, shared)
    pairs, best = _corpus(spark, counts, shared)
    known = spark.sparkContext.broadcast((counts, best))

    @F.arrow_udf("struct<n_best:bigint,count_sum:bigint>")
    def corpus_measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts, best = known.value
        for batch in batches:
            ends, at = np.asarray(batch.offsets), np.asarray(batch.values)
            sums = [np.r_[0, np.cumsum(x[at])] for x in (best.astype(np.int64), counts)]
            yield pa.StructArray.from_arrays([pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums], names=["n_best", "count_sum"])

    measured = stored.withColumn("m", corpus_measures("links")).withColumn("n_links", F.size("links").cast("bigint")) \
        .select(*[c for c in stored.columns if c != "links"], "n_links", "m.*")
    texts, _ = materialize(measured, "alignment")
    discard(spark, path)
    return Alignment(texts, pairs)


def _link_counts(stored: DataFrame, shared) -> np.ndarray:
    """Links of the corpus by pair number: summed in one array per task, then by a shuffle."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabularies(*shared.value).keys), np.int64)
        for batch in batches:
            links, copies = batch.column(1), batch.column(0).to_numpy()
            ends = np.asarray(links.offsets)
            at = np.asarray(links.values)[ends[0]:ends[-1]]
            weights = np.repeat(copies, np.diff(ends))
            for n in np.unique(weights):  # few different multiplicities; sums stay whole numbers
                total += n * np.bincount(at[weights == n], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["pair", "n"])

    per_task = stored.select("copies", "links").mapInArrow(summed, "pair bigint, n bigint")
    # at most one row per pair that the vocabularies allow
    rows = per_task.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabularies(*shared.value).keys), np.int64)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out


def _corpus(spark, counts: np.ndarray, shared) -> tuple[DataFrame, np.ndarray]:
    """The linked pairs as a table, and whether a pair's count is the highest of its B id."""
    both = vocabularies(*shared.value)
    a, b = both.pairs()
    highest = np.zeros(len(both.bytes_b), np.int64)
    np.maximum.at(highest, b, counts)
    seen = np.flatnonzero(counts)
    table = pa.table({"a_id": a[seen], "b_id": b[seen], "n": counts[seen]})
    return spark.createDataFrame(table, "a_id bigint, b_id bigint, n bigint"), counts == highest[b]


def align_documents(docs: DataFrame, key: str, tokenizer_file: str, model_file: str, text: str = "text",
                    keep_groups: bool = True) -> DataFrame:
    """The measures of every row of ``docs`` (``key`` and the columns of
    ``Alignment.texts``); rows without tokens have zeros."""
    texts = align(docs, tokenizer_file, model_file, text, keep_groups).texts
    at = fresh("digest")
    rows = docs.select(quoted(key).alias(key), F.sha2(F.encode(quoted(text), "UTF-8"), 256).alias(at))
    whole = rows.join(texts.withColumnRenamed("text_sha256", at), at, "left")
    zero = {"n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"}
    return whole.select(quoted(key), *[F.coalesce(F.col(c), F.lit(0 if c in zero else "")).alias(c) for c in texts.columns
                                       if c in zero or c.startswith("groups")])
