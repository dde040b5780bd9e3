"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the vocabulary says (a space in front, spaces as
U+2581). Its symbols start as single characters; an agenda holds every
adjacent pair that is a piece, best score first and leftmost at ties. The top
pair is merged and its two new neighbours enter the agenda, until it is empty.
Characters outside the vocabulary become byte pieces. A long segment's agenda
is a heap; the agendas of a batch's short segments are arrays, and every
segment takes the top of its own in the same step.

No piece of such a vocabulary has another character before U+2581 (looked up
when it is loaded), so no merge crosses that border and a text may be cut
there. Segments that were met before come from a bounded memo; a vocabulary
with such a piece is encoded in whole texts.

Every Arrow batch is checked against the sentencepiece library (a column
``agrees`` per row): ``check`` "segments" encodes each new segment with the
library and compares the ids, "texts" all whole texts, "" nothing.

Runs inside the scan tasks without a shuffle; the vocabulary is broadcast (its
size is the file's). Arrow batches are worked off in runs of ``RUN_CHARS``.

Defined cases: null and empty texts have no ids and decode to the empty text; very long
texts and segments are encoded whole (the agenda is a heap); repeated rows
are encoded each; further columns are carried through; an empty table gives an
empty result. ``decode`` takes any ids of the vocabulary: control ids give
nothing, bytes that are no UTF-8 give U+FFFD each; null ids give null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import release

#: Fixed value: the library's stand-in for a space.
SPACE = "▁"
RUN_CHARS = 1_000_000
MEMO_IDS = 2_000_000
#: Segments up to this length are merged together, round by round; longer ones by a heap each.
SHORT = 48
#: Above every rank, and above every place in an array of agendas (their product fits a long).
NEVER = np.int64(1 << 30)
PLACES = np.int64(1 << 32)
ENCODED = "struct<ids:array<int>,agrees:boolean>"
ROUND_TRIP = "struct<ids:array<int>,agrees:boolean,decoded:string>"


def merge_vocabulary(model: bytes) -> None:
    """Raises ValueError unless the file is a merge-type vocabulary that this
    module encodes as the library does."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    proto.ParseFromString(model)
    kinds = pb.ModelProto.SentencePiece
    norm, made = proto.normalizer_spec, proto.trainer_spec
    plain = (made.model_type == pb.TrainerSpec.BPE and made.byte_fallback and norm.add_dummy_prefix
             and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
             and not made.treat_whitespace_as_suffix and not proto.denormalizer_spec.precompiled_charsmap)
    if not plain or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
        raise ValueError("only BPE vocabularies with byte pieces, a space in front and no text normalisation are supported")


class PieceCoder:
    """Encodes and decodes batch by batch; lives in one Python worker."""

    def __init__(self, model: bytes, check: str = "texts"):
        import sentencepiece
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.check = check
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        self.byte = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        silent = np.array([sp.is_control(i) for i in range(size)])
        self.ids = {names[i]: i for i in range(size) if not (sp.is_byte(i) or silent[i] or sp.is_unknown(i))}
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.segments = re.compile(f"{SPACE}+[^{SPACE}]*" if self.cuts else "(?s).+").findall
        # surface bytes of every id, end to end
        value = {i: bytes([b]) for b, i in self.byte.items()}
        unknown = " ⁇ ".encode()
        self.surface = [value.get(i) or (b"" if silent[i] else unknown if sp.is_unknown(i) else
                                         names[i].replace(SPACE, " ").encode()) for i in range(size)]
        self.is_byte = np.zeros(size, dtype=bool)
        self.is_byte[list(self.byte.values())] = True
        self.silent = silent
        self._symbols(size)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.odd: set[int] = set()  # segments that the library encodes differently

    def _symbols(self, size: int) -> None:
        """Symbols are the ids of pieces; other characters are ``size`` + code
        point. Every split of a piece into two symbols is a pair."""
        self.size, self.base = size, size + 0x110000
        self.single = np.arange(size, self.base)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i

        def symbol(s: str) -> int | None:
            return self.ids.get(s, size + ord(s) if len(s) == 1 else None)
        pairs = [(a, b, i, -self.library.get_score(i)) for p, i in self.ids.items() for k in range(1, len(p))
                 if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None]
        left, right, made = (np.array([x[k] for x in pairs], dtype=np.int64) for k in range(3))
        keys = left * self.base + right
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]
        # equal scores share a rank: the leftmost pair goes first then
        self.ranks = np.unique([x[3] for x in pairs], return_inverse=True)[1].astype(np.int64)[order]
        self.pairs: dict[int, tuple[int, int]] | None = None  # the same as a dictionary, made when a heap needs it

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair (rank ``NEVER`` for no piece)."""
        if not len(self.keys):
            return np.full(len(left), NEVER), np.zeros(len(left), np.int64)
        want = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NEVER), self.made[at]

    def merged(self, segment: str) -> list[int]:
        """Symbols of one segment; the agenda is a heap."""
        symbols = self.single[np.frombuffer(segment.encode("utf-32-le"), np.uint32)]
        n = len(symbols)
        ranks, made = self._pair(symbols[:-1], symbols[1:])
        agenda = [(r, i) for i, r in enumerate(ranks.tolist()) if r != NEVER]
        symbols = symbols.tolist()
        now = {i: (r, p) for i, (r, p) in enumerate(zip(ranks.tolist(), made.tolist())) if r != NEVER}
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        pairs, base = self.pairs, self.base

        def enter(left: int, right: int) -> None:
            found = pairs.get(symbols[left] * base + symbols[right])
            if found is None:
                now.pop(left, None)
            else:
                now[left] = found
                heappush(agenda, (found[0], left))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(agenda)
        while agenda:
            rank, left = heappop(agenda)
            if now.get(left, (NEVER,))[0] != rank:
                continue  # one of the two has changed since
            symbols[left], right = now.pop(left)[1], after[left]
            symbols[right] = -1
            now.pop(right, None)
            after[left] = far = after[right]
            if far < n:
                before[far] = left
                enter(left, far)
            if before[left] >= 0:
                enter(before[left], left)
        return [s for s in symbols if s >= 0]

    def merged_many(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of short segments end to end, and how many each has. The
        agendas of all segments are one array (a pair's rank and place, in
        place order); in every round each segment takes the top of its own."""
        counts = np.fromiter(map(len, segments), np.int64, len(segments))
        symbols = self.single[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(segments)), counts)
        ranks, made = np.full(len(symbols), NEVER), np.zeros(len(symbols), np.int64)
        fresh_pairs = np.flatnonzero(owner[1:] == owner[:-1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            ranks[fresh_pairs], made[fresh_pairs] = self._pair(symbols[fresh_pairs], symbols[fresh_pairs + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            top = np.minimum.reduceat(ranks * PLACES + np.arange(len(ranks)), starts)
            over = top >= NEVER * PLACES
            lengths = np.diff(np.r_[starts, len(symbols)])
            stay = ~np.repeat(over, lengths)
            done.append((owner[~stay], symbols[~stay]))
            at = top[~over] % PLACES
            symbols[at] = made[at]
            ranks[at] = NEVER  # renewed below, unless the segment ends here
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            at = place[at]
            symbols, owner, ranks, made = symbols[stay], owner[stay], ranks[stay], made[stay]
            near = np.r_[at, at - 1]
            near = near[(near >= 0) & (near + 1 < len(symbols))]
            fresh_pairs = near[owner[near] == owner[near + 1]]
        owners, flat = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(2))
        order = np.argsort(owners, kind="stable")
        return flat[order], np.bincount(owners, minlength=len(segments))

    def _ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments end to end, and how many each has."""
        short = [k for k, s in enumerate(segments) if len(s) <= SHORT]
        flat, counts = self.merged_many([segments[k] for k in short])
        if len(short) < len(segments):
            parts = dict(zip(short, np.split(flat, np.cumsum(counts)[:-1])))
            parts |= {k: np.array(self.merged(s), dtype=np.int64) for k, s in enumerate(segments) if len(s) > SHORT}
            ordered = [parts[k] for k in range(len(segments))]
            flat, counts = np.concatenate(ordered), np.fromiter(map(len, ordered), np.int64, len(ordered))
        foreign = np.flatnonzero(flat >= self.size)
        if len(foreign):  # characters outside the vocabulary become byte pieces
            spelled = [[self.byte[b] for b in chr(c).encode()] for c in (flat[foreign] - self.size).tolist()]
            width = np.ones(len(flat), np.int64)
            width[foreign] = list(map(len, spelled))
            owner = np.repeat(np.arange(len(counts)), counts)
            counts = np.bincount(owner, weights=width, minlength=len(counts)).astype(np.int64)
            out = np.repeat(flat, width)
            ends = np.cumsum(width)
            for k, ids in zip(foreign.tolist(), spelled):
                out[ends[k] - len(ids):ends[k]] = ids
            flat = out
        return flat.astype(np.int32), counts

    def _learn(self, segments: list[str]) -> None:
        """Put new segments in the memo."""
        flat, lengths = self._ids(segments)
        first = len(self.memo)
        if self.check == "segments":
            theirs = self.library.encode([s.removeprefix(SPACE) for s in segments], num_threads=1)
            counts = np.fromiter(map(len, theirs), np.int64, len(theirs))
            same_size = np.repeat(lengths == counts, counts)
            wrong = np.flatnonzero(lengths != counts)
            there = np.fromiter((i for ids in theirs for i in ids), np.int32, int(counts.sum()))[same_size]
            here = flat[np.repeat(lengths == counts, lengths)]
            owner = np.repeat(np.arange(len(counts)), counts)[same_size]
            for k in {*wrong.tolist(), *owner[here != there].tolist()}:
                if segments[k] != SPACE:  # the library gives an empty text no ids
                    self.odd.add(first + k)
        self.memo.update(zip(segments, range(first, first + len(segments))))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lengths) - lengths]
        self.lengths = np.r_[self.lengths, lengths]
        self.flat = np.r_[self.flat, flat]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, ids per text, whether the check agreed."""
        cut = [self.segments((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        flat_segments = [s for ss in cut for s in ss]
        new = list(set(flat_segments) - self.memo.keys())
        if new and len(self.flat) + sum(map(len, new)) > MEMO_IDS:
            self._forget()
            new = list(set(flat_segments))
        if new:
            self._learn(new)
        which = np.fromiter(map(self.memo.__getitem__, flat_segments), np.int64, len(flat_segments))
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[which] - ends + lengths, lengths) + np.arange(total)]
        last = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        bounds = np.r_[0, ends][np.r_[0, last]]
        return ids, np.diff(bounds), self._agreement(texts, ids, bounds, which, last)

    def _agreement(self, texts: list[str], ids: np.ndarray, bounds: np.ndarray, which: np.ndarray,
                   last: np.ndarray) -> np.ndarray:
        agrees = np.ones(len(texts), dtype=bool)
        if self.check == "texts":
            theirs = self.library.encode(texts, num_threads=1)
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                agrees[k] = len(theirs[k]) == b - a and ids[a:b].tolist() == theirs[k]
        elif self.odd:
            first = np.r_[0, last[:-1]]
            for at in np.flatnonzero(np.isin(which, list(self.odd))):
                agrees[np.searchsorted(first, at, side="right") - 1] = False
        return agrees

    def decode(self, ids: np.ndarray) -> str:
        """Text of a sequence of ids."""
        pieces = list(map(self.surface.__getitem__, ids.tolist()))
        try:
            text = b"".join(pieces).decode() if not self.silent[ids].any() else None
        except UnicodeDecodeError:
            text = None
        if text is None:  # runs of byte pieces by themselves: they may be no UTF-8
            text, at = "", 0
            single = self.is_byte[ids]
            edges = np.flatnonzero(np.diff(single)) + 1
            for end in [*edges.tolist(), len(ids)]:
                run = b"".join(pieces[at:end])
                text += _bytes_text(run) if single[at] else run.decode()
                at = end
        # the space that encoding puts in front goes again (a space byte stays)
        return text[1:] if text.startswith(" ") and self._leads(ids) else text

    def _leads(self, ids: np.ndarray) -> bool:
        """Whether the first id that gives text is a piece with the space in front."""
        head = next((i for i in ids.tolist() if self.surface[i]), -1)
        return head >= 0 and not self.is_byte[head] and not self.library.is_unknown(head)


def _bytes_text(run: bytes) -> str:
    """UTF-8 characters of a run of byte pieces; U+FFFD for every other byte."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at:at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def runs(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Consecutive runs of about ``chars`` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


@lru_cache(maxsize=2)
def coder(model: bytes, check: str) -> PieceCoder:
    """The coder of this Python worker, which lives on between tasks."""
    return PieceCoder(model, check)


class SentencePieces:
    """Column functions of one vocabulary file, which is read on the driver."""

    def __init__(self, spark: SparkSession, model_file: str, check: str = "segments"):
        if check not in ("texts", "segments", ""):
            raise ValueError('check is "texts", "segments" or ""')
        with open(model_file, "rb") as f:
            model = f.read()
        merge_vocabulary(model)
        shared = spark.sparkContext.broadcast(model)

        def coded(batches: Iterator[pa.Array], back: bool) -> Iterator[pa.Array]:
            own = coder(shared.value, check)
            for batch in batches:
                ids, counts, agrees, texts = [], [], [], []
                for run in runs(batch.to_pylist(), RUN_CHARS):
                    a, b, c = own.encode(run)
                    ids.append(a)
                    counts.append(b)
                    agrees.append(c)
                    if back:
                        ends = np.cumsum(b)
                        texts.append(pa.array([own.decode(a[x:y]) for x, y in zip(ends - b, ends)], pa.string()))
                offsets = np.cumsum(np.concatenate([[0], *counts])).astype(np.int32)
                columns = {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))),
                           "agrees": pa.array(np.concatenate([np.zeros(0, bool), *agrees]))}
                if back:
                    columns["decoded"] = pa.chunked_array(texts, pa.string()).combine_chunks()
                yield pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
                del ids, columns, texts
                release()

        @F.arrow_udf(ENCODED)
        def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from coded(batches, False)

        @F.arrow_udf(ROUND_TRIP)
        def round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from coded(batches, True)

        @F.arrow_udf("string")
        def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = coder(shared.value, check)
            for batch in batches:
                bounds, flat = batch.offsets.to_numpy(), batch.values.to_numpy(zero_copy_only=False)
                valid = batch.is_valid().to_pylist()
                yield pa.array([own.decode(flat[a:b]) if ok else None
                                for a, b, ok in zip(bounds[:-1], bounds[1:], valid)], pa.string())

        self._encoded, self._decoded, self._round_trip = encoded, decoded, round_trip

    def encode(self, text: Column) -> Column:
        """Text -> struct of ``ids`` and ``agrees`` (with the library; true without a check)."""
        return self._encoded(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        """Array of ids -> text."""
        return self._decoded(ids.cast("array<int>"))

    def round_trip(self, text: Column) -> Column:
        """Text -> struct of ``ids``, ``agrees`` and ``decoded``, the text of those ids."""
        return self._round_trip(F.coalesce(text, F.lit("")))
