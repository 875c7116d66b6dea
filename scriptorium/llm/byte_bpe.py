"""Operator 1: byte-level BPE by monoid tree reduction.

A text is halved until a piece is small, the pieces are encoded on their own, and
neighbours are joined on the way up.  A join re-encodes only a window around the
seam, and the window grows until what lies outside provably cannot change:

* Pre-tokens.  The pattern scans left to right without looking back, so two scans
  that both stop at one place agree from there on.  Left of the seam a match is
  final once it ends before the seam and three characters of it, at least, were
  visible (the longest contraction).  Right of the seam the window ends where a
  scan from the left meets a boundary of the right part's own scan.
* Tokens inside one long pre-token.  A token sequence is the encoding of its bytes
  if and only if each adjacent pair is; this holds as every rank is reachable by
  merges (``check_ranks`` sees to that before a job starts).  The window grows until its
  two outer pairs hold.

Pre-tokens recur, so the ids of short ones are remembered in a worker.

The empty sequence is neutral and joining is associative, so the same reduction
could run over parts held by different tasks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf of the tree over a text; bytes of a leaf of the tree over a pre-token.
LEAF, PIECE = 512, 32
#: Characters up to which a pre-token's ids are remembered.
KNOWN = 64
#: Characters of the longest contraction.
_CONTRACTION = 3


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: No merge; bits of an id in the key of a pair of ids.
_NONE, _BITS = 1 << 60, 32


class Run:
    """An encoded stretch of text: its pre-tokens and the ids of each."""

    __slots__ = ("pieces", "ids")

    def __init__(self, pieces: list[str], ids: list[tuple[int, ...]]):
        self.pieces, self.ids = pieces, ids


class _Memo(dict):
    """Ids of pre-tokens seen before, in two generations, so that its size is bounded and frequent ones stay.

    A full generation becomes the older one, which is asked before a pre-token is
    encoded anew and is dropped when the next one is full.
    """

    def __init__(self, encode, most: int = 1 << 17):
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(piece) > KNOWN:
            return tuple(self.encode(piece.encode()))
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.encode(piece.encode()))
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Coder:
    """Encoder and decoder for one rank file and pattern.

    leaf: characters up to which a text is encoded without halving it.
    piece: bytes up to which a pre-token is merged without halving it.
    joins: joins of two runs so far, which shows what the tree did.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, piece: int = PIECE):
        self.ranks = ranks
        self.leaf, self.piece = max(leaf, 2), max(piece, 2)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte = [ranks.get(bytes([i]), _NONE) for i in range(256)]
        # What two neighbouring tokens merge to, for each split of a token into two.
        self.merged = {
            left << _BITS | right: token
            for b, token in ranks.items()
            for i in range(1, len(b))
            if (left := ranks.get(b[:i])) is not None and (right := ranks.get(b[i:])) is not None
        }
        self.scan = regex.compile(pattern)
        self.known = _Memo(self.encode_piece)
        self.joins = 0
        self._pair = lru_cache(maxsize=1 << 16)(self._pair_holds)

    def every_rank_reachable(self) -> bool:
        """Whether merging turns the bytes of each rank into that one token; what is proved above rests on it."""
        return all(len(self._merge(b)) == 1 for b in self.ranks)

    # One pre-token.
    def _merge(self, piece: bytes) -> list[int]:
        """Ids of a short stretch of bytes: always the pair of lowest rank next, the first of equals."""
        if len(piece) > 128:
            return self._merge_long(piece)
        merged = self.merged.get
        ids = [self.byte[b] for b in piece]
        pairs = [merged(a << _BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) < _NONE:
            i = pairs.index(best)
            ids[i] = best
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = merged(best << _BITS | ids[i + 1], _NONE)
            if i:
                pairs[i - 1] = merged(ids[i - 1] << _BITS | best, _NONE)
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap of pairs, for windows that had to grow."""
        rank, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 for places inside a part
        before = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(piece[i : i + 2], _NONE)) < _NONE]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            middle = end[i]
            if not middle or middle >= n or rank(piece[i : end[middle]], _NONE) != r:
                continue
            stop = end[i] = end[middle]
            end[middle] = 0
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]], _NONE)) < _NONE:
                    heappush(heap, (r, i))
            if i and (r := rank(piece[before[i] : stop], _NONE)) < _NONE:
                heappush(heap, (r, before[i]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _pair_holds(self, a: int, b: int) -> bool:
        return self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings side by side."""
        if not left or not right:
            return left or right
        reach = 0
        while True:
            lo, hi = max(0, len(left) - reach), min(len(right), reach)
            window = left[lo:] + right[:hi]
            if reach:
                window = self._merge(b"".join(self.bytes_of[t] for t in window))
            outer = [*left[lo - 1 : lo], *window, *right[hi : hi + 1]] if lo else [*window, *right[hi : hi + 1]]
            sure_left = not lo or self._pair(outer[0], outer[1])
            sure_right = hi == len(right) or self._pair(outer[-2], outer[-1])
            if sure_left and sure_right:
                return left[:lo] + window + right[hi:]
            reach = 2 * reach or 1

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(piece) <= self.piece:
            whole = self.ranks.get(piece)
            return self._merge(piece) if whole is None else [whole]
        half = len(piece) // 2
        return self.join_tokens(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    # Whole texts.
    def _leaf(self, text: str) -> Run:
        pieces = self.scan.findall(text)
        return Run(pieces, list(map(self.known.__getitem__, pieces)))

    def join(self, left: Run, right: Run) -> Run:
        """Monoid operation on runs: the run of both texts side by side."""
        if not left.pieces or not right.pieces:
            return left if left.pieces else right
        self.joins += 1
        # A match of the left part stays if it ends before the seam and a whole contraction was visible.
        keep, tail = len(left.pieces) - 1, len(left.pieces[-1])
        while keep and len(left.pieces[keep - 1]) + tail < _CONTRACTION:
            keep -= 1
            tail += len(left.pieces[keep])
        before = "".join(left.pieces[keep:])
        reach = 1
        while True:
            # The window grows to the right until a match that stays ends where one of the right part does.
            text = before + "".join(right.pieces[:reach])
            whole = reach >= len(right.pieces)
            fresh, at, start, stop, taken = [], 0, 0, len(before), 0
            for piece in self.scan.findall(text):
                start, at = at, at + len(piece)
                if not whole and (at == len(text) or start + _CONTRACTION > len(text)):
                    break
                fresh.append(piece)
                while stop < at:
                    stop += len(right.pieces[taken])
                    taken += 1
                if stop == at:
                    ids = self._seam(fresh, left.pieces[keep:] + right.pieces[:taken], left.ids[keep:] + right.ids[:taken])
                    return Run(left.pieces[:keep] + fresh + right.pieces[taken:], left.ids[:keep] + ids + right.ids[taken:])
            reach *= 2

    def _seam(self, fresh: list[str], pieces: list[str], ids: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        """Ids of the fresh pre-tokens, which cover the old pieces; a long one is joined from those that make it up."""
        if max(map(len, fresh)) <= KNOWN:
            return list(map(self.known.__getitem__, fresh))
        begins = dict(zip(accumulate(map(len, pieces), initial=0), range(len(pieces) + 1)))
        out, at = [], 0
        for piece in fresh:
            first, at = at, at + len(piece)
            if len(piece) <= KNOWN or first not in begins or at not in begins:
                out.append(self.known[piece])
            else:
                out.append(tuple(reduce(self.join_tokens, map(list, ids[begins[first] : begins[at]]))))
        return out

    def tree(self, text: str) -> Run:
        if len(text) <= self.leaf:
            return self._leaf(text)
        # Any place will do; before a space, the words at the seam are whole and so known.
        half = len(text) // 2
        blank = text.rfind(" ", half - half // 4, half)
        half = blank if blank > 0 else half
        return self.join(self.tree(text[:half]), self.tree(text[half:]))

    def encode(self, text: str) -> list[int]:
        """Ids of a text, by its tree."""
        return list(chain.from_iterable(self.tree(text).ids))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up a tree."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> Coder:
    """One coder for each Python worker."""
    return Coder(load_ranks(path), pattern)


@lru_cache(maxsize=4)
def check_ranks(path: str, pattern: str) -> None:
    """Refuse a rank file that the proof does not hold for; run once, on the driver."""
    if not coder(path, pattern).every_rank_reachable():
        raise ValueError(f"{path}: some rank can't be reached by merges")


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row; a null text has no ids.  One row in, one row out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = pa.array([c.encode(t or "") for t in texts], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    check_ranks(path, pattern)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) of each row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            out = pa.array([c.decode(i or []) for i in batch.column(1).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["id", "decoded"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each row's ids and of the bytes that they decode to.

    Encoding and decoding run in one pass, so ids never leave the worker.  Null and
    empty texts have 0 tokens and the digests of no bytes; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            n, coded, back = [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids))
                coded.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    check_ranks(path, pattern)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
