"""Words of a batch of texts and their 64-bit names, in numpy.

A word is a maximal run of bytes outside space and TAB..CR.  All separators are
single ASCII bytes, so words can be found and hashed on UTF-8 without decoding.
A word's name depends on its bytes alone: equal words get equal names in every
task, which lets later joins meet on names without a dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_GOLD = U64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class _Lane:
    """One independent polynomial hash over the bytes of a word."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.of_byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = U64(int(rng.integers(1 << 62, 1 << 63)) | 1)
        self.powers = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.powers):
            n = max(n, 64)
            grown = np.full(n, self.base, dtype=np.uint64)
            grown[0] = 1
            self.powers = np.multiply.accumulate(grown)
        return self.powers


_LANES = (_Lane(11), _Lane(12))


class Words:
    """The words of some texts: byte spans, names, and each text's range of words."""

    def __init__(self, texts: list[bytes], lower: bool = False, lanes: int = 1):
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.buffer = buf = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        begins = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=begins[1:])
        inside = np.zeros(len(buf) + 2, dtype=np.int8)
        inside[1:-1] = ~_SEPARATOR[buf]
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.start, begins)
        self.counts = np.diff(self.first)
        length = self.end - self.start
        if lower:
            buf = _LOWER[buf]
        body = buf[inside[1:-1].astype(bool)]
        at = np.zeros(len(length), dtype=np.int64)
        if len(length):
            np.cumsum(length[:-1], out=at[1:])
        within = np.arange(len(body), dtype=np.int64) - np.repeat(at, length)
        longest = int(length.max()) if len(length) else 1
        self.names = []
        for lane in _LANES[:lanes]:
            value = lane.of_byte[body] * lane.upto(longest)[within]
            total = np.add.reduceat(value, at) if len(at) else np.zeros(0, dtype=np.uint64)
            self.names.append(mix(total + length.astype(np.uint64) * _GOLD))

    def owner(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(names: np.ndarray, k: int) -> np.ndarray:
    """Name of the k words that start at each word (runs past the end wrap; callers mask)."""
    out = np.full(len(names), U64(0x9E3779B97F4A7C15 * k % (1 << 64)), dtype=np.uint64)
    for j in range(k):
        out = mix(out * _GOLD + np.roll(names, -j))
    return out


def chunks(ids: list, texts: list[bytes], limit: int = 1 << 21) -> Iterator[tuple[list, list[bytes]]]:
    """Consecutive rows of about ``limit`` bytes, so numpy's temporaries stay small."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield ids[start:i], texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield ids[start:], texts[start:]


def rows(batch: pa.RecordBatch, limit: int = 1 << 21) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, UTF-8 texts) of a batch with the columns id and text, null texts as empty."""
    ids = batch.column(0).to_pylist()
    column = batch.column(1)
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    yield from chunks(ids, [b or b"" for b in raw.to_pylist()], limit)
