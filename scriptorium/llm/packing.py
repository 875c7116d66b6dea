"""Operator 3: best-fit packing by exact-complement hashing.

Documents become token sequences, long ones are cut into pieces, and pieces go into
sequences of a fixed capacity.  The plan depends on lengths only, and there are at
most ``capacity`` of them, so planning works on a histogram: it has ``capacity``
rows at any input size and is the one thing that reaches the driver.

1. Index sums of available lengths: a gap that one, a pair or a triple fills exactly is
   closed by that combination, as often as the counts allow.  Pairs are indexed by their
   sum, a triple is a length and an indexed pair.
2. What is left goes best-fit decreasing, again for whole length classes at a time.
   Three plans are made from the histogram; the one of fewest sequences counts.

Every step uses up a length class or leaves less than one more use of it, which
bounds the number of distinct fillings, and so the broadcast table, by a multiple
of ``capacity``.  Pieces then take their places by rank: the r-th piece of a length
goes to the r-th place that the plan has for it.  Ranks come from counts by
(length, bucket), so no task holds all pieces of a frequent length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.byte_bpe import load_ranks
from scriptorium.plans.scratch import Scratch

CAPACITY = 1024
#: Pieces of one length that a bucket has about; ranks are given within a bucket.
BUCKET_ROWS, MIN_BUCKETS = 1 << 16, 32
#: Of several white-space characters before a word the last one goes with it; texts are cut before it.
_CUT = r"(?<=\p{White_Space})(?=\p{White_Space}\P{White_Space})"
_PATTERN_PLAIN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


@lru_cache(maxsize=2)
def _full(json_path: str):
    from tokenizers import Tokenizer  # loaded by workers that need it only

    out = Tokenizer.from_file(json_path)
    out.no_padding()
    out.no_truncation()
    return out


@lru_cache(maxsize=2)
def _quick(ranks_path: str) -> tiktoken.Encoding:
    """The same vocabulary as ranks, with a pattern that has no lookahead.

    It splits alike where no two white-space characters meet; ``_CUT`` takes care of where they do.
    """
    return tiktoken.Encoding("quick", pat_str=_PATTERN_PLAIN, mergeable_ranks=load_ranks(ranks_path), special_tokens={})


@lru_cache(maxsize=2)
def _special(json_path: str) -> tuple[str, ...]:
    """Strings that the full tokenizer takes for one token."""
    with open(json_path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", []))


def _encoder(json_path: str, ranks_path: str | None):
    cut = regex.compile(_CUT)
    special = _special(json_path)
    quick = _quick(ranks_path) if ranks_path else None

    def encode(text: str) -> list[int]:
        # The full tokenizer takes most of a worker's memory; only texts that hold a special token's string need it.
        if quick is None or any(s in text for s in special):
            return _full(json_path).encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        at = 0
        for found in cut.finditer(text):
            ids += quick.encode_ordinary(text[at : found.start()])
            at = found.start()
        ids += quick.encode_ordinary(text[at:])
        return ids

    return encode


def tokenized_pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each row's ids and ``end_id``, cut where longer than ``capacity``.

    Later pieces are full; the first one may be shorter.  A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(json_path, ranks_path)
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                n = len(ids)
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for k in range(len(cuts) - 1):
                    owner.append(i)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(cuts[k + 1] - cuts[k])
                    crc.append(zlib.crc32(ids[cuts[k] : cuts[k + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


class _Sums:
    """Lengths in use with their counts, and an index from a sum to the pair of lengths that makes it.

    Pairs are indexed once, by sum; counts decide at look-up whether a pair is there still.
    A sum of three is a length and an indexed pair for what it leaves.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.counts = Counter({int(k): int(v) for k, v in histogram.items() if v})
        self.lengths = sorted(self.counts)
        self._pairs: dict[int, list[int]] = defaultdict(list)
        for i, short in enumerate(self.lengths):
            for long in self.lengths[i:]:
                if short + long > capacity:
                    break
                # Of a pair the longer length; the most uneven pair comes first.
                self._pairs[short + long].append(long)

    def take(self, length: int, times: int) -> None:
        self.counts[length] -= times
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)

    def has(self, *some: int) -> bool:
        return all(self.counts[x] >= some.count(x) for x in some)

    def pair(self, total: int, most: int, besides: tuple[int, ...] = ()) -> tuple[int, int] | None:
        """Two lengths of sum ``total`` that are there beside others, none longer than ``most``."""
        for a in self._pairs.get(total, ()):
            if a <= most and self.has(a, total - a, *besides):
                return a, total - a
        return None

    def closing(self, gap: int, besides: tuple[int, ...] = (), parts: int = 3) -> tuple[int, ...] | None:
        """Up to ``parts`` lengths that fill ``gap`` exactly beside others in use: the fewest, the longest first."""
        if self.has(gap, *besides):
            return (gap,)
        if parts > 1 and (found := self.pair(gap, gap, besides)):
            return found
        if parts > 2:
            for a in reversed(self.lengths[: bisect_right(self.lengths, gap)]):
                if 3 * a < gap:
                    break
                if self.has(a, *besides) and (found := self.pair(gap - a, a, (a, *besides))):
                    return (a, *found)
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) that use every piece once.

    Exact complements for all pieces waste no room, but may use up the short pieces that long
    ones without a complement would have taken.  So there are three plans: complements of any
    lengths, complements of which those of several lengths use no short ones (``reserve``), and
    best fit alone.  The plan of fewest sequences counts, of equals the first.
    """
    modes = [(3, 0), (3, capacity // 4), (0, 0)]
    plans = (_planned(histogram, capacity, *mode) for mode in modes)
    return min(plans, key=lambda p: sum(times for _, times in p))


def _planned(histogram: dict[int, int], capacity: int, parts: int, reserve: int) -> list[tuple[tuple[int, ...], int]]:
    """parts: lengths of a complement, at most; none without.

    reserve: complements of several lengths use none below it; short pieces are left to fill what nothing closes.
    """
    sums = _Sums(histogram, capacity)
    counts, lengths = sums.counts, sums.lengths
    if counts and (min(counts) < 1 or max(counts) > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    fillings: list[tuple[tuple[int, ...], int]] = []

    def use(filling: tuple[int, ...]) -> None:
        need = Counter(filling)
        times = min(counts[k] // v for k, v in need.items())
        for k, v in need.items():
            sums.take(k, v * times)
        fillings.append((filling, times))

    def residual() -> None:
        """The longest piece with the longest that fit; once the sums close the rest exactly, they do."""
        filling, room = (), capacity
        while room:
            closing = sums.closing(room, filling, parts) if parts and filling else None
            if closing and (len(closing) == 1 or min(closing) >= reserve):
                filling += closing
                break
            fit = next((x for x in reversed(lengths[: bisect_right(lengths, room)]) if sums.has(x, *filling)), None)
            if fit is None:
                break
            filling += (fit,)
            room -= fit
        use(filling)

    if counts[capacity]:
        use((capacity,))
    # Exact complements, longest pieces first: they have the fewest partners.
    for length in sorted(counts, reverse=True) if parts else ():
        while counts[length]:
            found = sums.closing(capacity - length, (length,), parts)
            if found and (len(found) == 1 or min(found) >= reserve):
                use((length, *found))
            else:
                residual()
    while lengths:
        residual()
    return fillings


def _places(fillings: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) of each place in the fillings."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for filling, times in fillings:
        offset = 0
        for length in filling:
            rows.append((length, taken[length], times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with sequence_id and offset; pieces must be a stored table, as it is read four times.

    Rows that tie in all columns may swap places; each still gets its own.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # As many buckets as keep the most frequent length's small; ``capacity`` rows decide it.
    buckets = max(MIN_BUCKETS, -(-max(histogram.values(), default=0) // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).cast("int")
    by_bucket = pieces.withColumn("bucket", bucket)
    counted = by_bucket.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    places = spark.createDataFrame(
        _places(plan(histogram, capacity)) or [(0, 0, 0, 0, 0)],
        "length long, low long, many long, first_sequence long, offset long",
    )
    # Dealt by the window's keys, so the join adds no exchange of the pieces.
    before = counted.select(
        "length", "bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"),
    )
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "start", "ids_crc32"))
    ranked = (
        by_bucket.withColumn("inside", inside)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("inside") - 1)
    )
    # A length's places are intervals of ranks in order; their starts are searched by bisection.
    table = (
        places.groupBy("length")
        .agg(F.array_sort(F.collect_list(F.struct("low", "many", "first_sequence", "offset"))).alias("places"))
    )
    placed = ranked.join(F.broadcast(table), "length").withColumn(
        "place",
        F.expr("element_at(filter(places, p -> p.low <= rank), -1)"),
    )
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("place.first_sequence") + F.col("rank") - F.col("place.low")).alias("sequence_id"),
        F.col("place.offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack; texts are tokenized once and only lengths and digests are kept.

    Null and empty texts are the end id alone.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(tokenized_pieces(docs, json_path, ranks_path, end_id, capacity, id_col, text_col), "pieces")
    return pack(pieces, capacity, id_col)
