"""Operator 10: repeated passages by recompression.

Rounds rename the words of a text: first short runs of one symbol, then pairs whose
left and right symbol fall into the left and right class.  A new name is a hash of
what it stands for, so it is global without a dictionary, and what is merged depends
on the symbols themselves, so equal passages get equal symbols, up to a margin at
either end that grows with the rounds (``margin``).

A window of w words keeps a zone of w - 2 * margin words in which all documents that
hold it agree.  One symbol of the zone stands for the window: the longest one, ties by
name.  With the margin of words on either side of it, which each such window holds too, it
names a context of half a window.  Neighbouring windows mostly share it, so a text has few
marks: a context, and the stretch of all windows that it stands for there.

Contexts that meet in two documents reveal candidates.  Of these, a stretch that a smaller
document has just as it is, is settled by its 64-bit name and the context's.  What is left
is one stretch of each name, and only where a context has several: their windows are
verified one by one, by 128-bit names of all their words.

A window repeated in another document always has its context there too; nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.components import spread
from scriptorium.llm.wordhash import U64, Words, chunks, mix
from scriptorium.plans.scratch import Scratch

_C = U64(0x9E3779B97F4A7C15)
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def margin(rounds: int) -> int:
    """Words at either end of a passage whose symbols may depend on what is beyond it.

    Round r merges runs of up to 2**(r+1) words and then pairs of such symbols; either
    step can take at most one run or symbol of that length from the end.
    """
    return sum(2 * (2 << r) for r in range(rounds))


def longest(rounds: int) -> int:
    """Words that a symbol stands for, at most."""
    return 2 << rounds if rounds else 1


def rounds_for(window: int) -> int:
    """As many rounds as still leave each window a whole symbol in its zone."""
    rounds = 0
    while window - 2 * margin(rounds + 1) >= 2 * longest(rounds + 1) - 1:
        rounds += 1
    return rounds


def recompress(names: np.ndarray, owner: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, first word, words) after the rounds; symbols don't cross owners."""
    symbol, start = names, np.arange(len(names), dtype=np.int64)
    length = np.ones(len(names), dtype=np.int64)
    for r in range(rounds):
        if len(symbol) < 2:
            break
        cap = 2 << r
        # Runs.
        fresh = np.ones(len(symbol), dtype=bool)
        fresh[1:] = (symbol[1:] != symbol[:-1]) | (owner[start[1:]] != owner[start[:-1]])
        heads = np.flatnonzero(fresh)
        total = np.add.reduceat(length, heads)
        count = np.diff(np.append(heads, len(symbol)))
        merged = (count > 1) & (total <= cap)
        keep = fresh | ~np.repeat(merged, count)
        symbol, length = symbol.copy(), length.copy()
        at = heads[merged]
        symbol[at] = mix(symbol[at] * _C ^ U64(0xA5A5A5A5 + r) ^ (count[merged].astype(np.uint64) << U64(40)))
        length[at] = total[merged]
        symbol, start, length = symbol[keep], start[keep], length[keep]
        if len(symbol) < 2:
            break
        # Pairs.
        right = (mix(symbol ^ U64(0x1234567 * (r + 1))) >> U64(63)).astype(bool)
        joins = ~right[:-1] & right[1:] & (owner[start[1:]] == owner[start[:-1]])
        at = np.flatnonzero(joins)
        keep = np.ones(len(symbol), dtype=bool)
        keep[at + 1] = False
        pair = mix(mix(symbol[at] + U64(r + 1)) * _C + symbol[at + 1])
        symbol, length = symbol.copy(), length.copy()
        length[at] += length[at + 1]
        symbol[at] = pair
        symbol, start, length = symbol[keep], start[keep], length[keep]
    return symbol, start, length


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, context, first and last start of the windows it stands for) for all windows."""
    rounds = rounds_for(window)
    names, owner = words.names[0], words.owner()
    valid = words.counts >= window
    many = np.where(valid, words.counts - window + 1, 0)
    total = int(many.sum())
    empty = np.zeros(0, dtype=np.int64)
    if not total:
        return empty, empty.astype(np.uint64), empty, empty
    symbol, start, length = recompress(names, owner, rounds)
    end = start + length
    text = np.repeat(np.arange(len(many)), many)
    base = np.repeat(np.cumsum(many) - many, many)
    local = np.arange(total, dtype=np.int64) - base
    p = words.first[text] + local
    edge = margin(rounds)
    lo = np.searchsorted(start, p + edge)
    hi = np.searchsorted(end, p + window - edge, side="right")
    # The best symbol of each range by doubling: long symbols first, then small names, then the left one.
    rank = ((longest(rounds) - length).astype(np.uint64) << U64(56)) | (symbol >> U64(8))
    best = [np.arange(len(symbol), dtype=np.int64)]
    width, step = int((hi - lo).max()), 1
    while 2 * step <= width:
        a, b = best[-1][: len(best[-1]) - step], best[-1][step:]
        best.append(np.where(rank[b] < rank[a], b, a))
        step *= 2
    level = np.zeros(total, dtype=np.int64)
    for k in range(1, len(best)):
        level[(hi - lo) >= 1 << k] = k
    chosen = np.empty(total, dtype=np.int64)
    for k in range(len(best)):
        here = level == k
        a, b = best[k][lo[here]], best[k][hi[here] - (1 << k)]
        chosen[here] = np.where(rank[b] < rank[a], b, a)
    change = np.ones(total, dtype=bool)
    change[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(change)
    tails = np.append(heads[1:], total) - 1
    best_at = chosen[heads]
    # Every window it stands for holds the margin around the symbol as well.
    context = stretch_names(names, start[best_at] - edge, end[best_at] + edge)
    return text[heads], mix(symbol[best_at] ^ context), local[heads], local[tails]


def window_names(words: Words, window: int) -> list[np.ndarray]:
    """Two 64-bit names of the window that starts at each word (meaningless past a text's last one)."""
    out = []
    for names, base in zip(words.names, _BASES):
        n = len(names)
        power = np.full(n + 1, U64(base), dtype=np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        back = np.full(n + 1, U64(pow(base, -1, 1 << 64)), dtype=np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(names * power[:n], out=sums[1:])
        upto = np.minimum(np.arange(n) + window, n)
        out.append(mix((sums[upto] - sums[:n]) * back[:n]))
    return out


def stretch_names(names: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of the words begin..end-1, with their number."""
    n, base = len(names), 0xC2B2AE3D27D4EB4F
    power = np.full(n + 1, U64(base), dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(n + 1, U64(pow(base, -1, 1 << 64)), dtype=np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(names * power[:n], out=sums[1:])
    return mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64) * _C)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [b or b"" for b in batch.column("text").cast(pa.binary()).to_pylist()]


def _marks(base: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keys = batch.column("text_key").to_numpy(zero_copy_only=False)
            for rows, texts in chunks(list(range(batch.num_rows)), _texts(batch)):
                words = Words(texts, lanes=2)
                text, context, low, high = anchors(words, window)
                stretch = stretch_names(words.names[1], words.first[text] + low, words.first[text] + high + window)
                row = np.array(rows, dtype=np.int64)[text]
                yield pa.RecordBatch.from_arrays(
                    [_signed(context), _signed(stretch), pa.array(ids[row]), pa.array(keys[row]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
                    names=["context", "stretch", "doc_id", "text_key", "low", "high"],
                )

    return base.mapInArrow(run, "context long, stretch long, doc_id long, text_key long, low int, high int")


def _window_rows(candidates: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keys = batch.column("text_key").to_numpy(zero_copy_only=False)
            ranges = batch.column("ranges")
            for rows, texts in chunks(list(range(batch.num_rows)), _texts(batch)):
                words = Words(texts, lanes=2)
                first, second = window_names(words, window)
                owner, at = [], []
                for k, row in enumerate(rows):
                    spans = ranges[row].values
                    use = np.zeros(max(int(words.counts[k]) - window + 1, 0) + 1, dtype=np.int32)
                    np.add.at(use, spans.field("low").to_numpy(), 1)
                    np.add.at(use, spans.field("high").to_numpy() + 1, -1)
                    p = np.flatnonzero(np.cumsum(use[:-1]) > 0)
                    owner.append(np.full(len(p), row))
                    at.append(p + words.first[k])
                owner, at = np.concatenate(owner), np.concatenate(at)
                begin = words.first[np.searchsorted(rows, owner)]
                yield pa.RecordBatch.from_arrays(
                    [_signed(first[at]), _signed(second[at]), pa.array(ids[owner]), pa.array(keys[owner]), pa.array((at - begin).astype(np.int32))],
                    names=["one", "two", "doc_id", "text_key", "start"],
                )

    return candidates.mapInArrow(run, "one long, two long, doc_id long, text_key long, start int")


def _cut(joined: DataFrame, window: int, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, ranges in zip(_texts(batch), batch.column("ranges")):
                words = text.split()
                n, gone = len(words), 0
                counts.append(n)
                if ranges.is_valid:
                    cover = np.zeros(n + 1, dtype=np.int32)
                    np.add.at(cover, ranges.values.field("low").to_numpy(), 1)
                    np.add.at(cover, ranges.values.field("high").to_numpy() + window, -1)
                    stay = np.cumsum(cover[:n]) == 0
                    gone = n - int(stay.sum())
                    words = [words[i] for i in np.flatnonzero(stay)]
                removed.append(gone)
                kept.append(b" ".join(words))
            columns = [batch.column(n) for n in batch.schema.names if n not in ("text_key", "ranges")]
            names = [n for n in batch.schema.names if n not in ("text_key", "ranges")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*names, "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with n_words, n_removed and kept (the kept words, joined by one space).

    Removed is each word covered by a window whose word sequence also starts in a
    document with a smaller id; windows are judged on the input.  Null, empty and blank
    texts have no words.  A text of fewer words than the window loses none.  Rows that
    repeat an id count as one document for the comparison, and each keeps its own row.
    Rows without an id lose nothing and take nothing from others.  All columns of
    ``docs`` are kept; its own n_words, n_removed and kept would be replaced.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col, "n_words", "n_removed", "kept")]
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_key"),
        *([F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("rest")] if others else []),
    )
    scratch = scratch or Scratch(docs.sparkSession, "recompress")
    key = ["doc_id", "text_key"]
    marks = _marks(base.select("doc_id", "text", "text_key").where("doc_id is not null and text is not null"), window)
    shared = spread(marks, "context", F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("context")
    met = scratch.keep(marks.join(shared, "context"), "marks")

    name = ["context", "stretch"]
    first = met.groupBy(*name, F.xxhash64(*name).alias("_spread")).agg(F.min("doc_id").alias("least")).drop("_spread")
    led = scratch.keep(met.join(first, name), "led")
    scratch.discard(met)
    settled = led.where("doc_id > least").select(*key, "low", "high")
    several = spread(led.where("doc_id = least").select(*name).distinct(), "context", F.count("*").alias("n")).where("n > 1").select("context")
    open_ranges = led.where("doc_id = least").join(several, "context").select(*key, F.struct("low", "high").alias("r")).groupBy(*key).agg(F.collect_list("r").alias("ranges"))

    # The exchange of texts by id is the same in both joins below, and Spark runs it once.
    windows = _window_rows(base.join(open_ranges, key), window)
    earliest = windows.groupBy("one", "two", F.xxhash64("one", "two").alias("_spread")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("one", "two", "least")
    verified = windows.join(earliest, ["one", "two"]).where("doc_id > least").select(*key, F.col("start").alias("low"), F.col("start").alias("high"))
    ranges = settled.unionByName(verified).groupBy(*key).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    joined = base.join(ranges, key, "left")
    extra = f", rest {base.schema['rest'].dataType.simpleString()}" if others else ""
    cut = _cut(joined.select("doc_id", "text", *(["rest"] if others else []), "text_key", "ranges"), window, f"doc_id long, text string{extra}, n_words long, n_removed long, kept string")
    restored = [F.col("doc_id").cast(docs.schema[id_col].dataType).alias(c) if c == id_col else F.col("text").alias(c) if c == text_col else F.col(f"rest.c{others.index(c)}").alias(c) for c in docs.columns if c in (id_col, text_col, *others)]
    return cut.select(*restored, "n_words", "n_removed", "kept")
