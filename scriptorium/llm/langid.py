"""Operator 7: language identification with language-bitmask n-gram filters.

Training counts the byte n-grams of a sample of labelled texts and keeps the most
frequent ones of each language.  One Bloom filter holds them all, sliced by bits: each
position has one bit for each language, so the AND of an n-gram's positions is the
mask of all languages that contain it, found by one probe.  A text's popcount for each
language, less the false positives that the language's fill leads one to expect,
decides.  The filter has a fixed size, so what is sent to the workers is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.wordhash import U64, chunks, mix

#: Labelled rows that training reads, about, at any input size.
SAMPLE_ROWS = 20_000
#: N-grams kept for each language, bytes of an n-gram, positions of the filter, probes.
GRAMS, SIZE, POSITIONS, PROBES = 6000, 4, 1 << 18, 3
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, n-gram) of every n-gram with letters; what is no letter is a space."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    pad = b" " * SIZE
    data = _FOLD[np.frombuffer(pad.join([b"", *texts, b""]), dtype=np.uint8)]
    owner = np.repeat(np.arange(-1, len(texts)), np.concatenate([[SIZE], sizes + SIZE]))
    blank = data == 0x20
    wide = data.astype(np.uint64)
    n = len(data) - SIZE + 1
    gram = np.zeros(n, dtype=np.uint64)
    good = np.ones(n, dtype=bool)
    for j in range(SIZE):
        gram |= wide[j : j + n] << U64(8 * j)
        if j:
            good &= ~(blank[j - 1 : j - 1 + n] & blank[j : j + n])
    # A gram belongs to the text of its second byte: a leading space is the padding's.
    at = owner[1 : n + 1] if SIZE > 1 else owner[:n]
    good &= at >= 0
    return at[good], gram[good]


def _spots(gram: np.ndarray) -> list[np.ndarray]:
    h = mix(gram)
    return [((h >> U64(20 * i)) & U64(POSITIONS - 1)).astype(np.int64) for i in range(PROBES)]


@dataclass
class Model:
    """Filter slices (one uint64 of each position for every 64 languages) and names."""

    languages: list[str]
    slices: list[np.ndarray]
    false_rate: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> Model:
        languages = sorted(grams)
        slices = [np.zeros(POSITIONS, dtype=np.uint64) for _ in range((len(languages) + 63) // 64)]
        rate = np.zeros(len(languages))
        for i, name in enumerate(languages):
            bit = U64(1) << U64(i % 64)
            for spot in _spots(grams[name]):
                slices[i // 64][spot] |= bit
            rate[i] = np.mean((slices[i // 64] & bit) != 0) ** PROBES
        return cls(languages, slices, rate)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Share of each text's n-grams that each language contains, corrected: texts x languages."""
        owner, gram = _grams(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(np.float64)
        out = np.zeros((len(texts), len(self.languages)))
        spots = _spots(gram)
        for s, table in enumerate(self.slices):
            masks = table[spots[0]]
            for spot in spots[1:]:
                masks &= table[spot]
            for i in range(64 * s, min(64 * s + 64, len(self.languages))):
                hits = np.bincount(owner[((masks >> U64(i % 64)) & U64(1)).astype(bool)], minlength=len(texts))
                out[:, i] = (hits - total * self.false_rate[i]) / (1 - self.false_rate[i])
        return np.clip(out / np.maximum(total, 1)[:, None], 0, 1)


def _share(counts: list[int], most: int) -> float:
    """The bound on a label's rows under which all labels together keep ``most``, at least 1."""
    left, bound = most, 0.0
    for i, n in enumerate(ordered := sorted(counts)):
        bound = left / (len(ordered) - i)
        if n > bound:
            break
        left -= n
    return max(bound, 1.0)


def train(labelled: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from rows with a label; above ``sample_rows`` a sample by the id's hash within each label is read.

    Labels with few rows are read whole, the others share what is left of the bound.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    label = F.col(label_col).cast("string")
    count = {r["lang"]: r["count"] for r in rows.groupBy(label.alias("lang")).count().collect()}
    if sum(count.values()) > sample_rows:
        share = _share(list(count.values()), sample_rows)
        below = {name: int((1 << 30) * share / n) for name, n in count.items() if n > share}
        # A label that isn't here is read whole.
        limits = F.create_map(*(F.lit(x) for item in below.items() for x in item)) if below else F.lit(None).cast("map<string,bigint>")
        rows = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.coalesce(F.element_at(limits, label), F.lit(1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            raw = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            kinds = sorted(set(names))
            code = np.array([kinds.index(n) for n in names])
            for at, texts in chunks(list(range(len(raw))), raw):
                owner, gram = _grams(texts)
                kind = code[np.array(at)][owner]
                for k in np.unique(kind).tolist():
                    value, n = np.unique(gram[kind == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([kinds[k]] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = rows.select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "lang string, gram long, n long")
    best = (
        counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
        .where(F.col("place") <= GRAMS)
    )
    grams: dict[str, list[int]] = {}
    for r in best.select("lang", "gram").collect():
        grams.setdefault(r["lang"], []).append(r["gram"])
    return Model.build({k: np.array(v, dtype=np.int64).view(np.uint64) for k, v in grams.items()})


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score.

    A null text, one without a letter, and any text under a model of no languages is
    ``und`` with score 0.  All columns stay; lang_pred and score would be replaced.
    """
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = f"c{others.index(text_col)}"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for batch in batches:
            column = batch.column("rest").field(place).cast(pa.string())
            raw = [b or b"" for b in column.cast(pa.binary()).to_pylist()]
            names, scores = [], []
            for at, texts in chunks(list(range(len(raw))), raw):
                table = own.scores(texts) if own.languages else None
                for k, row in enumerate(at):
                    if table is None or not _LETTER.search(column[row].as_py() or ""):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                    else:
                        i = int(table[k].argmax())
                        names.append(own.languages[i])
                        scores.append(float(table[k, i]))
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["rest", "lang_pred", "score"])

    # The text is a field of the row and so sent once.
    source = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("rest"))
    out = source.mapInArrow(run, f"rest {source.schema['rest'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(*(F.col(f"rest.c{i}").alias(c) for i, c in enumerate(others)), "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on the rows that aren't held out and predict all; adds held_out, lang_pred and score, in place of columns of these names."""
    model = train(docs.where(~held_out(id_col)), label_col, text_col, id_col, sample_rows)
    return predict(docs.withColumn("held_out", held_out(id_col)), model, text_col)
