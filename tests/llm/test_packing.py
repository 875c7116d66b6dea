import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hard_rows import documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptorium.llm import packing
from scriptorium.llm.queries import op3_packing

FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=40))
def test_plan_uses_each_piece_once_and_fits(histogram):
    used, sequences = Counter(), 0
    for filling, times in packing.plan(histogram, 64):
        assert sum(filling) <= 64 and times > 0
        sequences += times
        for x in filling:
            used[x] += times
    assert used == Counter(histogram)
    total = sum(k * v for k, v in histogram.items())
    best_fit = _best_fit_decreasing(histogram, 64)
    assert math.ceil(total / 64) <= sequences <= best_fit + max(1, best_fit // 50)


def _best_fit_decreasing(histogram, capacity):
    rooms = []
    for k in sorted(histogram, reverse=True):
        for _ in range(histogram[k]):
            fits = [r for r in rooms if r >= k]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - k)
            else:
                rooms.append(capacity - k)
    return len(rooms)


def _check(rows, docs):
    tokenizer = Tokenizer.from_file(FILES[0])
    want = Counter()
    for d in docs:
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences), sum(r["length"] for r in rows)


def test_hard_rows(spark):
    docs = documents(spark)
    _check(packing.pack_documents(docs, *FILES).collect(), docs.collect())
    assert packing.pack_documents(empty(spark), *FILES).count() == 0


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    sequences, tokens = _check(op3_packing(spark, sf).collect(), spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sequences <= math.ceil(tokens / 1024) + 1


def test_quick_and_full_tokenizer_agree(spark):
    docs = documents(spark).where("doc_id <> 10")
    a = packing.tokenized_pieces(docs, FILES[0]).collect()
    b = packing.tokenized_pieces(docs, *FILES).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_complements_lose_nothing_against_best_fit():
    """On skewed lengths the plan with complements needs no more sequences than best fit alone, and is the one used."""
    rng = np.random.default_rng(3)
    for _ in range(5):
        lengths = np.minimum(1 + rng.geometric(1 / 200, 4000), 1024)
        histogram = dict(Counter(lengths.tolist()))
        used = packing.plan(histogram)
        assert sum(n for _, n in used) <= sum(n for _, n in packing._planned(histogram, 1024, 0, 0))
        assert sum(n for filling, n in used if sum(filling) == 1024) > 0


def test_buckets_follow_the_most_frequent_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 8)
    pieces = spark.range(900).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "if(id % 3 = 0, 1024L, id) AS length", "id AS ids_crc32").where("length > 0")
    rows = packing.pack(pieces).collect()
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(rows) == len(places) == pieces.count()
