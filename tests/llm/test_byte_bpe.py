import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hard_rows import documents, empty

from scriptorium.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = ["the ", " ", "  ", "\n", "'s", "'ll", "'", "a", "quick", "ß", "日本", "123", "!!", " ", "😀", "é", "xyz" * 30, "aaaa", "\t", "don't", " I'VE"]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("all", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_rank_can_be_merged(ranks):
    assert byte_bpe.Coder(ranks, PATTERN).every_rank_reachable()


@pytest.mark.parametrize("leaf,piece", [(2, 2), (9, 5), (64, 16), (byte_bpe.LEAF, byte_bpe.PIECE)])
def test_tree_equals_one_call(ranks, reference, leaf, piece):
    coder = byte_bpe.Coder(ranks, PATTERN, leaf, piece)
    rng = random.Random(leaf)
    for _ in range(150):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(40)))
        ids = coder.encode(text)
        assert ids == reference.encode_ordinary(text), repr(text)
        assert coder.decode(ids) == text.encode()


def test_long_words_and_long_blanks(ranks, reference):
    coder = byte_bpe.Coder(ranks, PATTERN, 256, 32)
    for text in ("a" * 5000, " " * 3000 + "x", "ab" * 3000 + " " + "日" * 2000, "x\n\n\n" * 700):
        assert coder.encode(text) == reference.encode_ordinary(text)


def test_hard_rows(spark, reference):
    docs = documents(spark)
    got = byte_bpe.round_trip(docs, PATH, PATTERN).collect()
    want = []
    for r in docs.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert byte_bpe.round_trip(empty(spark), PATH, PATTERN).count() == 0


def test_encode_then_decode(spark):
    docs = documents(spark).where("doc_id is not null").select("doc_id", "text").distinct()
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, PATH, PATTERN), PATH, PATTERN)
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in back.collect()) == sorted((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect())


def test_a_whole_table_goes_through_the_tree(spark, ranks, reference):
    """Ids of all documents equal the library's, and each text longer than a leaf was joined from halves."""
    coder = byte_bpe.Coder(ranks, PATTERN)
    for row in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        text, before = row["text"] or "", coder.joins
        ids = coder.encode(text)
        assert ids == reference.encode_ordinary(text) and coder.decode(ids) == text.encode()
        assert coder.joins > before or len(text) <= byte_bpe.LEAF


def test_unreachable_ranks_are_refused(tmp_path):
    import base64

    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(b) + b" %d" % i for i, b in enumerate([b"a", b"b", b"c", b"abc"])))
    with pytest.raises(ValueError):
        byte_bpe.check_ranks(str(path), PATTERN)
