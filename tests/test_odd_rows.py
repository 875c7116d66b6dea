"""Queries against their SQL on rows that the given tables have few of."""

import os

import pytest
from oracle import TABLES, difference

from scriptorium import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    def build(name, rows):
        for t in TABLES:
            if t != name:
                os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
        schema = spark.read.parquet(f"{SF}/{name}.parquet").schema
        spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema).toPandas().to_parquet(tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return build


def test_comments_behind_blank_lines(spark, folder):
    texts = ["", "  ", "a\n\nb\n\nc", "a\nb\nc\n  \n", "50% of\n\n\n\n# x"]
    where = folder("documents", [{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    assert difference(spark, registry.QUERIES["comment_strip"], registry.ORACLES["comment_strip"], where) == (False, [], [])


def test_texts_cut_behind_a_newline(spark, folder):
    texts = ["x" * 699 + "\nmore", "y" * 690 + " \n  " + "more" * 9, "short", "z" * 700]
    where = folder("conversations", [{"conv_id": i % 2, "turn": i, "role": "assistant", "text": t} for i, t in enumerate(texts * 2)])
    assert difference(spark, registry.QUERIES["visible_text_normalize"], registry.ORACLES["visible_text_normalize"], where) == (False, [], [])


def test_many_turns_in_one_conversation(spark, folder):
    rows = [{"conv_id": 1, "turn": i, "role": "user", "text": f"text {i % 4000} of it"} for i in range(6000)]
    where = folder("conversations", rows)
    assert difference(spark, registry.QUERIES["visible_text_normalize"], registry.ORACLES["visible_text_normalize"], where) == (False, [], [])
