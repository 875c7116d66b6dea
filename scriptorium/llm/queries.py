"""Registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import byte_bpe, cover_tree, hnsw, langid, minhash, packing, recompress, secrets_scan, sharding, url_filter
from scriptorium.llm.oracles import ORACLES  # noqa: F401  registered with the queries
from scriptorium.sources.tables import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    return packing.pack_documents(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, names))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_embeddings(table(spark, sf_dir, "embeddings"), 0.98)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is what the crawl has of hosts with a label that begins with ``spam-`` or ``casino-``."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(r"(^|\.)(spam|casino)-")).select("url")
    return url_filter.filter_urls(pages, listed, RULES)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.digest(secrets_scan.scan(table(spark, sf_dir, "documents")))


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompress.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_cover_tree": op2_cover_tree,
    "op3_packing": op3_packing,
    "op4_minhash": op4_minhash,
    "op5_hnsw": op5_hnsw,
    "op6_sharding": op6_sharding,
    "op7_langid": op7_langid,
    "op8_url_filter": op8_url_filter,
    "op9_secrets": op9_secrets,
    "op10_recompression": op10_recompression,
}

