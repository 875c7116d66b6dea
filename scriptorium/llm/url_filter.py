"""Operator 8: URL filter by a blocked Bloom filter and an exact join, in DataFrame operations only.

Rules on host and path come first.  Where none fits, the list decides: a Bloom filter of
64-bit blocks, one for each group of listed canonical URLs, passes possible hits, and
only these meet the list in an exact hash join, which removes false positives.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Listed URLs for each 64-bit block, and the most blocks (16 bytes each) that are broadcast; of more,
#: each row fetches its own by a join on the block.
PER_BLOCK, MOST_BLOCKS, BITS = 6, 1 << 20, 4


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(url.isNotNull() & (at > 0), F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What is between the first :// and /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., path without trailing slashes, query without tracking parameters; null without ://."""
    rest = _rest(url)
    query = F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda q: (q != "") & ~q.rlike(r"^(utm_[a-z]+|ref)="))), "&")
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(rest.isNotNull(), F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """(block, bits within it) of a key."""
    h = F.xxhash64(key)
    g = F.xxhash64(key, F.lit(1))
    bits = F.lit(0).cast("long")
    for i in range(BITS):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(h, F.lit(blocks)), bits


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed), one row for each row of ``pages``.

    A rule's verdict counts; without one a URL on the list (compared in canonical form)
    is ``block`` and any other ``allow``.  Null URLs and those without :// have an empty
    host and path, fit no rule and are on no list.  Repeated rows stay.
    """
    # The list is read and made canonical once; count, filter and exact join read the stored keys.
    keys = listed.select(canonical(F.col(listed_col)).alias("key")).where("key is not null").distinct()
    keys = Scratch(pages.sparkSession, "urls").keep(keys, "listed")
    count = keys.count()
    blocks = 1 << max(6, math.ceil(math.log2(max(1, count / PER_BLOCK))))
    block, bits = _bits(F.col("key"), blocks)
    bloom = keys.select(block.alias("block"), bits.alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("filled"))
    url = F.col(url_col).cast("string")
    host, path = F.col("host"), F.col("path")
    name, verdict = fitting_rule(host, path, rules)
    judged = (
        pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
        .select("id", "host", "path", "key", name.alias("rule"), verdict.alias("ruled"), block.alias("block"), bits.alias("bits"))
        .join(F.broadcast(bloom) if blocks <= MOST_BLOCKS else bloom, "block", "left")
    )
    possible = F.coalesce(F.col("ruled").isNull() & F.col("key").isNotNull() & (F.col("filled").bitwiseAND(F.col("bits")) == F.col("bits")), F.lit(False))
    hit = F.col("hit")
    unlisted = judged.where(~possible).withColumn("hit", F.lit(False))
    checked = judged.where(possible).join(keys.withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    return unlisted.unionByName(checked).select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("ruled", F.when(hit, "block").otherwise("allow")).alias("verdict"), hit.alias("listed"),
    )
