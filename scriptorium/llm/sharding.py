"""Operator 6: shards of even row counts by balanced label propagation, in DataFrame operations only.

Rows with equal texts are linked.  Linked rows of one text are interchangeable, so the
label table has one row for each (text, shard) with a count: a text with any number of
copies is at most ``shards`` rows.  In each round every text moves towards the shard
that holds most of its copies; arrivals are taken in a fixed order up to the shard's
quota, and what finds no room stays and tries its next best shard in the next round.
Rows without copies then fill the shards to their exact sizes, which cuts no edge.

Ranks and running sums are taken in two levels, by bucket and within the bucket, so no
task sees a whole shard or a whole group of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.components import spread
from scriptorium.plans.scratch import Scratch

SHARDS, ROUNDS, BUCKETS = 16, 4, 1024


def _ranked(rows: DataFrame, keys: list[str], out: str, order: list[str], bounded: bool) -> DataFrame:
    """``rows`` with a gapless rank from 0 within ``keys``; needs a column bucket.

    bounded: the keys take few values, so the table of counts may be broadcast.
    """
    counted = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("bucket") if keys else Window.partitionBy(F.lit(0)).orderBy("bucket")
    before = counted.select(*keys, "bucket", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order))
    joined = rows.withColumn("_inside", inside).join(F.broadcast(before) if bounded else before, [*keys, "bucket"])
    return joined.withColumn(out, F.col("_before") + F.col("_inside") - 1).drop("_before", "_inside")


def _shard_of(rank: Column, sizes: list[int]) -> Column:
    """The shard whose interval of ranks holds ``rank``, for shards filled in turn."""
    out, upto = F.lit(None).cast("int"), 0
    bounds = []
    for shard, size in enumerate(sizes):
        upto += size
        bounds.append((shard, upto))
    for shard, end in reversed(bounds):
        out = F.when(rank < end, F.lit(shard)).otherwise(out)
    return out


def _round(cells: DataFrame, limit: int, shards: int, loads: dict[int, int]) -> DataFrame:
    """Cells (text, shard, n) after one round of moves; loads: rows in each shard now."""
    room = F.element_at(F.array(*(F.lit(max(0, limit - loads.get(s, 0))) for s in range(shards))), F.col("shard") + 1)
    want = spread(
        cells.withColumn("free", room), "text",
        F.max(F.struct((F.col("free") > 0).alias("open"), "n", F.xxhash64("text", "shard").alias("tie"), "shard", "free")).alias("best"),
    ).where("best.open").select("text", F.col("best.shard").alias("to"), F.col("best.free").alias("free"), F.col("best.n").alias("held"))
    joined = cells.join(want, "text", "left")
    moving = joined.where("to is not null and to <> shard").withColumn("bucket", F.pmod(F.xxhash64("text"), F.lit(BUCKETS)).cast("int"))
    by_bucket = moving.groupBy("to", "bucket").agg(F.sum("n").alias("_n"))
    before = by_bucket.select("to", "bucket", (F.sum("_n").over(Window.partitionBy("to").orderBy("bucket")) - F.col("_n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("to", "bucket").orderBy(F.desc("held"), "text", "shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    taken = moving.withColumn("inside", inside).join(F.broadcast(before), ["to", "bucket"]).withColumn(
        "moved", F.greatest(F.lit(0), F.least("n", F.col("free") - F.col("before") - F.col("inside")))
    )
    parts = taken.select("text", F.explode(F.array(F.struct(F.col("to").alias("shard"), F.col("moved").alias("n")), F.struct("shard", (F.col("n") - F.col("moved")).alias("n")))).alias("c")).select("text", "c.shard", "c.n")
    stay = joined.where("to is null or to = shard").select("text", "shard", "n")
    return stay.unionByName(parts).where("n > 0").groupBy("text", "shard").agg(F.sum("n").alias("n"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, text_group, copies), one row for each row.

    Law ``rows``: the shards' row counts are at most one apart.  size is the UTF-8 bytes
    of the text plus 1 (a null text has none); slots are gapless from 0 in each shard.
    Null texts are linked with nothing; equal empty texts are linked.  Rows that repeat
    an id are rows like any other.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.col(text_col).cast("string")
    rows = scratch.keep(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.md5(text).alias("text"),
            F.pmod(F.xxhash64(id_col, text_col), F.lit(BUCKETS)).cast("int").alias("bucket"),
        ),
        "rows",
    )
    total = rows.count()
    target = [total // shards + (s < total % shards) for s in range(shards)]
    groups = spread(rows.where("text is not null"), "text", F.count("*").alias("copies")).where("copies > 1")
    linked = scratch.keep(rows.join(groups, "text"), "linked")
    single = rows.join(groups, "text", "left_anti")

    # Labels: a row starts in the shard of its bucket.
    cells = scratch.keep(linked.groupBy("text", (F.col("bucket") % shards).alias("shard")).agg(F.count("*").alias("n")), "cells")
    for _ in range(rounds):
        loads = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        after = scratch.keep(_round(cells, total // shards, shards, loads), "cells")
        scratch.discard(cells)
        cells = after

    # Copies take their text's places by rank; at most ``shards`` places a text.
    places = spread(cells, "text", F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("places"))
    ranked = _ranked(linked, ["text"], "rank", ["doc_id", "size"], bounded=False).join(places, "text")
    upto = F.expr("aggregate(places, named_struct('left', rank, 'shard', -1), (a, p) -> if(a.shard >= 0, a, if(a.left < p.n, named_struct('left', a.left, 'shard', p.shard), named_struct('left', a.left - p.n, 'shard', -1)))).shard")
    settled = ranked.withColumn("shard", upto.cast("int")).drop("rank", "places")
    # Above its exact size a shard gives rows back; these and the single ones fill the rest.
    settled = scratch.keep(_ranked(settled, ["shard"], "place", ["doc_id", "text"], bounded=True), "settled")
    held = {r["shard"]: r["n"] for r in settled.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    full = F.element_at(F.array(*(F.lit(t) for t in target)), F.col("shard") + 1)
    stays = settled.where(F.col("place") < full).drop("place")
    loose = single.withColumn("copies", F.lit(1).cast("long")).unionByName(settled.where(F.col("place") >= full).drop("place", "shard"))
    need = [t - min(t, held.get(s, 0)) for s, t in enumerate(target)]
    filled = _ranked(loose, [], "rank", ["doc_id", "text", "size"], bounded=True)
    filled = filled.withColumn("shard", _shard_of(F.col("rank"), need)).drop("rank")
    out = _ranked(stays.unionByName(filled), ["shard"], "slot", ["doc_id", "text", "size"], bounded=True)
    return out.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("text").alias("text_group"), "copies",
    )
