"""Operator 2: exact top-k inner products by dual-tree search on cover trees.

Equal vectors are folded into one node that knows its smallest ids; more can never be
among the best.  Nodes are dealt to cells around pivots and, in a cell, to shards of
bounded size; queries are dealt to groups alike.  A task holds one shard and one group,
builds a cover tree of each and walks both at once: a pair of nodes with centres a, b and
covering radii r, s can't score above <a, b> + r|b| + s|a| + rs, and is pruned when that is
below the worst kth score of the query node; at a leaf of queries each one is judged by its own.

Groups first meet a shard of their own cell.  The scores found there prune whole cells,
and only then do groups meet the shards of the cells that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.embeddings import common_length, matrix, pivots, salted, usable
from scriptorium.plans.scratch import Scratch

#: Vectors in a shard and in a query group; points up to which a node is a leaf.
SHARD, GROUP, LEAF = 2048, 512, 32


class CoverTree:
    """Nodes with a centre, the exact covering radius, and either children or points.

    The children of a node of radius r have centres that are more than r / 2 apart, as many as
    it takes, and each of the node's points is within r / 2 of its child's centre.  A node is a
    leaf if it has few points, or if such a cover would take a quarter of them as centres: no
    ball of half the radius holds enough of them to be worth a bound.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.norm = np.linalg.norm(points, axis=1)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        if len(points):
            self._grow(np.arange(len(points)), 0)

    def _grow(self, members: np.ndarray, centre: int) -> int:
        node = len(self.centre)
        own = self.points[members]
        away = np.linalg.norm(own - self.points[centre], axis=1)
        self.centre.append(centre)
        self.radius.append(float(away.max()))
        self.members.append(members)
        self.children.append([])
        if len(members) <= LEAF or not self.radius[node]:
            return node
        # Farthest points in turn, until all are within half the radius of one.
        reach, near = self.radius[node] / 2, away
        owner, centres = np.zeros(len(members), dtype=np.int64), [centre]
        while near.max() > reach:
            if len(centres) >= len(members) // 4:
                return node
            new = int(near.argmax())
            d = np.linalg.norm(own - own[new], axis=1)
            closer = d < near
            owner[closer] = len(centres)
            near = np.minimum(near, d)
            centres.append(int(members[new]))
        self.children[node] = [self._grow(members[owner == k], c) for k, c in enumerate(centres)]
        return node


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        #: Scores below this can't be among the k best overall.
        self.floor = np.full(queries, -np.inf) if floor is None else floor
        #: Pairs of a query and a point whose score was computed; all others were pruned.
        self.scored = 0

    def worst(self, which: np.ndarray) -> float:
        return float(np.maximum(self.score[which, -1], self.floor[which]).min())

    def offer(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        # Most queries have nothing to gain from most leaves.
        gains = score.max(axis=1) >= np.maximum(self.score[which, -1], self.floor[which])
        if not gains.any():
            return
        which, score = which[gains], score[gains]
        if score.shape[1] > 4 * self.k:
            # Columns that no query's k best of this leaf come from, ties included, can go.
            kth = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1]
            use = (score >= np.maximum(kth, self.floor[which])[:, None]).any(axis=0)
            score, ids = score[:, use], ids[use]
        score = np.concatenate([self.score[which], score], axis=1)
        ids = np.concatenate([self.id[which], np.broadcast_to(ids, (len(which), len(ids)))], axis=1)
        order = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.score[which] = np.take_along_axis(score, order, axis=1)
        self.id[which] = np.take_along_axis(ids, order, axis=1)


def dual_search(queries: CoverTree, points: CoverTree, ids: np.ndarray, best: Best) -> None:
    """Fill ``best`` from all points; exact while scores are below 2**53."""
    q, p = queries, points
    if not len(q.points) or not len(p.points):
        return

    def bound(a: int, others: list[int]) -> np.ndarray:
        c = [p.centre[b] for b in others]
        r, s = q.radius[a], np.array([p.radius[b] for b in others])
        i = q.centre[a]
        most = p.points[c] @ q.points[i] + r * p.norm[c] + s * q.norm[i] + r * s
        return most + 1e-9 * np.abs(most) + 1e-6

    def alive(which: np.ndarray, b: int) -> np.ndarray:
        """Those of some queries that a point of node b may still have something for; for one query the radius is 0."""
        most = q.points[which] @ p.points[p.centre[b]] + p.radius[b] * q.norm[which]
        return which[most + 1e-9 * np.abs(most) + 1e-6 >= np.maximum(best.score[which, -1], best.floor[which])]

    stack = [(0, 0, float(bound(0, [0])[0]), q.members[0])]
    while stack:
        a, b, most, which = stack.pop()
        if most < best.worst(which):
            continue
        if q.children[a] and (not p.children[b] or q.radius[a] >= p.radius[b]):
            stack += sorted(((c, b, float(bound(c, [b])[0]), q.members[c]) for c in q.children[a]), key=lambda x: x[2])
            continue
        if not q.children[a]:
            which = alive(which, b)
            if not len(which):
                continue
        if p.children[b]:
            others = p.children[b]
            stack += sorted(((a, c, float(m), which) for c, m in zip(others, bound(a, others))), key=lambda x: x[2])
        else:
            m = p.members[b]
            best.scored += len(which) * len(m)
            best.offer(which, q.points[which] @ p.points[m].T, ids[m])


def _integers(vector: Column) -> Column:
    """floor(256 x) of each component, with x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def _dealt(nodes: DataFrame, centres: np.ndarray) -> DataFrame:
    """(rep, vector, ids, cell, away): the nearest pivot of each vector and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column("vector"), np.float64)
            if len(points):
                square = (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)
                cell = square.argmin(axis=1)
                away = np.linalg.norm(points - centres[cell], axis=1)
            else:
                cell, away = np.zeros(0, dtype=np.int64), np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("vector"), pa.array(cell.astype(np.int32)), pa.array(away)], names=["rep", "vector", "cell", "away"])

    return nodes.select("rep", "vector").mapInArrow(run, "rep long, vector array<long>, cell int, away double")


def _packed(dealt: DataFrame, rows: int, name: str) -> DataFrame:
    out = salted(dealt, "cell", "rep", rows)
    return out.groupBy("cell", "salt").agg(F.collect_list(F.struct("rep", "vector")).alias(name))


def _meet(pairs: DataFrame, k: int) -> DataFrame:
    """(query, rep, score): the k best points of the row's shard for each query of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree, ids = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                spot = (batch.column("cell")[i].as_py(), batch.column("salt")[i].as_py())
                if spot != held:
                    points = batch.column("points")[i].values
                    ids = points.field("rep").to_numpy()
                    held, tree = spot, CoverTree(matrix(points.field("vector"), np.float64))
                asked = batch.column("queries")[i].values
                names = asked.field("rep").to_numpy()
                floor = batch.column("floor")[i].values.to_numpy(zero_copy_only=False).astype(np.float64)
                best = Best(len(names), k, floor if len(floor) else None)
                dual_search(CoverTree(matrix(asked.field("vector"), np.float64)), tree, ids, best)
                some = best.score > -np.inf
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, some.sum(axis=1))), pa.array(best.id[some]), pa.array(best.score[some].astype(np.int64))],
                    names=["query", "rep", "score"],
                )

    return pairs.select("cell", "salt", "points", "queries", "floor").mapInArrow(run, "query long, rep long, score long")


def _first(rows: DataFrame, keys: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of floor(256 x) for each query row.

    Candidates are all rows but the query's own id; ties go to the smaller id.  Vectors
    that are null, hold null or non-finite components or have another than the most
    frequent length take no part.  With fewer candidates there are fewer rows.  Rows that
    repeat an id count as one if their vectors are equal.  Scores must be below 2**53.
    """
    scratch = Scratch(vectors.sparkSession, "cover-tree")
    usable_rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"), is_query.alias("asks"))
    length = common_length(usable_rows, "raw")
    rows = usable_rows.where(F.size("raw") == length).select("id", "asks", _integers(F.col("raw")).alias("vector")).distinct()
    # One node for each vector: its smallest ids are all that can be among the best.
    few = _first(rows, ["vector"], ["id"], k + 1, "place")
    nodes = scratch.keep(few.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "nodes")
    asking = rows.where("asks").select("id", "vector").join(nodes.select("vector", "rep"), "vector")
    asking = scratch.keep(asking.select("id", "rep", "vector"), "asking")
    centres = pivots(nodes, "vector", "rep")
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dealt = scratch.keep(_dealt(nodes, centres), "dealt")
    spans = {r["cell"]: r["away"] for r in dealt.groupBy("cell").agg(F.max("away").alias("away")).collect()}
    shards = scratch.keep(_packed(dealt, SHARD, "points"), "shards")
    own = _dealt(asking.select("rep", "vector").distinct(), centres)
    groups = scratch.keep(_packed(own, GROUP, "queries").withColumnRenamed("cell", "home").withColumnRenamed("salt", "part"), "groups")

    none = F.expr("cast(array() as array<long>)")
    first = groups.withColumn("floor", none).join(shards.where("salt = 0"), F.col("home") == F.col("cell"))
    seen = scratch.keep(_meet(first, k + 1), "first")
    kth = seen.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n")).select("query", F.when(F.col("n") > k, F.col("least")).alias("floor"))

    # A cell stays for a group if its bound reaches the group's worst floor.
    spread_out = np.array([spans.get(c, -1.0) for c in range(len(centres))])
    size = np.linalg.norm(centres, axis=1)
    inner = centres @ centres.T

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                home, floors = batch.column("home")[i].as_py(), batch.column("floor")[i].values.to_numpy(zero_copy_only=False)
                asked = matrix(batch.column("queries")[i].values.field("vector"), np.float64)
                r = float(np.linalg.norm(asked - centres[home], axis=1).max())
                most = inner[home] + r * size + spread_out * size[home] + r * spread_out
                stay = np.flatnonzero((most + 1e-9 * np.abs(most) + 1e-6 >= floors.min()) & (spread_out >= 0)).astype(np.int32)
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("home", "part", "queries", "floor")), pa.array([stay.tolist()], pa.list_(pa.int32()))], names=["home", "part", "queries", "floor", "cells"])

    asked = groups.select("home", "part", F.posexplode("queries").alias("at", "q")).join(kth, F.col("q.rep") == F.col("query"), "left")
    lowest = F.lit(-(1 << 62)).cast("long")
    floors = asked.groupBy("home", "part").agg(F.array_sort(F.collect_list(F.struct("at", "q", F.coalesce("floor", lowest).alias("floor")))).alias("all"))
    floors = floors.select("home", "part", F.transform("all", lambda x: x["q"]).alias("queries"), F.transform("all", lambda x: x["floor"]).alias("floor"))
    kind = floors.schema["queries"].dataType.simpleString()
    left = floors.mapInArrow(survivors, f"home int, part int, queries {kind}, floor array<long>, cells array<int>")
    salts = shards.groupBy("cell").agg(F.max("salt").alias("last"))
    targets = (
        left.withColumn("cell", F.explode("cells")).join(F.broadcast(salts), "cell")  # one row a pivot
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .where("not (cell = home and salt = 0)").select("cell", "salt", "queries", "floor")
    )
    more = _meet(targets.join(shards, ["cell", "salt"]), k + 1)

    found = _first(seen.unionByName(more), ["query"], [F.desc("score"), "rep"], k + 1, "place").select("query", "rep", "score")
    listed = found.join(nodes.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    listed = _first(listed, ["query"], [F.desc("score"), "vec_id"], k + 1, "place")
    answers = asking.select(F.col("id").alias("query_id"), F.col("rep").alias("query")).join(listed, "query").where("vec_id <> query_id")
    ranked = _first(answers, ["query_id"], [F.desc("score"), "vec_id"], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
