"""Operator 5: near-duplicate embeddings by hierarchical navigable small-world graphs.

Equal vectors of a label are folded into one node first.  The nodes of a label are dealt
to shards of bounded size.  A shard has one graph of several layers, each node linked to
diverse near nodes, upper layers ever thinner.  Every node queries every shard of its
label: a descent through the layers, then a beam at the bottom that goes on for as long as
what it meets is near enough to be a link.  A recall audit compares the links of some of the
queries, of the own shard and of each other one, with brute force; while it fails, the beam is
doubled, in the end to the whole shard.

Links are verified by cosine in double precision.  A task returns for each node its number
of links and the smallest node it is connected with there, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.components import connected_components, spread
from scriptorium.llm.embeddings import common_length, matrix, salted, usable
from scriptorium.plans.scratch import Scratch

#: Nodes of a shard; links of a node above the bottom (twice as many there).
SHARD, DEGREE = 8192, 10
#: Beams: of the upper layers, while a layer is built, and the first one that an audit tries.
UPPER, BUILD, BEAM = 6, 16, 4
#: Nodes of its own batch that a node may be linked with when it is added.
PEERS = 6
#: Nodes that a step expands at a time.
STEP = 1 << 15
#: Nodes that an audit compares with brute force, and the recall it asks for.
AUDIT, RECALL = 96, 0.999
_SLACK = 1e-4
_FAR = 2.0  # nothing is as near


class Walks:
    """Best-first walks of some queries over one layer, all at once.

    A walk expands whatever it meets within reach, and of the rest the nearest, ``width`` of
    them.  It keeps a pool of ``width`` nodes and the set of those it has seen; a step looks at
    the links of what it expands and at nothing else.
    """

    def __init__(self, points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, reach: float = _FAR):
        n, q = len(points), len(queries)
        seen = np.zeros(q * n, dtype=bool)
        self.value = np.full((q, width), -np.inf, dtype=np.float32)
        self.node = np.full((q, width), -1, dtype=np.int64)
        waits = np.zeros((q, width), dtype=bool)
        left = np.full(q, width)
        every = np.arange(q)
        self.compared = 0

        def meet(who: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Compare what a query has not seen; returns what is within reach."""
            key = who * n + what
            key = np.unique(key[~seen[key]])
            seen[key] = True
            who, what = np.divmod(key, n)
            value = np.einsum("ij,ij->i", queries[who], points[what])
            self.compared += len(key)
            near = value >= reach
            self._pool(waits, who[~near], what[~near], value[~near])
            return who[near], what[near]

        begin = entry.ravel() >= 0
        found = meet(np.repeat(every, entry.shape[1])[begin], entry.ravel()[begin])
        hits = [found]
        while True:
            ahead = np.where(waits, self.value, -np.inf)
            best = ahead.argmax(axis=1)
            go = np.flatnonzero((ahead[every, best] > -np.inf) & (left > 0))
            waits[go, best[go]] = False
            left[go] -= 1
            owner, at = np.concatenate([found[0], go]), np.concatenate([found[1], self.node[go, best[go]]])
            if not len(at):
                break
            met = []
            # A dense group makes a step wide; what is at work at once is bounded.
            for lo in range(0, len(at), STEP):
                near = links[at[lo : lo + STEP]]
                row, column = np.nonzero(near >= 0)
                met.append(meet(owner[lo : lo + STEP][row], near[row, column]))
            found = np.concatenate([x for x, _ in met]), np.concatenate([x for _, x in met])
            hits.append(found)
        self.hits = np.concatenate([x for x, _ in hits]), np.concatenate([x for _, x in hits])

    def _pool(self, waits: np.ndarray, who: np.ndarray, what: np.ndarray, value: np.ndarray) -> None:
        """Let newly met nodes into the pools; the farthest leave."""
        if not len(who):
            return
        width = self.value.shape[1]
        order = np.lexsort((-value, who))
        who, what, value = who[order], what[order], value[order]
        rows, begin, inside = np.unique(who, return_index=True, return_inverse=True)
        place = np.arange(len(who)) - begin[inside]
        use = place < width
        fresh = np.full((len(rows), width), -np.inf, dtype=np.float32)
        names = np.full((len(rows), width), -1, dtype=np.int64)
        fresh[inside[use], place[use]] = value[use]
        names[inside[use], place[use]] = what[use]
        both = np.concatenate([self.value[rows], fresh], axis=1)
        top = np.argpartition(-both, width - 1, axis=1)[:, :width]
        self.value[rows] = np.take_along_axis(both, top, axis=1)
        self.node[rows] = np.take_along_axis(np.concatenate([self.node[rows], names], axis=1), top, axis=1)
        waits[rows] = np.take_along_axis(np.concatenate([waits[rows], names >= 0], axis=1), top, axis=1)

    def nearest(self, k: int) -> np.ndarray:
        """The k nearest nodes of each query's pool, -1 where there are fewer."""
        order = np.argsort(-self.value, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(self.node, order, axis=1)


class Graph:
    """A layered graph over unit vectors (float32).

    Nodes are renumbered by falling level, so a layer's members are the first of all.
    ``order`` has the caller's number of each node.  compared: similarities computed so far.
    """

    def __init__(self, unit: np.ndarray, seed: int = 5):
        n = len(unit)
        rng = np.random.Generator(np.random.PCG64(seed))
        level = np.floor(-np.log(rng.random(n)) / np.log(16)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.unit = unit[self.order]
        self.compared = 0
        self.layers: list[np.ndarray] = []  # links, from the top down
        for height in range(level.max(initial=0), -1, -1):
            self._add(int((level >= height).sum()), DEGREE * (1 if height else 2))

    def _entries(self, queries: np.ndarray) -> np.ndarray:
        """Where walks over the next layer begin: what the layers above found nearest."""
        entry = np.zeros((len(queries), 1), dtype=np.int64)
        for links in self.layers:
            walks = Walks(self.unit[: len(links)], links, queries, entry, UPPER)
            self.compared += walks.compared
            entry = walks.nearest(3)
        return entry

    def _add(self, n: int, degree: int) -> None:
        """The next layer: nodes come in growing batches, each searches what is there."""
        points = self.unit[:n]
        links = np.full((n, degree), -1, dtype=np.int64)
        done = min(n, 2 * degree)
        if n:
            self._attach(points, links, np.arange(done), np.tile(np.arange(done), (done, 1)))
        while done < n:
            fresh = np.arange(done, min(n, 2 * done, done + 256))
            entry = self._entries(points[fresh])
            entry = np.where(entry < done, entry, 0)
            walks = Walks(points[:done], links[:done], points[fresh], entry, BUILD)
            # Nodes of a batch don't meet in its walks, so each also gets the nearest of them.
            peers = points[fresh] @ points[fresh].T
            np.fill_diagonal(peers, -np.inf)
            self.compared += walks.compared + len(fresh) ** 2
            near = np.argpartition(-peers, min(PEERS, len(fresh)) - 1, axis=1)[:, :PEERS]
            self._attach(points, links, fresh, np.concatenate([walks.node, fresh[near]], axis=1))
            done += len(fresh)
        self.layers.append(self._connect(points, links))

    @staticmethod
    def _diverse(points: np.ndarray, nodes: np.ndarray, options: np.ndarray, degree: int) -> np.ndarray:
        """For each node the nearest options that are nearer to it than to one chosen before; then the rest.

        options: one row for each node, distinct, -1 where there is none; so is the result.
        """
        out = np.full((len(nodes), degree), -1, dtype=np.int64)
        for at in range(0, len(nodes), 256):
            some = options[at : at + 256]
            close = np.matmul(points[some], points[nodes[at : at + 256]][:, :, None])[:, :, 0]
            close[(some < 0) | (some == nodes[at : at + 256, None])] = -np.inf
            order = np.argsort(-close, axis=1, kind="stable")[:, : degree + degree // 2]
            some, close = np.take_along_axis(some, order, axis=1), np.take_along_axis(close, order, axis=1)
            near = points[some]
            between = np.matmul(near, near.transpose(0, 2, 1))
            crowded = np.full(some.shape, -np.inf, dtype=np.float32)
            chosen = np.zeros(some.shape, dtype=bool)
            for i in range(some.shape[1]):
                chosen[:, i] = crowded[:, i] < close[:, i]
                crowded = np.where(chosen[:, i, None], np.maximum(crowded, between[:, i]), crowded)
            rank = np.argsort(np.where(close == -np.inf, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :degree]
            picked = np.take_along_axis(some, rank, axis=1)
            picked[np.take_along_axis(close, rank, axis=1) == -np.inf] = -1
            out[at : at + 256, : picked.shape[1]] = picked
        return out

    def _attach(self, points: np.ndarray, links: np.ndarray, fresh: np.ndarray, options: np.ndarray) -> None:
        """Link fresh nodes to diverse options and these back to them; only links that are too many are chosen anew."""
        degree = links.shape[1]
        links[fresh] = self._diverse(points, fresh, options, degree)
        row, column = np.nonzero(links[fresh] >= 0)
        target, source = links[fresh[row], column], fresh[row]
        # Old and new links of the targets, each once.
        olds = np.unique(target)
        old_row, old_column = np.nonzero(links[olds] >= 0)
        n = len(points)
        pair = np.unique(np.concatenate([target * n + source, olds[old_row] * n + links[olds[old_row], old_column]]))
        node, other = np.divmod(pair, n)
        nodes, begin, row, size = np.unique(node, return_index=True, return_inverse=True, return_counts=True)
        table = np.full((len(nodes), max(degree, int(size.max(initial=0)))), -1, dtype=np.int64)
        table[row, np.arange(len(node)) - begin[row]] = other
        fits = size <= degree
        links[nodes[fits]] = table[fits, :degree]
        if not fits.all():
            links[nodes[~fits]] = self._diverse(points, nodes[~fits], table[~fits], degree)

    @staticmethod
    def _reached(links: np.ndarray, start: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(links), dtype=bool)
        front = start
        while len(front):
            seen[front] = True
            front = np.unique(links[front])
            front = front[front >= 0]
            front = front[~seen[front]]
        return seen

    def _connect(self, points: np.ndarray, links: np.ndarray) -> np.ndarray:
        """Links with room for more into each node that no walk would reach, from the node before it that one does.

        A lost node is led to by its nearest own link that is reached, else by the first node.
        """
        while True:
            seen = self._reached(links, np.zeros(min(1, len(links)), dtype=np.int64))
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return links
            near = links[lost]
            known = (near >= 0) & seen[near]
            close = np.where(known, np.matmul(points[near], points[lost][:, :, None])[:, :, 0], -np.inf)
            owner = np.where(known.any(axis=1), near[np.arange(len(lost)), close.argmax(axis=1)], 0)
            order = np.argsort(owner, kind="stable")
            owner, lost = owner[order], lost[order]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            more = np.full((len(links), int(place.max()) + 1), -1, dtype=np.int64)
            more[owner, place] = lost
            links = np.concatenate([links, more], axis=1)

    def search(self, queries: np.ndarray, width: int, reach: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs within reach that walks over the bottom layer meet.

        own: the queries' numbers here, if they are nodes of this graph; walks then start there.
        A width of all nodes compares all of them.
        """
        if width >= len(self.unit):
            self.compared += len(queries) * len(self.unit)
            return np.nonzero(queries @ self.unit.T >= reach)
        entry = self._entries_down(queries) if own is None else own[:, None]
        walks = Walks(self.unit, self.layers[-1], queries, entry, width, reach)
        self.compared += walks.compared
        return walks.hits

    def _entries_down(self, queries: np.ndarray) -> np.ndarray:
        bottom = self.layers.pop()
        try:
            return self._entries(queries)
        finally:
            self.layers.append(bottom)


class Index:
    """A shard's graph with an audited beam."""

    def __init__(self, vectors: np.ndarray, threshold: float):
        self.threshold = threshold
        norm = np.linalg.norm(vectors, axis=1)
        self.graph = Graph((vectors / norm[:, None]).astype(np.float32))
        self.place = np.empty(len(vectors), dtype=np.int64)
        self.place[self.graph.order] = np.arange(len(vectors))
        self.vectors, self.norm = vectors[self.graph.order], norm[self.graph.order]
        #: Beam and audited recall of queries by own nodes and by those of other shards.
        self.width = {True: BEAM, False: BEAM}
        self.recall = {True: 1.0, False: 1.0}

    def audit(self, unit: np.ndarray, own: bool) -> None:
        """Double the beam until sampled queries' links are found; a node's hit on itself doesn't count."""
        n, reach = len(self.vectors), self.threshold - _SLACK
        some = np.unique(np.linspace(0, len(unit) - 1, min(len(unit), AUDIT)).astype(int))
        true = unit[some] @ self.graph.unit.T >= reach
        place = self.place[some] if own else None
        if own:
            true[np.arange(len(some)), place] = False
        if not true.any():
            return
        while True:
            query, node = self.graph.search(unit[some], self.width[own], reach, place)
            self.recall[own] = float(true[query, node].sum() / true.sum())
            if self.recall[own] >= RECALL or self.width[own] >= n:
                return
            # Walks as wide as this cost more than all comparisons, and these miss nothing.
            self.width[own] = n if self.width[own] > n // 64 else 2 * self.width[own]

    def links(self, vectors: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all links found, verified in double precision; own: vectors are the shard's, in its order."""
        norm = np.linalg.norm(vectors, axis=1)
        unit = (vectors / norm[:, None]).astype(np.float32)
        self.audit(unit, own)
        rows, columns = [], []
        for at in range(0, len(unit), 512):
            place = self.place[at : at + 512] if own else None
            row, column = self.graph.search(unit[at : at + 512], self.width[own], self.threshold - _SLACK, place)
            row = row + at
            exact = np.empty(len(row))
            for lo in range(0, len(row), 1 << 15):
                r, c = row[lo : lo + (1 << 15)], column[lo : lo + (1 << 15)]
                exact[lo : lo + (1 << 15)] = np.einsum("ij,ij->i", vectors[r], self.vectors[c]) / (norm[r] * self.norm[c])
            good = exact >= self.threshold
            rows.append(row[good])
            columns.append(self.graph.order[column[good]])
        return np.concatenate(rows), np.concatenate(columns)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of n nodes is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _link(sent: DataFrame, threshold: float) -> DataFrame:
    """(node, n, root) for the nodes with links between an index and what asks it.

    Rows of a task come by (label, salt): first the index's own nodes, then those of one shard
    after another.  An index is built once and only it and one asking shard are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names, copies = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                mine = batch.column("nodes")[i].values
                asking, numbers = mine.field("rep").to_numpy(), mine.field("copies").to_numpy()
                vectors = matrix(mine.field("vector"), np.float64)
                if batch.column("asks")[i].as_py():
                    a, b = index.links(vectors, False)
                    a = a + len(names)
                    all_names, all_copies = np.concatenate([names, asking]), np.concatenate([copies, numbers])
                else:
                    index, names, copies = Index(vectors, threshold), asking, numbers
                    a, b = index.links(vectors, True)
                    use = a != b
                    # Either end may have found the link; it counts for both.
                    pair = np.unique(np.stack([np.minimum(a[use], b[use]), np.maximum(a[use], b[use])]), axis=1)
                    a, b = pair[0], pair[1]
                    all_names, all_copies = names, copies
                n = np.bincount(a, weights=all_copies[b], minlength=len(all_names)) + np.bincount(b, weights=all_copies[a], minlength=len(all_names))
                order = np.argsort(all_names)
                place = np.empty(len(order), dtype=np.int64)
                place[order] = np.arange(len(order))
                root = all_names[order][_roots(len(order), place[a], place[b])[place]]
                some = np.flatnonzero(n > 0)
                yield pa.RecordBatch.from_arrays([pa.array(all_names[some]), pa.array(n[some].astype(np.int64)), pa.array(root[some])], names=["node", "n", "root"])

    return sent.select("asks", "nodes").mapInArrow(run, "node long, n long, root long")


def near_embeddings(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Only rows of one label are compared.  Null labels, and vectors that are null, zero,
    hold null or non-finite components or have another than the most frequent length,
    link with nothing: 0 links, a component of their own, kept.  Rows that repeat an id
    count as rows of their own for n_links and share a component.  Rows without an id
    have a null component and are kept.
    """
    scratch = Scratch(vectors.sparkSession, "hnsw")
    raw = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.when(usable(raw), F.transform(raw, lambda x: x.cast("double"))).alias("vector"))
    fit = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.exists("vector", lambda x: x != 0))
    length = common_length(fit, "vector")
    fit = fit.where(F.size("vector") == length).withColumn("name", F.struct("label", "vector"))
    nodes = fit.groupBy("name").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    nodes = scratch.keep(nodes.select("rep", "copies", "name.label", "name.vector"), "nodes")
    shards = salted(nodes, "label", "rep", SHARD).groupBy("label", "salt").agg(F.first("salts").alias("salts"), F.collect_list(F.struct("rep", "copies", "vector")).alias("nodes"))
    shards = scratch.keep(shards, "shards")
    # Shard s asks the indexes of the next half of its label's shards, in a circle, so each pair
    # of shards meets once and all indexes are asked alike.  An index is sent once.
    ahead = F.explode(F.expr("sequence(1, salts div 2)"))
    asking = shards.where("salts > 1").select("label", F.col("salt").alias("other"), "salts", "nodes", ahead.alias("ahead")).where("2 * ahead < salts or other < ahead")
    asking = asking.select("label", ((F.col("other") + F.col("ahead")) % F.col("salts")).cast("int").alias("salt"), "other", F.lit(True).alias("asks"), "nodes")
    sent = shards.select("label", "salt", F.lit(-1).alias("other"), F.lit(False).alias("asks"), "nodes").unionByName(asking)
    sent = sent.repartition("label", "salt").sortWithinPartitions("label", "salt", "asks", "other")
    found = scratch.keep(_link(sent, threshold), "links")

    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    united = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    known = nodes.join(counted, nodes["rep"] == counted["node"], "left").drop("node").join(united, nodes["rep"] == united["node"], "left").select("label", "vector", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    linked = fit.select("id", "label", "vector").join(known, ["label", "vector"]).select("id", "n_links", "component")
    # Rows that repeat an id meet in the smallest component.
    rest = rows.where(~(F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.exists("vector", lambda x: x != 0) & (F.size("vector") == length), F.lit(False))))
    out = linked.unionByName(rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
