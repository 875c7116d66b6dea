"""Operator 4: near-duplicate documents by min-max hashing.

One pass names every shingle and folds a text's set into a signature that keeps both
the smallest and the largest value under each permutation, so half as many hash
evaluations give as many signature values; bands of these values are the join keys.

Texts with equal sets are folded into one node first, so groups of exact copies cost
one row.  A bucket is a band key with its nodes.  Each node is checked, on full sets, against
the smallest node of each of its buckets, its hub; that joins most groups of near copies.
Only where a bucket's other nodes are then not all of one component, are those outside the
hub's component compared with it and with one another, in blocks of bounded size.  A pair
that meets in no bucket is never compared, so a chain of loosely similar documents costs what
its buckets hold.  Tasks return at most one link for each node and group, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.components import connected_components, spread
from scriptorium.llm.wordhash import U64, Words, grams, mix, rows
from scriptorium.plans.scratch import Scratch

#: Values in a band, bands.  A pair at similarity 0.8 misses all bands with probability 5e-6.
BAND_ROWS, BANDS = 6, 40
#: Nodes and set members that a block of a large bucket has at most, if no node alone has more.
BLOCK_NODES, BLOCK_MEMBERS = 256, 1 << 20


class _Permutations:
    def __init__(self, count: int, seed: int = 4):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.flip = rng.integers(0, 1 << 63, (count, 1), dtype=np.uint64)
        self.factor = rng.integers(0, 1 << 63, (count, 1), dtype=np.uint64) * U64(2) + U64(1)

    def signature(self, members: np.ndarray) -> np.ndarray:
        """Minima of all permutations, then maxima."""
        low = high = None
        for at in range(0, len(members), 8192):
            values = (members[None, at : at + 8192] ^ self.flip) * self.factor
            low = values.min(axis=1) if low is None else np.minimum(low, values.min(axis=1))
            high = values.max(axis=1) if high is None else np.maximum(high, values.max(axis=1))
        return np.concatenate([low, high])


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle names of each text; fewer than k words make one shingle."""
    words = Words(texts, lower=True)
    names = words.names[0]
    whole = grams(names, k) if len(names) else names
    for first, n in zip(words.first.tolist(), words.counts.tolist()):
        if n >= k:
            yield np.unique(whole[first : first + n - k + 1])
        elif n:
            yield grams(names[first : first + n], n)[:1]
        else:
            yield names[:0]


def signatures(docs: DataFrame, k: int, band_rows: int = BAND_ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, set_high, set_low, bands): a name of the whole set and its bands."""
    if band_rows * bands % 2:
        raise ValueError("a band layout needs an even number of values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutations = _Permutations(band_rows * bands // 2)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            ids, sizes, high, low, keys = [], [], [], [], []
            for part, texts in rows(batch):
                ids += part
                for members in shingle_sets(texts, k):
                    sizes.append(len(members))
                    high.append(int(mix(members).sum(dtype=np.uint64).astype(np.int64)))
                    low.append(int(mix(members ^ U64(0x5DEECE66D1234567)).sum(dtype=np.uint64).astype(np.int64)))
                    if len(members):
                        band = salt.copy()
                        for column in permutations.signature(members).reshape(bands, band_rows).T:
                            band = mix(band * U64(0x9E3779B97F4A7C15) + column)
                        keys.append(band.astype(np.int64).tolist())
                    else:
                        keys.append([])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_high", "set_low", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_high long, set_low long, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, members binary) of rows of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in rows(batch):
                members = [m.tobytes() for m in shingle_sets(texts, k)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(members, pa.binary())], names=["doc_id", "members"])

    return docs.mapInArrow(run, "doc_id long, members binary")


def _stars(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between each row's hub b and its nodes a; an id may have several sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for hub, group in zip(batch.column("hub").to_pylist(), batch.column("nodes")):
                ids = group.values.field("doc_id").to_pylist()
                sets = [np.frombuffer(m.as_buffer(), dtype=np.uint64) for m in group.values.field("members")]
                mine = [s for i, s in zip(ids, sets) if i == hub]
                for i, s in zip(ids, sets):
                    if i != hub and any(_alike(h, s, percent) for h in mine):
                        a.append(i)
                        b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.select("hub", "nodes").mapInArrow(run, "a long, b long")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; columns that one set alone has are left out."""
    sizes = [len(s) for s in sets]
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column) > 1
    use = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[use]], owner[use]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = 4096
    bounds = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi > lo:
            block = np.zeros((len(sets), width), dtype=np.float32)
            block[owner[lo:hi], column[lo:hi] % width] = 1
            out += block @ block.T
    return out


def united(sets: list[np.ndarray], sides: np.ndarray | None, percent: int) -> np.ndarray:
    """For each set the index of the first set it is connected with.

    sides: with two kinds of sets, pairs of one kind are left to other tasks.
    """
    n = len(sets)
    label = np.arange(n)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        linked = both and (sides is None or sides[0] != sides[1]) and 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both)
        return np.array([0, 0]) if linked else label
    size = np.array([len(s) for s in sets], dtype=np.float64)
    both = _overlaps(sets)
    near = (both > 0) & (100 * both >= percent * (size[:, None] + size[None, :] - both))
    if sides is not None:
        near &= sides[:, None] != sides[None, :]
    np.fill_diagonal(near, True)
    while True:
        after = np.where(near, label[None, :], n).min(axis=1)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _verify(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found within each row's group of (doc_id, block, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for cross, group in zip(batch.column("cross"), batch.column("nodes")):
                nodes = sorted(((x["doc_id"].as_py(), x["block"].as_py(), x["members"].as_buffer()) for x in group.values), key=lambda x: x[:2])
                sets = [np.frombuffer(m, dtype=np.uint64) for _, _, m in nodes]
                if len(sets) < 2:
                    continue
                sides = np.array([x[1] for x in nodes]) if cross.as_py() else None
                label = united(sets, sides, percent)
                for i in np.flatnonzero(label != np.arange(len(label))).tolist():
                    a.append(nodes[i][0])
                    b.append(nodes[int(label[i])][0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def _blocks(nodes: str, members: str):
    """Blocks that keep a group of so many nodes and set members small; none without nodes."""
    return F.greatest(F.ceil(F.col(nodes) / BLOCK_NODES), F.least(nodes, F.ceil(F.col(members) / BLOCK_MEMBERS))).cast("int")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Documents are linked from ``percent`` similarity of their full shingle sets on; a
    component is named by its smallest doc_id, which is the one kept.  Null, empty and
    blank texts have no shingles and link with nothing.  Rows that repeat a doc_id are
    one node, linked by any of their texts.  Rows without a doc_id keep their row, with
    a null component, and are kept.  Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.keep(signatures(source, k), "signatures")

    linked = signed.where("n_shingles > 0 and doc_id is not null")
    named = linked.withColumn("set_id", F.struct("n_shingles", "set_high", "set_low"))
    leads = named.groupBy("set_id", F.xxhash64("set_high", "set_low").alias("_spread")).agg(F.min(F.struct("doc_id", "bands")).alias("lead"))
    nodes = scratch.keep(leads.select("set_id", "lead.doc_id", "lead.bands", F.col("set_id.n_shingles").alias("n")), "nodes")

    # A bucket, which is a band key of two nodes or more, has its smallest node as hub.
    keyed = nodes.select("doc_id", "n", F.explode("bands").alias("key"))
    hubs = spread(keyed, "key", F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").drop("last")
    met = scratch.keep(keyed.join(hubs, "key"), "buckets")
    sets = scratch.keep(_sets(source.join(met.select("doc_id").distinct(), "doc_id"), k), "sets")

    # Each node is checked against the hubs of its buckets; most groups of near copies are one star.
    arms = met.where("doc_id > hub").groupBy("doc_id", "hub").agg(F.max("n").alias("n"))
    arms = scratch.keep(arms, "arms")
    size = spread(arms, "hub", F.count("*").alias("nodes"), F.sum("n").alias("members")).select("hub", _blocks("nodes", "members").alias("blocks"))
    places = arms.select("doc_id", "hub").join(size, "hub").select("doc_id", "hub", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"))
    own = size.select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    stars = sets.join(places.unionByName(own), "doc_id").groupBy("hub", "block").agg(F.collect_list(F.struct("doc_id", "members")).alias("nodes"))
    linked_arms = scratch.keep(_stars(stars, percent), "stars")
    known = scratch.keep(connected_components(linked_arms, scratch), "known")

    # What stars leave open: in a bucket, nodes beside the hub that are not all in one component.
    of_node = known.select(F.col("node").alias("doc_id"), F.col("component").alias("own"))
    of_hub = known.select(F.col("node").alias("hub"), F.col("component").alias("theirs"))
    beside = met.where("doc_id > hub").join(of_node, "doc_id", "left").join(of_hub, "hub", "left")
    beside = scratch.keep(beside.select("key", "doc_id", "n", F.coalesce("own", "doc_id").alias("own"), (F.coalesce("own", "doc_id") == F.coalesce("theirs", "hub")).alias("settled")), "beside")
    mark = F.xxhash64("doc_id")
    split = spread(
        beside, "key", F.min("own").alias("least"), F.max("own").alias("most"), F.bit_xor(mark).alias("x"), F.sum(mark.bitwiseAND(F.lit((1 << 40) - 1))).alias("s"),
        *(F.sum(F.when(F.col("settled") == side, value).otherwise(0)).alias(name) for side, name, value in ((True, "d_nodes", F.lit(1)), (False, "o_nodes", F.lit(1)), (True, "d_members", F.col("n")), (False, "o_members", F.col("n")))),
    ).where("least < most")
    # Buckets of the same nodes count once.
    split = split.groupBy("x", "s", "d_nodes", "o_nodes").agg(F.min(F.struct("key", "d_members", "o_members")).alias("b"))
    split = split.select("b.key", _blocks("d_nodes", "b.d_members").alias("d"), _blocks("o_nodes", "b.o_members").alias("o"))
    opened = beside.join(split, "key")
    upto = lambda c: F.expr(f"if({c} > 0, sequence(0, {c} - 1), cast(array() as array<int>))")
    block = F.pmod(F.xxhash64("doc_id"), F.when(F.col("settled"), F.col("d")).otherwise(F.col("o"))).cast("int")
    placed = opened.withColumn("block", block)
    # The hub's component is not compared with itself again: others meet it, and one another.
    meets = (
        placed.where("settled").select("key", "doc_id", F.lit(-1).alias("side"), F.lit(True).alias("across"), F.col("block").alias("i"), F.explode(upto("o")).alias("j"))
        .unionByName(placed.where("not settled").select("key", "doc_id", F.lit(0).alias("side"), F.lit(True).alias("across"), F.explode(upto("d")).alias("i"), F.col("block").alias("j")))
        .unionByName(
            placed.where("not settled").withColumn("other", F.explode(upto("o")))
            .select("key", "doc_id", F.col("block").alias("side"), F.lit(False).alias("across"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        )
    )
    groups = (
        sets.join(meets, "doc_id").groupBy("key", "across", "i", "j")
        .agg(F.collect_list(F.struct("doc_id", F.col("side").alias("block"), "members")).alias("nodes"))
        .select((F.col("across") | (F.col("i") != F.col("j"))).alias("cross"), "nodes")
    )
    links = scratch.keep(linked_arms.unionByName(_verify(groups, percent)), "links")

    # Equal sets of different ids are links as well; then components, and back to all rows.
    members = linked.select("doc_id", F.struct("n_shingles", "set_high", "set_low").alias("set_id"))
    leads = nodes.select("set_id", F.col("doc_id").alias("lead"))
    copies = members.join(leads, "set_id").where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    found = connected_components(links.unionByName(copies), scratch)
    out = signed.select("doc_id", "n_shingles").join(found, F.col("doc_id") == found["node"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
