"""Operators 4, 5 and 10 against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
from hard_rows import documents, empty

from scriptorium.llm import hnsw, minhash, recompress

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sets(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def _components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def _variants(rng, n):
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 120))] for _ in range(n // 6 + 1)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        out.append(" ".join(w))
    return out


def test_minhash_against_brute_force(spark):
    rows = list(enumerate(_variants(random.Random(4), 240)))
    for k in (4, 5):
        sets = {i: _sets(t, k) for i, t in rows}
        want = _components(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and bool(sets[a]))
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, 80).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_minhash_large_cluster_is_split(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_NODES", 16)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(90):
        w = list(words)
        w[3 * i] = f"v{i}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_minhash_chain_of_loose_copies(spark):
    """Each text shares half of its words with the next: band hits chain them, and none is linked."""
    step, width = 12, 36
    rows = [(i, " ".join(f"w{i * step + j}" for j in range(width))) for i in range(400)]
    rows += [(400 + i, t + " end") for i, t in rows[:40]]
    sets = {i: _sets(t, 4) for i, t in rows}
    want = _components(list(sets), lambda a, b: abs(a - b) in (0, 1, 399, 400, 401) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) == 400


def test_minhash_hard_rows(spark):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(documents(spark)).collect()]
    assert len(got) == documents(spark).count()
    by_id = {}
    for i, n, c, kept in got:
        by_id.setdefault(i, set()).add((c, kept))
    assert by_id[5] == {(4, False)} and by_id[11] == {(4, False)} and by_id[7] == {(6, False)} and by_id[9] == {(8, False)}
    assert by_id[None] == {(None, True)} and by_id[1] == {(1, True)} and by_id[2] == {(2, True)} and by_id[3] == {(3, True)}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def _spoilt(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1),
            (9, [1.0, 0.0], None), (10, [1.0], 1), (11, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [0.99, 0.15], 1), (13, [], 1)]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, node long, n long, rep long")


def test_hnsw_hard_rows(spark):
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_embeddings(_spoilt(spark), 0.98).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[11] == (3, 1, False) and got[12] == (3, 1, False)
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 13):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True)
    assert hnsw.near_embeddings(_spoilt(spark).limit(0), 0.98).count() == 0


def test_hnsw_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 150)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    points = np.repeat(base, 12, axis=0) + 0.08 * rng.normal(size=(720, 16)) * rng.random((720, 1))
    rows = [(i, [float(x) for x in p.astype(np.float32)], int(i % 2)) for i, p in enumerate(points)]
    got = {r["vec_id"]: r for r in hnsw.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.98).collect()}
    unit = points.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (np.arange(720)[:, None] % 2 == np.arange(720)[None, :] % 2)
    np.fill_diagonal(near, False)
    found, true = sum(r["n_links"] for r in got.values()), near.sum()
    assert 0.99 * true <= found <= true
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(720))


def _substring(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for a in range(len(w) - window + 1):
                key = tuple(w[a : a + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        cut = [False] * len(w)
        for a in range(len(w) - window + 1):
            if i is not None and first[tuple(w[a : a + window])] < i:
                cut[a : a + window] = [True] * window
        kept = [x for x, c in zip(w, cut) if not c]
        out.append((i, len(w), sum(cut), " ".join(kept)))
    return sorted(out, key=repr)


def _got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=repr)


def test_substring_against_brute_force(spark):
    rng = random.Random(10)
    for window, letters in ((50, 500), (20, 3), (8, 40), (50, 2)):
        passages = [[f"p{rng.randrange(letters)}" for _ in range(rng.randrange(window // 2, 3 * window))] for _ in range(8)]
        rows = []
        for i in rng.sample(range(1000), 60):
            w = []
            for _ in range(rng.randrange(6)):
                w += rng.choice(passages) if rng.random() < 0.6 else [f"q{rng.randrange(letters)}" for _ in range(rng.randrange(90))]
                if rng.random() < 0.2:
                    w += ["same"] * rng.randrange(3 * window)
            rows.append((i, " ".join(w)))
        got = recompress.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window)
        assert _got(got) == _substring(rows, window), (window, letters)


def test_substring_hard_rows(spark):
    docs = documents(spark)
    out = recompress.substring_dedup(docs, 50)
    assert set(docs.columns) <= set(out.columns)
    assert _got(out) == _substring([(r["doc_id"], r["text"]) for r in docs.collect()], 50)
    assert recompress.substring_dedup(empty(spark), 50).count() == 0


def test_symbols_agree_inside_equal_passages():
    rng = np.random.default_rng(1)
    passage = rng.integers(1, 1 << 62, 400, dtype=np.uint64)
    edge = recompress.margin(2)
    sides = []
    for n in (3, 77):
        names = np.concatenate([rng.integers(1, 1 << 62, n, dtype=np.uint64), passage, rng.integers(1, 1 << 62, n, dtype=np.uint64)])
        symbol, start, length = recompress.recompress(names, np.zeros(len(names), dtype=np.int64), 2)
        inner = (start >= n + edge) & (start + length <= n + 400 - edge)
        sides.append(list(zip(symbol[inner].tolist(), (start[inner] - n).tolist())))
    assert sides[0] == sides[1] and len(sides[0]) > 50
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_hnsw_compares_less_than_brute_force():
    """On one shard of clusters the graph finds the links with a fraction of the comparisons, self-hits not counted."""
    rng = np.random.default_rng(6)
    points = np.repeat(rng.normal(size=(400, 32)), 10, axis=0) + 0.08 * rng.normal(size=(4000, 32))
    index = hnsw.Index(points, 0.98)
    a, b = index.links(points, True)
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    true = (unit @ unit.T >= 0.98).sum() - 4000
    assert (a != b).sum() >= 0.99 * true > 1000
    assert index.graph.compared < 4000 * 4000 / 4
    c, d = index.links(points[:50] + 1e-9, False)
    assert len(c) >= 0.99 * (unit[:50] @ unit.T >= 0.98).sum()
