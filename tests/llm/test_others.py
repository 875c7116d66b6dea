"""Operators 2, 6, 7, 8 and 9, and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hard_rows import documents, empty
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import cover_tree, langid, secrets_scan, sharding, url_filter
from scriptorium.llm.queries import RULES, op6_sharding, op7_langid
from scriptorium.sources.tables import table

SF = "/root/testdata/sf0.001"


def _top_k(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "SHARD", 64)
    monkeypatch.setattr(cover_tree, "LEAF", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 6))
    rows = [(i, [float(x) for x in np.float32(centres[i % 5] * (i % 3) + 0.1 * rng.normal(size=6))]) for i in range(700)]
    rows += [(i, rows[i % 7][1]) for i in range(700, 1000)]
    rows += [(2000, None), (2050, [float("nan")] * 6), (2100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, rows[0][1]), (2150, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = cover_tree.top_k(df, F.col("vec_id") % 50 == 0, 5)
    assert sorted(map(tuple, got.collect())) == _top_k(rows, 5)
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted(map(tuple, cover_tree.top_k(few, F.col("vec_id") % 50 == 0, 5).collect())) == _top_k([r for r in rows if r[0] in (0, 1, 2)], 5)
    assert cover_tree.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_cover_tree_law_and_pruning():
    """Children cover at half the radius with separated centres; on a clustered table most pairs are pruned, none wrongly."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(24, 8)) * 400
    points = np.rint(np.repeat(centres, 80, axis=0) + rng.normal(size=(1920, 8)) * 12)
    tree = cover_tree.CoverTree(points)
    assert tree.children[0] and sorted(np.concatenate([m for m, c in zip(tree.members, tree.children) if not c]).tolist()) == list(range(1920))
    for node, children in enumerate(tree.children):
        at = points[[tree.centre[c] for c in children]]
        apart = np.linalg.norm(at[:, None] - at[None], axis=2)[~np.eye(len(at), dtype=bool)]
        assert (apart > tree.radius[node] / 2).all() and all(tree.radius[c] <= tree.radius[node] / 2 for c in children)
    queries = points[::50]
    best = cover_tree.Best(len(queries), 5)
    cover_tree.dual_search(cover_tree.CoverTree(queries), tree, np.arange(1920), best)
    score = queries @ points.T
    for i, row in enumerate(score):
        order = np.lexsort((np.arange(1920), -row))[:5]
        assert best.id[i].tolist() == order.tolist()
    assert best.scored < len(queries) * 1920 / 2


def _sharded(rows, docs, shards=16):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
    by_shard = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        by_shard[r["shard"]].append(r["slot"])
    counts = [len(by_shard[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(by_shard) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())


def test_shards(spark):
    docs = table(spark, SF, "documents")
    rows = op6_sharding(spark, SF).collect()
    _sharded(rows, docs.collect())
    spots = defaultdict(set)
    for r in rows:
        spots[r["text_group"]].add(r["shard"])
    # Groups that fit a shard's quota stay together.
    assert sum(len(s) > 1 for s in spots.values()) <= 4


def test_shards_hard_rows(spark):
    _sharded(sharding.shard_documents(documents(spark)).collect(), documents(spark).collect())
    hot = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(500)], "doc_id long, text string")
    _sharded(sharding.shard_documents(hot).collect(), hot.collect())
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_languages_held_out(spark):
    docs = {r["doc_id"]: r for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = op7_langid(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    judged = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in judged)
    assert right >= 0.95 * len(judged), (right, len(judged))


def test_languages_hard_rows(spark):
    rows = langid.identify(documents(spark)).collect()
    assert len(rows) == documents(spark).count()
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert r["key"] in ("k", None)
    assert langid.identify(empty(spark)).count() == 0
    nothing_known = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(nothing_known).collect()} == {"und"}


def test_language_prediction_ignores_labels(spark):
    docs = table(spark, SF, "documents")
    model = langid.train(docs)

    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(other, model).collect()} == plain


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("https://Example.ORG/es/a?x#y", "example.org", "/es/a", "example.org/es/", "block"),
    ("http://sub.example.org/en/12", "sub.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://a.com/de/", "a.com", "/de/", "com/de/", "block"),
    ("http://a.com", "a.com", "", None, "allow"),
    ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("://", "", "", None, "allow"), ("http://bad.net/x/?utm_source=1", "bad.net", "/x/", None, "block"),
    ("http://www.bad.net/x", "www.bad.net", "/x", None, "block"), ("http://bad.net/xy", "bad.net", "/xy", None, "allow"),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "k", True), (1, url, None, None)], "page_id long, url string, key string, hit boolean")
    listed = spark.createDataFrame([("https://bad.net/x/",), (None,), ("junk",)], "url string")
    rows = url_filter.filter_urls(pages, listed, RULES).collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == [(host, path, rule, verdict)] * 2


def test_url_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a")], "page_id long, url string")
    assert url_filter.filter_urls(pages, pages.limit(0).select("url"), RULES).collect()[0]["verdict"] == "allow"
    assert url_filter.filter_urls(pages.limit(0), pages.select("url"), RULES).count() == 0


def test_bloom_filter_never_decides_alone(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", 64)
    urls = spark.range(5000).selectExpr("id AS page_id", "concat('http://h', id % 50, '.net/', id) AS url")
    rows = url_filter.filter_urls(urls, urls.where("page_id % 2 = 0").select("url"), []).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 2 == 0) for r in rows)


def test_secrets(spark):
    token = "Zx8kQ2mN5vB7cR1tY4wP9"
    rows = [
        (1, "password = hunter22 and API-KEY: no, api_key='abcdef123'", "a"), (2, "AKIA" + "A" * 16 + " AKIAB", "a"), (3, "x " + "0a" * 12 + " " + "f" * 23, "b"),
        (4, f"value {token} end", "a"), (5, "é😀 secret:shared99", "a"), (6, "token=shared99", "b"), (7, "token=shared99", "c"), (8, None, "a"), (9, "", None), (10, "password: short", None),
        (11, "Password=tiny secret=enough1", "a"), (12, "password = sécret", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets_scan.digest(secrets_scan.scan(docs)).collect()}
    assert got[1]["spans"] == "assign:0:19,assign:37:55" and got[1]["n_assign"] == 2
    assert got[2]["spans"] == "access:0:20" and got[3]["spans"] == "hex:2:26" and got[4]["spans"] == "token:6:27"
    assert got[5]["spans"] == "assign:3:18" and got[5]["live"] == 0 and got[1]["live"] == 2
    assert got[8]["spans"] == got[9]["spans"] == "" and got[10]["n_assign"] == 0 and got[11]["spans"] == "assign:14:28" and got[12]["n_assign"] == 0
    clean = {r["doc_id"]: r["text"] for r in secrets_scan.redact(docs).collect()}
    assert clean[1] == "[secret] and API-KEY: no, [secret]'" and clean[5] == rows[4][1] and clean[4] == "value [secret] end" and clean[8] is None


def test_secrets_hard_rows(spark):
    docs = documents(spark)
    assert secrets_scan.digest(secrets_scan.scan(docs)).count() == docs.count()
    assert secrets_scan.redact(docs).columns == docs.columns and secrets_scan.redact(docs).count() == docs.count()
    assert secrets_scan.digest(secrets_scan.scan(empty(spark))).count() == 0


def test_pipeline_stages(spark):
    from test_near_copies import _components, _sets, _substring
    from test_packing import _check

    docs = table(spark, SF, "documents")
    names = dict(corpus_pipeline.STAGES)
    assert list(names) == ["language_id", "minhash_dedup", "substring_dedup", "secret_scan", "best_fit_packing"]
    first = names["language_id"](spark, docs, SF)
    assert first.columns == docs.columns
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in first.collect()}
    assert gone == {r["doc_id"] for r in docs.collect() if not any(c.isalpha() for c in r["text"] or "")}
    second = names["minhash_dedup"](spark, first, SF)
    sets = {r["doc_id"]: _sets(r["text"], 5) for r in first.collect()}
    root = _components(list(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert {r["doc_id"] for r in second.collect()} == {i for i, r in root.items() if i == r} and second.columns == docs.columns
    third = names["substring_dedup"](spark, second, SF)
    before = {r["doc_id"]: r["text"] for r in second.collect()}
    cut = {i: (n, g, k) for i, n, g, k in _substring(list(before.items()), 50)}
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in third.collect()}
    assert after == {i: (t := k if g else before[i], len(t)) for i, (n, g, k) in cut.items() if not g or g < n} and third.columns == docs.columns
    fourth = names["secret_scan"](spark, third, SF)
    assert fourth.columns == docs.columns and {r["doc_id"] for r in fourth.collect()} == set(after)
    _check(names["best_fit_packing"](spark, fourth, SF).collect(), fourth.collect())


def _others(df, names):
    """Values of the columns that no stage may change, for each row."""
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_pipeline_hard_rows(spark):
    for docs in (documents(spark), empty(spark)):
        fixed = [c for c in docs.columns if c not in ("text", "n_chars")]
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "best_fit_packing":
                assert out.columns == docs.columns, name
                assert not _others(out, fixed) - _others(docs, fixed), name
            docs = out
        docs.count()
