"""SQL of the operators that SQL can express, independent of the operators' own methods."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
#: (node, least node reachable) from the pairs p(a, b), which hold both directions.
_REACH = """reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
least AS (SELECT a, min(least(a, b)) AS root FROM reach GROUP BY 1)"""

TOP_K = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE {_FINITE}
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

MINHASH = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM w)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), p AS MATERIALIZED (
  SELECT i.a, i.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) i
  JOIN n na ON i.a = na.doc_id JOIN n nb ON i.b = nb.doc_id WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.root, d.doc_id) AS component_id, coalesce(l.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least l ON d.doc_id = l.a"""

HNSW = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), {_REACH}, n AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(l.root, e.vec_id) AS component_id, coalesce(l.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN least l ON e.vec_id = l.a"""

_RULES = "(VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) r(rhost, rpath, verdict)"

URL_FILTER = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), s AS (
  SELECT page_id, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref)='))), '&') AS query FROM u
), k AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key FROM s
), listed AS (SELECT DISTINCT key FROM k WHERE regexp_matches(host, '(^|\.)(spam|casino)-') AND key IS NOT NULL
), fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM k JOIN {_RULES} ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1
)
SELECT k.page_id, host, path, rule, coalesce(verdict, CASE WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, rule IS NULL AND listed.key IS NOT NULL AS listed
FROM k LEFT JOIN fit ON k.page_id = fit.page_id LEFT JOIN listed ON k.key = listed.key"""


def _spans(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """SELECT of (doc_id, owner, repo, kind, place, start, stop, value) for one kind."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, owner, repo, '{kind}' AS kind, {place} AS place, start, start + length(m[i]) AS stop, v[i] AS value FROM (
      SELECT *, coalesce(list_sum(list_transform(g[1 : i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS start
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, owner, repo, string_split_regex(text, {p}) AS g, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v FROM d)))
    WHERE length(v[i]) >= {least}"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(source, 'repo:text:' || sha256(coalesce(text, ''))) AS owner, sha256(coalesce(text, '')) AS repo, coalesce(text, '') AS text FROM documents
), base AS MATERIALIZED ({_spans("assign", 0, _ASSIGN, 1, 6)}
  UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_spans("hex", 2, "[0-9a-f]{24,}", 0, 24)}
), tok AS MATERIALIZED ({_spans("token", 3, "[A-Za-z0-9_-]{20,}", 0, 20)}
), free AS (
  SELECT * FROM tok t WHERE regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.start < t.stop AND t.start < b.stop)
), every AS (SELECT * FROM base UNION ALL SELECT * FROM free
), own AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT owner) < 3 AND count(DISTINCT repo) < 20 AS lives FROM every GROUP BY 1
), kept AS (
  SELECT e.*, lives, kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR) AS span FROM every e JOIN own USING (value) WHERE kind <> 'token' OR lives
), agg AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    count(*) FILTER (kind = 'token') AS n_added, count(*) FILTER (lives) AS live,
    string_agg(span, ',' ORDER BY start, place) FILTER (kind <> 'token') AS base, string_agg(span, ',' ORDER BY start, place) AS spans FROM kept GROUP BY 1
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_added, 0) AS n_added, coalesce(live, 0) AS live,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN agg USING (doc_id)"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents
), i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), k AS MATERIALIZED (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i : i + 49], ' ')) END AS key FROM i
), f AS (SELECT key, min(doc_id) AS first FROM k WHERE key IS NOT NULL GROUP BY 1
), c AS (
  SELECT doc_id, i, word, max(CASE WHEN first < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS cut FROM k LEFT JOIN f USING (key)
), a AS (SELECT doc_id, sum(cut) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (cut = 0) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""

ORACLES = {
    "op2_cover_tree": TOP_K,
    "op4_minhash": MINHASH,
    "op5_hnsw": HNSW,
    "op8_url_filter": URL_FILTER,
    "op9_secrets": SECRETS,
    "op10_recompression": SUBSTRING,
}
