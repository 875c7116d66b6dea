"""Registration, and the SQL that restates the rule behind the synthetic papers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: One row for each line i of each document (paper_id as text).
LINES = """
WITH ln AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS paper_id, i, string_split(text, chr(10))[i + 1] AS body
  FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
)"""

#: Headings by line, their parents and paths.
TREE = LINES + """, hd AS (
  SELECT doc_id, paper_id, i, CASE WHEN i % 5 = 0 THEN 0 WHEN i % 5 = 3 THEN 1 ELSE 2 END AS level,
    (CASE WHEN i % 5 = 0 THEN 'S' WHEN i % 5 = 3 THEN 'B' ELSE 'C' END) || paper_id || 'x' || CAST(i AS VARCHAR) AS title
  FROM ln WHERE i % 5 IN (0, 3) OR i % 11 = 7
), up AS (
  SELECT *, max(CASE WHEN level = 0 THEN i END) OVER w AS l0, max(CASE WHEN level = 1 THEN i END) OVER w AS l1,
    lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nexti
  FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), pa AS (
  SELECT *, CASE WHEN level = 1 THEN l0 WHEN level = 2 THEN greatest(coalesce(l0, -1), coalesce(l1, -1)) END AS parent FROM up
), od AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, parent ORDER BY i) AS n,
    row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord FROM pa
), sec AS (
  SELECT a.doc_id, a.paper_id, a.i, a.level, a.title, a.n, a.ord, a.nexti,
    'sec:' || coalesce(CAST(c.n AS VARCHAR) || '.', '') || coalesce(CAST(b.n AS VARCHAR) || '.', '') || CAST(a.n AS VARCHAR) AS section_id,
    'sec:' || coalesce(CAST(c.n AS VARCHAR) || '.', '') || CAST(b.n AS VARCHAR) AS parent_id
  FROM od a LEFT JOIN od b ON a.doc_id = b.doc_id AND a.parent = b.i LEFT JOIN od c ON b.doc_id = c.doc_id AND b.parent = c.i
)"""

#: The section of each line; the appendix begins just before the heading of line 20.
PLACED = TREE + """, pl AS (
  SELECT l.*, s.section_id, s.ord, l.i >= 20 AS is_appendix
  FROM ln l JOIN sec s ON l.doc_id = s.doc_id AND l.i >= s.i AND (s.nexti IS NULL OR l.i < s.nexti)
), ct AS (
  SELECT doc_id, paper_id, i, section_id, ord, 1 AS pos, 'k' || CAST((7 * doc_id + i) % 97 AS VARCHAR) AS key FROM pl
  UNION ALL SELECT doc_id, paper_id, i, section_id, ord, 2, 'k' || CAST(i % 13 AS VARCHAR) FROM pl WHERE i % 3 = 0
  UNION ALL SELECT doc_id, paper_id, i, section_id, ord, 3, 'k' || CAST(i % 5 AS VARCHAR) FROM pl WHERE i % 6 = 2
)"""

#: Every entity of the papers.
ENTITIES = PLACED + """, en AS (
  SELECT *, 'figure' AS kind, 'fig:d' || paper_id || 'i' || CAST(i AS VARCHAR) AS entity_id FROM pl WHERE i % 4 = 1
  UNION ALL SELECT *, 'table', 'tab:d' || paper_id || 'i' || CAST(i AS VARCHAR) FROM pl WHERE i % 6 = 2
  UNION ALL SELECT *, 'equation', 'eq:d' || paper_id || 'i' || CAST(i AS VARCHAR) FROM pl WHERE i % 7 = 3
  UNION ALL SELECT *, 'listing', 'lst:' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS VARCHAR) FROM pl WHERE i % 9 = 4
  UNION ALL SELECT *, 'algorithm', 'alg:' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS VARCHAR) FROM pl WHERE i % 10 = 6
)"""

#: Text that inline escapes give back.
PLAIN = "translate(body, '{}~^' || chr(92), '     ')"
