"""Name -> (query, SQL) of the document operators."""

from __future__ import annotations

from scriptorium.catalog import cleaning, figure_audit, frontmatter, records, structure, visuals  # noqa: F401  each module registers its queries
from scriptorium.catalog.common import ORACLES, QUERIES

FLAGSHIP = "sections_outline"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
