"""The registered queries of the ten operators against SQL, whole tables."""

import pytest
from oracle import difference

from scriptorium.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(spark, QUERIES[name], ORACLES[name], SF) == (False, [], [])


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
