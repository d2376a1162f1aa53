"""Queries of the training-data operators that have SQL return its rows."""

import pytest

from episodeframe.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import bags, connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(name, spark):
    have, want, _ = bags(QUERIES[name](spark, SF), connection(SF), ORACLE_SQL[name])
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
