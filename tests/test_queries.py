"""Every registered query runs; those with SQL return the same rows."""

import pytest

from episodeframe.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import bags, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, con):
    df = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        assert df.count() > 0
        return
    have, want, _ = bags(df, con, ORACLE_SQL[name])
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
