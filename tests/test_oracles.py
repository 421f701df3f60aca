"""Every core query against its DuckDB text on the smallest tables."""

from pathlib import Path

import pytest
from oracle import same

from quern import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
