"""Every registered query with an oracle equals its DuckDB SQL on sf0.001."""

import pytest

import __spark_entry__ as E
from spendlens.suite.compare import compare

from .conftest import SF_SMALL

ORACLES = E.oracle_sql()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, key):
    got = E.queries()[key](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLES[key]).df()
    diff = compare(got, want)
    assert diff is None, f"{key}: {diff}"
