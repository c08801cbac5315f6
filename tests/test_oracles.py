"""Every registered query with an oracle matches DuckDB on sf0.001
(row count, column names, order-insensitive values)."""

import pytest

import __spark_entry__ as entry
from scripts.check_oracles import digest
from tests.conftest import SF_SMALL

ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "lag_12m" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.execute(ORACLES[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]
