"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import decimal
import math

import duckdb
import pytest

from tallgrass import queries
from tests.conftest import SMALL


def plain(rows):
    clean = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows]
    return sorted(clean, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


#: The oracle has the normal quantile; the few rows of the smallest tables get Student's, wider by this share at most.
TOLERANCE = {("est_avg_ratio", "half_width"): 5e-3, ("est_sum_clt", "half_width"): 2e-2, ("est_count_clt", "half_width"): 2e-2}


def alike(x, y, rel):
    """Equal; numbers up to a relative difference."""
    if isinstance(x, bool) or isinstance(y, bool) or x is None or y is None or isinstance(x, str | datetime.date):
        return x == y
    assert isinstance(x, int | float | decimal.Decimal) and isinstance(y, int | float | decimal.Decimal)
    return float(x) == pytest.approx(float(y), rel=rel, abs=1e-12)


def test_alike_tells_numbers_apart():
    assert alike(1.0, 1, 1e-9) and alike("a", "a", 0) and alike(None, None, 0)
    assert not alike(1.0, 1.01, 1e-9) and not alike("a", "b", 1) and not alike(None, 1.0, 1) and not alike(True, False, 1)


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in queries.TABLES:
        connection.sql(f"CREATE VIEW {name} AS FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equal(spark, oracle, name):
    found = queries.QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    wanted = plain(oracle.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({queries.ORACLE[name]})").fetchall())
    got = plain(map(tuple, found.select(*columns).collect()))
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted, strict=True):
        for column, x, y in zip(columns, a, b, strict=True):
            assert alike(x, y, TOLERANCE.get((name, column), 1e-9)), (column, a, b)
