"""Every query with SQL against DuckDB; the others must give rows."""

import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from brickfield.plans import registry

from .oracle import connection, differences

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, con, name):
    n, ours, theirs, columns, m = differences(spark, SF, QUERIES[name], SQL[name], con)
    assert columns is None and not ours and not theirs and n == m > 0


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_sign_changes_where_values_equal_their_mean(spark, tmp_path):
    """Means are added up in the rows' order, not in that of the file."""
    rng = np.random.default_rng(5)
    rows, users = [], 0
    while users < 100:
        tenths = rng.integers(1, 60, 40)
        if tenths.sum() % 40 == 0 and (tenths * 40 == tenths.sum()).any():
            rows += [(len(rows) + n, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=int(n)), users, float(t) / 10) for n, t in enumerate(tenths)]
            users += 1
    e = pa.table(dict(zip(("event_id", "ts", "user_id", "value"), map(list, zip(*rng.permutation(np.array(rows, object)).tolist(), strict=True)), strict=True)))
    pq.write_table(e.cast(pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("value", pa.float64())])), tmp_path / "events.parquet")
    con = connection(tmp_path)
    con.execute("SET threads = 1")  # several threads may add up in parts
    n, ours, theirs, _, m = differences(spark, str(tmp_path), QUERIES["ssc_rows"], SQL["ssc_rows"], con)
    assert n == m == 100 and not ours and not theirs
