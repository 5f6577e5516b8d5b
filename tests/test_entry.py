"""Queries against DuckDB, as the driver holds them, on the smallest tables."""

import glob
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SOME = ["resample_1h", "vote", "ind_sma", "ind_rsi", "ind_macd", "ind_adx", "candles_double", "backtest_ledger", "hourly_sentiment", "next_bar_targets"]


def rows(relation, columns):
    got = relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    return sorted(got, key=lambda r: tuple((x is None, str(x)) for x in r))


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b)))


@pytest.mark.oracles
@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_every_oracle(spark, tmp_path):
    """All core queries with SQL, one after another; what differs is told by name at the end."""
    import __spark_entry__ as entry
    from barflow.plans.oracle import ORACLE_SQL

    con, wrong = duckdb.connect(), []
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, sql in ORACLE_SQL.items():
        out = str(tmp_path / name)
        entry.queries()[name](spark, SF).write.parquet(out)
        want, got = con.sql(sql), con.sql(f"select * from '{out}/*.parquet'")
        columns = sorted(want.columns)
        if columns != sorted(got.columns):
            wrong.append(name)
            continue
        a, b = rows(want, columns), rows(got, columns)
        if len(a) != len(b) or not all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True)):
            wrong.append(name)
    assert wrong == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name, tmp_path):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    out = str(tmp_path / "out")
    entry.queries()[name](spark, SF).write.parquet(out)
    want, got = con.sql(entry.oracle_sql()[name]), con.sql(f"select * from '{out}/*.parquet'")
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want, sorted(want.columns)) == rows(got, sorted(want.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["symbol", "datetime", "signals"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
