"""Every query that has SQL gives the rows that DuckDB gives."""

import decimal
from pathlib import Path

import duckdb
import pytest

from ordinate.queries import QUERIES, SQL

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    return repr(round(float(value), 9)) if isinstance(value, (float, decimal.Decimal)) else repr(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == columns
    expected = sorted(tuple(plain(r[theirs.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == expected


# by the rule of web_extracted_data these tables' pages have none; test_webpages compares it with plain trees
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"web_extracted_data"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(SF)).count() > 0


@pytest.mark.parametrize("name, tables", [("full_outer_join_whole", ("orders", "lineitem")), ("cumulative_product_whole", ("lineitem",))])
def test_whole_tables(duck, name, tables):
    """Every row of the tables counts: no filter, and unmatched rows for the join."""
    assert name in QUERIES and "WHERE" not in SQL[name] and "%" not in SQL[name]
    rows = duck.execute(f"SELECT count(*) FROM ({SQL[name]})").fetchone()[0]
    assert rows >= max(duck.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in tables)
    if len(tables) > 1:
        assert duck.execute(f"SELECT count(*) FROM ({SQL[name]}) WHERE o = -1 OR line = -1").fetchone()[0] > 0
