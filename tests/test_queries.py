"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    expected = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, map(tuple, found.collect())) == rows(names, expected.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_tables_are_asked(spark, duck):
    """Heads with subkeys of all conversations, and the currency of every event."""
    counts = {name: entry.queries()[name](spark, SF).count() for name in ("heads_subkeys", "currency_check")}
    assert counts == {"heads_subkeys": duck.execute("SELECT count(*) FROM conversations").fetchone()[0], "currency_check": duck.execute("SELECT count(*) FROM events").fetchone()[0]}
    assert 0 < entry.queries()["multi_get"](spark, SF).count() < duck.execute("SELECT count(*) FROM customer").fetchone()[0]


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["term", "key"] and found.count() >= 0


def test_scans_push_key_ranges_down(spark, tmp_path):
    from kvstrata.operators import folds
    from kvstrata.sources import tables
    from kvstrata.sources.journal import read_journal, write_journal

    write_journal(tables.orders(spark, SF), str(tmp_path / "j"))
    journal = read_journal(spark, str(tmp_path / "j"))
    plan = folds.key_list(journal, "o", "2-HIGH", start="0000000100", end="0000000200")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,0000000100)" in plan and "LessThanOrEqual(key,0000000200)" in plan
    assert "index_specs" not in plan.split("ReadSchema")[1]
