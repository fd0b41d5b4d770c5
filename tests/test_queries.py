"""Every registered query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from gatelight import registry
from gatelight.operators import simulate

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: (round(v, 6) if math.isfinite(v) else str(v)) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, expected):
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(map(tuple, df.collect()), df.columns) == rows_of(expected.fetchall(), expected.columns)


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_same_rows_as_sql(spark, duck, name):
    compare(registry.QUERIES[name](spark, FOLDER), duck.sql(registry.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", registry.STUDY_SQL)
def test_studies_give_the_same_rows_as_sql(spark, duck, monkeypatch, name):
    sql = registry.STUDY_SQL[name]
    if name.startswith("sim_"):  # both sides with fewer iterations than they have by default
        own = getattr(simulate, name.removeprefix("sim_"))
        assert f"range({simulate.ITERATIONS})" in sql
        sql = sql.replace(f"range({simulate.ITERATIONS})", "range(3000)")
        monkeypatch.setattr(own, "__defaults__", (3000, *own.__defaults__[1:]))
    compare(registry.STUDIES[name](spark, FOLDER), duck.sql(sql))


def test_studies_are_not_registered():
    assert registry.STUDIES and not set(registry.STUDIES) & set(registry.QUERIES)


def test_all_states_occur(spark):
    states = {r.state for r in registry.QUERIES["q_state_fold"](spark, FOLDER).select("state").distinct().collect()}
    assert len(states) == 4


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLE_SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
