"""Every registered query of the span-policy operators against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

from spanwright.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    tidy = lambda v: round(v, 8) + 0.0 if isinstance(v, float) else v
    return [names[k] for k in order], sorted((tuple(tidy(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    told = duck.execute(ORACLE_SQL[name])
    assert canonical(df.collect(), df.columns) == canonical(told.fetchall(), [d[0] for d in told.description])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
