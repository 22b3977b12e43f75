"""Every query against its SQL in DuckDB, on the smallest tables; queries without SQL give rows."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as e
from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: May be empty on the smallest tables.
SPARSE = {"propositions", "phrase_mentions", "entity_mentions", "cooccurrence_edges", "frequent_edges"}


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(x):
        if x is None or x is pd.NA or x != x:
            return "null"
        return repr(round(float(x), 9) + 0.0) if isinstance(x, float) else str(x)

    return sorted(tuple(one(x) for x in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got = e.queries()[name](spark, sf).toPandas()
    want = duck.execute(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
    assert len(got) or name in SPARSE


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert e.queries()[name](spark, sf).limit(1).count() == 1


def test_entry(spark):
    assert e.entry(spark).columns == ["query_id", "rank", "doc_id", "score", "text_md5"]
