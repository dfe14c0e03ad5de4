"""Each catalogue query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from vantaloom.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def keyed(frame, columns):
    return sorted(map(str, frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert keyed(ours, columns) == keyed(theirs, columns)


def test_orders(spark):
    scores = [r["value"] for r in QUERIES["order_by_score"](spark, SF).collect()]
    assert scores == sorted(scores, reverse=True)
    ranks = [r["user_id"] for r in QUERIES["order_by_rank"](spark, SF).collect()]
    assert ranks == sorted(ranks)
    keys = [r["key"] for r in QUERIES["merge_tables"](spark, SF).collect()]
    assert keys == sorted(keys, key=str.encode)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
