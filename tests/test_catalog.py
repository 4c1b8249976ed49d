"""Every registered query against its SQL in DuckDB, over whole tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


def ordered(names, rows):
    places = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(row[i] for i in places) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, str(v)) for v in row))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    result = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(result.columns)
    want = ordered(names, cursor.fetchall())
    got = ordered(result.columns, [tuple(row) for row in result.collect()])
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(map(same, a, b)), (a, b)


@pytest.mark.parametrize("name", ["propaganda_lr", "topic_kmeans", "doc_topics"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    flagship = contract.entry(spark)
    assert flagship.count() == 200 and "final_score" in flagship.columns
