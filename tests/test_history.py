from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from broadsheet.operators import history as H
from broadsheet.operators.ranks import rank_within


@pytest.mark.parametrize("range_rows", [40, 100_000])
def test_rank_by_date(spark, range_rows):
    rows = [(i, "hot" if i % 3 else f"u{i % 7}",
             f"2024-01-{1 + i % 5:02d} {i % 24:02d}:00:00" if i % 11 else "N/A")
            for i in range(400)]
    history = spark.createDataFrame(rows, "id int, email string, date string")
    ranked = H.rank_by_date(history, "id", range_rows=range_rows)
    assert ranked.columns == ["id", "email", "date", "recorded_at", "recency"]
    got = {r.id: r.recency for r in ranked.collect()}
    groups = defaultdict(list)
    for i, email, date in rows:
        groups[email].append((date if date != "N/A" else "", i))
    for items in groups.values():
        items.sort(key=lambda x: x[1])
        items.sort(key=lambda x: x[0], reverse=True)
        for rank, (_, i) in enumerate(items, 1):
            assert got[i] == rank


def test_union(spark):
    a = spark.createDataFrame([(1, "x")], "id int, title string")
    b = spark.createDataFrame([(2,)], "id int")
    rows = H.union_histories(a, b).orderBy("id").collect()
    assert [(r.id, r.title) for r in rows] == [(1, "x"), (2, None)]


def test_an_owner_with_all_rows_in_one_second_ranks_over_several_tasks(spark):
    rows = spark.range(5000).select(
        "id", F.when(F.col("id") % 50 > 0, "hot").alias("email"),
        F.lit("2024-01-01 00:00:00").alias("date"))
    ranked = H.rank_by_date(rows, "id", range_rows=500)
    got = [r.recency for r in ranked.where("email = 'hot'").orderBy("id").collect()]
    assert got == list(range(1, 4901))
    assert [r.recency for r in ranked.where("email IS NULL").orderBy("id").collect()] == list(
        range(1, 101))
    longest = (ranked.where("email = 'hot'").groupBy(F.spark_partition_id()).count()
               .agg(F.max("count"), F.count("*")).first())
    assert longest[1] > 1


def test_ranks_of_equal_rows_and_of_none(spark):
    rows = spark.createDataFrame([(None, 1)] * 30 + [("a", 1)] * 5, "g string, v int")
    ranked = rank_within(rows, ["g"], F.struct("v"), "n", range_rows=4)
    assert sorted(r.n for r in ranked.where("g IS NULL").collect()) == list(range(1, 31))
    assert sorted(r.n for r in ranked.where("g = 'a'").collect()) == list(range(1, 6))
    assert rank_within(rows.limit(0), ["g"], F.struct("v"), "n").count() == 0
