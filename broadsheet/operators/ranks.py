"""Ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# A group of more rows is cut into ranges of about so many.
RANGE_ROWS = 200_000
# Of all groups together; more rows make longer ranges, so the split points stay few.
MOST_RANGES = 2_000
# Rows looked at for one split point.
OVERSAMPLING = 16


def rank_within(rows: DataFrame, group: Sequence[str], order: Column, output: str,
                range_rows: int = RANGE_ROWS) -> DataFrame:
    """``output`` 1.. for each row of a group, ascending by ``order``.

    ``order`` is a struct that sorts upwards. Small groups are ranked in one window. A group
    of more than ``range_rows`` rows is cut at split points, taken from a sample of its
    distinct values that a hash picks, so the same on every try; its ranges are ranked apart
    and shifted by the rows of lower ranges. Only split points, at most some
    ``MOST_RANGES``, are collected and sent. Rows that are equal in all of ``order`` share
    a range, where their ranks are arbitrary.
    """
    group = list(group)
    keyed = rows.withColumn("_order", order)
    total = keyed.count()
    width = max(range_rows, total // MOST_RANGES)
    # At most total / width groups.
    heavy = keyed.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > width)
    place = F.lit(0)
    points = _split_points(keyed, group, heavy, width) if total > width else None
    if points is not None:
        same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]
        on = same[0]
        for condition in same[1:]:
            on = on & condition
        keyed = keyed.join(F.broadcast(points), on, "left").drop(
            *[f"_g{i}" for i in range(len(group))])
        lower_points = F.size(F.filter("_points", lambda p: p < F.col("_order")))
        place = F.greatest(F.coalesce(lower_points, F.lit(0)), F.lit(0))
        keyed = keyed.withColumn("_heavy", F.col("_points").isNotNull())
    keyed = keyed.withColumn("_range", place).drop("_points")
    within = Window.partitionBy(*group, "_range").orderBy("_order")
    ranked = keyed.withColumn(output, F.row_number().over(within).cast("long"))
    if points is None:
        return ranked.drop("_order", "_range")
    # One row for each range of a heavy group.
    lower = (Window.partitionBy(*group).orderBy("_range")
             .rowsBetween(Window.unboundedPreceding, -1))
    shift = (keyed.where("_heavy").groupBy(*group, "_range").agg(F.count("*").alias("_n"))
             .select(*group, "_range", F.sum("_n").over(lower).alias("_shift"))
             .where("_shift IS NOT NULL")
             .withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(group)})
             .withColumnRenamed("_range", "_r"))
    return (ranked.join(F.broadcast(shift), on & (F.col("_range") == F.col("_r")), "left")
            .withColumn(output, F.col(output) + F.coalesce("_shift", F.lit(0)))
            .drop("_order", "_range", "_r", "_shift", "_heavy",
                  *[f"_g{i}" for i in range(len(group))]))


def _split_points(keyed: DataFrame, group: list[str], heavy: DataFrame,
                  width: int) -> DataFrame | None:
    """(_g0.., _points) of the heavy groups, from their sampled values; None without any."""
    found = heavy.collect()
    if not found:
        return None
    spark = keyed.sparkSession
    schema = heavy.schema.add("_every", "long")
    limits = spark.createDataFrame(
        [(*r, max(1, width // OVERSAMPLING)) for r in found], schema)
    limits = limits.withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(group)})
    on = F.lit(True)
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    names = [f"_g{i}" for i in range(len(group))]
    # Distinct before it is gathered: repeats of one value are one point.
    picked = (keyed.join(F.broadcast(limits), on)
              .where(F.pmod(F.xxhash64("_order"), F.col("_every")) == 0)
              .groupBy(*names, "_n").agg(F.array_sort(F.collect_set("_order")).alias("_all")))
    ranges = F.ceil(F.col("_n") / width).cast("int")
    each = F.greatest(F.lit(1), F.ceil(F.size("_all") / ranges).cast("int"))
    points = picked.select(*names, F.filter(
        "_all", lambda _, i: (i + 1) % each == 0).alias("_points"))
    rows = points.collect()
    return spark.createDataFrame(rows, points.schema)
