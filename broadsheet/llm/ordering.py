"""Even buckets in ascending id order, without a global sort in one task.

Edges are approximate quantiles of the ids; each gap between edges is cut into equal
widths. The number of buckets is bounded, so one row per bucket may be handled alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGES = 128
MOST_BUCKETS = 100_000


def id_buckets(rows: DataFrame, column: str, rows_per_bucket: int) -> Column:
    """A Column with the bucket of each id; buckets ascend with the ids, null is first."""
    shares = [i / EDGES for i in range(EDGES + 1)]
    known = rows.where(F.col(column).isNotNull())
    count, edges = known.agg(F.count("*"), F.percentile_approx(column, shares, 10_000)).first()
    if not count:
        return F.lit(-1).cast("long")
    edges = sorted(set(edges))
    wanted = min(MOST_BUCKETS, count // rows_per_bucket + 1)
    parts = max(1, wanted // EDGES)
    array = F.array(*(F.lit(e).cast("long") for e in edges))

    def place(held):
        # The last edge at or below the id, then the part of its gap.
        gap = F.greatest(F.lit(1), F.size(F.filter(held, lambda e: e <= F.col(column)))) - 1
        low, high = F.get(held, gap), F.get(held, gap + 1)
        share = F.when(high.isNull(), F.lit(0.0)).otherwise(
            (F.col(column).cast("double") - low) / (high.cast("double") - low))
        part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share * parts).cast("int")))
        return gap.cast("long") * parts + part
    bucket = F.transform(F.array(array), place)[0]
    return F.when(F.col(column).isNull(), F.lit(-1).cast("long")).otherwise(bucket)
