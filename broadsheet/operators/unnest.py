"""Rows from lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(rows: DataFrame, items: Column | str, *keep, value: str,
           pos: str | None = None) -> DataFrame:
    """One row per list item, with its place from 0 when ``pos`` is named.

    For a plain ``explode`` the optimiser adds a test that the list is not
    empty and pushes it down, which makes a computed list twice, the second
    time below any shuffle. The outer form gets no such test; the row it adds
    for an empty list is dropped again. Items must not be NULL unless ``pos``
    is named.
    """
    if pos is None:
        return (rows.select(*keep, F.explode_outer(items).alias(value))
                .filter(F.col(value).isNotNull()))
    return (rows.select(*keep, F.posexplode_outer(items).alias(pos, value))
            .filter(F.col(pos).isNotNull()))
