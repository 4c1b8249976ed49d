"""Row filters as boolean columns; never NULL, so negation is safe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet.functions.text import strip_text

# Fixed patterns.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"
EMAIL = r"^[^@]+@[^@]+\.[^@]+$"


def _true(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def has_text(column: Column) -> Column:
    return _true(strip_text(column.cast("string")) != "")


def is_url(column: Column) -> Column:
    """Scheme and host part both present."""
    return _true(column.rlike(URL))


def is_email(column: Column) -> Column:
    return _true(column.rlike(EMAIL))


def is_propaganda(label: Column, score: Column,
                  threshold: float = C.PROPAGANDA_THRESHOLD) -> Column:
    return _true((F.lower(label) == C.PROPAGANDA_LABEL) & (score >= threshold))
