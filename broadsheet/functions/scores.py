"""Score arithmetic: star labels to numbers, means to labels, penalties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet import constants as C


def star_value(label: Column) -> Column:
    """1..5 for the five exact labels, 3 for anything else."""
    place = F.array_position(F.array(*map(F.lit, C.STAR_LABELS)), label)
    return F.when(place > 0, place.cast("int")).otherwise(C.NEUTRAL_STARS)


def star_label(stars: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, C.STAR_LABELS)), stars.cast("int"))


def round_cents(value: Column) -> Column:
    """Two decimals, decided on the exact binary value, ties to even.

    Spark's ``round`` looks at the printed decimal form instead, so 2.675
    (stored just below) would go up. With ``k = floor(100 v)`` the question is
    the sign of ``200 v - (2k + 1)``. ``8 v`` is exact; cutting it into a float
    and a rest keeps both products with 25 exact as well.
    """
    size = F.abs(value)
    scaled = size * 8.0
    high = scaled.cast("float").cast("double")
    low = scaled - high
    k = F.floor(size * 100.0)
    excess = (high * 25.0 - (k * 2 + 1)) + low * 25.0
    step = (F.when(excess > 0, 1).when(excess < 0, 0)
            .otherwise(F.pmod(k, F.lit(2))))
    return F.signum(value) * ((k + step) / 100.0)


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", round_cents(value))


def sentiment_class(mean: Column) -> Column:
    return (F.when(mean >= C.POSITIVE_FROM, "Positive")
            .when(mean <= C.NEGATIVE_UP_TO, "Negative")
            .otherwise("Neutral"))


def sentiment_color(label: Column) -> Column:
    color = F.lit(None).cast("string")
    for name, value in C.SENTIMENT_COLORS.items():
        color = F.when(label == name, value).otherwise(color)
    return F.coalesce(color, F.lit(C.OTHER_SENTIMENT_COLOR))


def sentiment_percent(mean: Column) -> Column:
    return (mean - 1) / 4 * 100


def penalty(count: Column, total: Column) -> Column:
    return count / total * C.MAX_PENALTY


def final_score(mean: Column, biased: Column, propaganda: Column,
                total: Column) -> Column:
    """Rescaled sentiment less both penalties, kept within 0..100."""
    raw = (sentiment_percent(mean) - penalty(biased, total)
           - penalty(propaganda, total))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
