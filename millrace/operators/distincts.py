"""Distinct counts over spans of days, from what is kept per day.

Exact distinct counts do not add up: a value of two days counts once. What adds up is a sketch: one row per key and
day, written once as the day closes and merged for any span, without the days' rows. Exact counts beside it
go through the days' different values, folded twice, so no task holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch, as a power of two: 16 KB at most.
BITS = 14


def error(bits: int = BITS) -> float:
    """The relative error that an estimate keeps within but for one in a million: five standard deviations."""
    return 5 * 1.04 / 2 ** (bits / 2)


def day_sketches(rows: DataFrame, keys: list[str], at: str, value: str, bits: int = BITS) -> DataFrame:
    """(``keys``, day, sketch): a row per key and day, however many rows it has; tasks sketch before the shuffle.

    A NULL value does not count, a NULL key is a key, and rows of a NULL time are on no day.
    """
    known = rows.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    day = F.to_date(at).alias("day")
    return known.groupBy(*keys, day).agg(F.hll_sketch_agg(F.col(value), F.lit(bits)).alias("sketch"))


def _days(spans: DataFrame) -> DataFrame:
    """Every span on each of its days; one that ends before it begins has none."""
    whole = spans.where(F.col("first_day") <= F.col("last_day"))
    return whole.select("span", F.explode(F.sequence("first_day", "last_day")).alias("day"))


def estimated(sketches: DataFrame, keys: list[str], spans: DataFrame) -> DataFrame:
    """(``keys``, span, estimate) for ``spans`` (span, first_day, last_day, both inclusive), from sketches alone.

    A key without a value in a span has no row there. Sketches of different sizes may meet.
    """
    laid = sketches.join(_days(spans), "day").groupBy(*keys, "span")
    return laid.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(True))).alias("estimate"))


def exact(rows: DataFrame, keys: list[str], at: str, value: str, spans: DataFrame) -> DataFrame:
    """(``keys``, span, exact): the same counted exactly, for the same rows and keys.

    Values fold by day before they are laid on spans, and by span before they are counted; both
    times the value is part of what is shuffled by, which spreads the hottest key.
    """
    known = rows.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    by_day = known.select(*keys, F.to_date(at).alias("day"), F.col(value).alias("_value")).distinct()
    laid = by_day.join(_days(spans), "day").select(*keys, "span", "_value").distinct()
    return laid.groupBy(*keys, "span").agg(F.count(F.lit(1)).alias("exact"))


def within(estimate: Column, count: Column, bits: int = BITS) -> Column:
    """Whether an estimate is as near as ``error`` says; small counts may differ by one."""
    return F.abs(estimate - count) <= F.greatest(F.lit(1), count * error(bits))
