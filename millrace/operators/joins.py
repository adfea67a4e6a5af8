"""Joins on time and ranges as equi-joins on buckets, so no task sees a whole key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import Heat, Split, by_heat, ordering


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_at: str,
    right_at: str,
    seconds: int,
) -> DataFrame:
    """Right rows of the same key from ``left_at`` to ``left_at + seconds``, both inclusive.

    The time axis is cut into buckets as long as the interval, so a left row reaches its
    own bucket and the next. Key and bucket form the join key: one busy key is spread over
    its buckets, and a busy bucket is left to adaptive skew splitting. ``keys``, named
    alike on both sides, are kept once.
    """

    def bucket(at: Column) -> Column:
        return F.floor(F.unix_micros(at.cast("timestamp")) / (seconds * 1_000_000))

    spread = left.withColumn("_slot", F.explode(F.sequence(bucket(F.col(left_at)), bucket(F.col(left_at)) + 1)))
    slots = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
        bucket(F.col(right_at)).alias("_r_slot"),
    )
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_r_{k}") for k in keys])
    inside = F.col(right_at).between(F.col(left_at), F.col(left_at) + F.expr(f"INTERVAL {seconds} SECONDS"))
    joined = spread.join(slots, same & (F.col("_slot") == F.col("_r_slot")) & inside)
    return joined.drop("_slot", "_r_slot", *[f"_r_{k}" for k in keys])


#: Parts into which points are dealt to meet ranges without end, if neither may be counted; else the rows of a part on
#: either side, and the pairs that a task compares.
ENDLESS_PARTS = 16
ENDLESS_ROWS, ENDLESS_PAIRS = 2048, 1 << 23
_ENDLESS = 1 << 20


def levels_of(ranges: DataFrame, low: str, high: str) -> list[int]:
    """The levels that occur among ranges, for ``range_join``: whole powers of two, so never more than some two thousand."""
    found = ranges.where(F.col(low) < F.col(high)).select(_level(low, high).alias("_level"))
    return found.agg(F.sort_array(F.collect_set("_level"))).first()[0]


def _level(low: str, high: str) -> Column:
    width = F.col(high).cast("double") - F.col(low).cast("double")
    return F.when(width < float("inf"), F.ceil(F.log2(width))).otherwise(_ENDLESS).cast("int")


def range_join(
    points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, levels: list[int] | None = None
) -> DataFrame:
    """Points with ``low <= at < high``, joined by bins as wide as the ranges.

    A range of length up to 2**n lies on at most two bins of width 2**n, whatever its length; a
    point is looked up once for every n that occurs among the ranges: those are ``levels``, which are
    counted first if they are not given. A range without end on a side meets the points in parts: of bounded size if
    levels are counted, else a fixed number. Values compare as in SQL: -Infinity is a point like any other, Infinity lies in no range, NaN is above it
    and lies in none, but a range up to NaN holds Infinity. Empty ranges and NULL ends match nothing.
    """
    laid = ranges.where(F.col(low) < F.col(high)).withColumn("_level", _level(low, high))
    counted = levels is None
    levels = levels_of(ranges, low, high) if counted else levels
    endless = F.col("_level") == _ENDLESS
    inside = (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    apart = None
    if counted and _ENDLESS in levels:
        apart = _endless_join(points.where(F.col(at).isNotNull()), laid.where(endless).drop("_level"), inside)
        laid, levels = laid.where(~endless), [n for n in levels if n != _ENDLESS]

    def bin_of(value: Column) -> Column:
        # Beyond 2**60 bins from zero there is no range so short: its ends would be one number.
        quotient = value / F.pow(F.lit(2.0), F.least("_level", F.lit(1100)))
        return F.when(F.abs(quotient) < float(1 << 60), F.floor(quotient))

    parts = F.sequence(F.lit(0), F.lit(ENDLESS_PARTS - 1)).cast("array<bigint>")
    bins = F.when(endless, parts).otherwise(F.sequence(bin_of(F.col(low)), bin_of(F.col(high))))
    laid = laid.withColumn("_bin", F.explode(bins))
    looked = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    part = F.pmod(F.xxhash64(*points.columns), F.lit(ENDLESS_PARTS))
    looked = looked.withColumn("_bin", F.when(endless, part).otherwise(bin_of(F.col(at))))
    found = looked.join(laid, ["_level", "_bin"]).where(inside).drop("_level", "_bin")
    return found if apart is None else found.unionByName(apart)


def _endless_join(points: DataFrame, ranges: DataFrame, inside: Column) -> DataFrame:
    """Points with the ranges that have no end on a side: about every second pair is one of the result, so their number is
    that of the work. Points and ranges are dealt into parts of bounded size, and every part of the one meets every part of the
    other in a cell; the cells are dealt to as many tasks as their pairs need, however few bytes they have.
    """
    n, m = points.count(), ranges.count()
    rows, columns = max(1, -(-n // ENDLESS_ROWS)), max(1, -(-m // ENDLESS_ROWS))
    tasks = max(1, min(rows * columns, -(-n * m // ENDLESS_PAIRS)))

    def dealt(df: DataFrame, own: str, owns: int, other: str, others: int) -> DataFrame:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(owns)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        cells = df.withColumn(own, part).withColumn(other, every)
        # A number of partitions that is asked for is not merged by their bytes.
        return cells.repartition(tasks, "_row", "_column")

    met = dealt(points, "_row", rows, "_column", columns).join(dealt(ranges, "_column", columns, "_row", rows), ["_row", "_column"])
    return met.where(inside).drop("_row", "_column")


def overlap_join(
    left: DataFrame, right: DataFrame, left_low: str, left_high: str, right_low: str, right_high: str,
    left_levels: list[int] | None = None, right_levels: list[int] | None = None,
) -> DataFrame:
    """Pairs of half-open ranges that overlap, each once.

    Of two overlapping ranges, either the right one begins in the left, or the left one begins
    in the right and after its beginning. Both are joins of points with ranges, and no pair is in both. Ranges
    that are empty or have a NULL end match nothing; ends may be infinite. All column names differ.
    """
    sound = (left.where(F.col(left_low) < F.col(left_high)), right.where(F.col(right_low) < F.col(right_high)))
    first = range_join(sound[1], sound[0], right_low, left_low, left_high, left_levels)
    second = range_join(sound[0], sound[1], left_low, right_low, right_high, right_levels)
    return first.unionByName(second.where(F.col(left_low) > F.col(right_low))).select(*left.columns, *right.columns)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_at: str,
    right_at: str,
    carry: list[str],
    tie: list[str] | None = None,
    heat: Heat | None = None,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before it, NULL if none.

    Both sides are put on one time line and the last right row is carried forward: one
    sort instead of a range join. Of right rows of a key at the same moment, the last by
    ``tie`` (default: by ``carry``) counts; the others fold before the shuffle. As with any
    equality, a NULL key or time matches nothing. Hot keys are split, at a moment shared by many left
    rows too, and the carried row crosses parts through one summary row per part. ``carry`` names
    the right columns to bring over; ``heat`` is that of both sides together.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in carry]
    unmatched = left.where(~(known & F.col(left_at).isNotNull())).select(*left.columns, *nothing)

    latest = F.max_by(F.struct(*carry), F.struct(*(tie or carry)))
    moments = right.where(known & F.col(right_at).isNotNull()).groupBy(*keys, F.col(right_at).alias("_at"))
    moments = moments.agg(latest.alias("_carry"))
    empty_left = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in keys]
    line = left.where(known & F.col(left_at).isNotNull()).select(
        *left.columns,
        F.col(left_at).alias("_at"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(moments.schema["_carry"].dataType).alias("_carry"),
    ).unionByName(moments.select(*keys, *empty_left, "_at", F.lit(0).alias("_side"), "_carry"))
    order = ["_at", "_side"]

    def upto(window):
        frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.last("_carry", ignorenulls=True).over(frame)

    cold, hot, rows = by_heat(line, keys, heat)
    result = cold.withColumn("_carry", upto(Window.partitionBy(*keys).orderBy(*ordering(order))))
    if hot is not None:
        # Left rows of one moment are alike here: any number spreads them over parts.
        spread = hot.withColumn("_spread", F.when(F.col("_side") == 1, F.monotonically_increasing_id()))
        split = Split.of(spread, keys, [*order, "_spread"], rows)
        right_only = F.col("_side") == 0
        newest = F.max_by(F.when(right_only, F.col("_carry")), F.when(right_only, F.col("_at")))
        seen = split.summary(
            [newest.alias("_last")], {"_prev": F.last("_last", ignorenulls=True).over(split.before())}
        )
        local = split.df.withColumn("_carry", upto(split.local()))
        filled = split.attach(local, seen).withColumn("_carry", F.coalesce("_carry", "_prev"))
        result = result.unionByName(filled.select(*result.columns))
    matched = result.where("_side = 1").select(*left.columns, "_carry.*")
    return matched.unionByName(unmatched)


def asof_within(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_at: str,
    right_at: str,
    carry: list[str],
    seconds: int,
    tie: list[str] | None = None,
) -> DataFrame:
    """``asof_join`` with a lookback: the latest right row of the key from ``seconds`` before a left row up to it.

    For streams as well, in append mode: an interval join, whose state the lookback bounds, and then the latest
    row per left row, which is emitted when the watermark of both sides has passed it. Both
    sides need a watermark there. Every left row is also its own candidate with nothing to carry, so those that meet
    no right row come out with NULLs, and repeated left rows as often as they came. A NULL key or time matches nothing and is
    passed on at once. Left columns are grouping keys, so none may be a map. Of right rows at the same moment the last by
    ``tie`` (default: by ``carry``) counts.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) & F.col(left_at).isNotNull()
    kinds = {c: right.schema[c].dataType for c in carry}
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]
    place = F.struct(F.unix_micros(F.col(right_at).cast("timestamp")).alias("at"), *(tie or carry))
    candidates = right.select(*keys, right_at, F.struct(*carry).alias("_carry"), place.alias("_order"))
    pairs = interval_join(candidates, left.where(known), keys, right_at, left_at, seconds)
    own = left.where(known).select(
        *left.columns,
        F.lit(None).cast(candidates.schema["_carry"].dataType).alias("_carry"),
        F.lit(None).cast(candidates.schema["_order"].dataType).alias("_order"),
        F.lit(1).cast("bigint").alias("_times"),
    )
    met = pairs.select(*left.columns, "_carry", "_order", F.lit(0).cast("bigint").alias("_times"))
    latest = own.unionByName(met).groupBy(*left.columns).agg(
        F.max_by("_carry", "_order").alias("_carry"), F.sum("_times").alias("_times")
    )
    each = latest.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("bigint"), "_times")))
    found = each.select(*left.columns, *[F.col("_carry")[c].alias(c) for c in carry])
    return found.unionByName(left.where(~known).select(*left.columns, *nothing))
