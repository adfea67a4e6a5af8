"""Analytic windows that stay whole and balanced when one group holds most rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .groups import Heat, Split, backwards, by_heat, hot_group_rows, join_on, names, ordering


def _plain(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*ordering(order))


def _to_here(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _exact(df: DataFrame, sums: dict[str, Column]) -> None:
    """Sums that are put together from parts must not depend on how the rows were cut."""
    for field in df.select(*[c.alias(n) for n, c in sums.items()]).schema:
        if not isinstance(field.dataType, (T.IntegralType, T.DecimalType)):
            raise TypeError(f"{field.name}: sums need an integer or decimal, not {field.dataType.simpleString()}")


def running(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], heat: Heat | None = None
) -> DataFrame:
    """Running totals, rows frame. ``order`` must be unique within a group, sums of an exact type."""
    _exact(df, sums)
    cold, hot, rows = by_heat(df, keys, heat)
    out = cold.select("*", *[F.sum(c).over(_to_here(_plain(keys, order))).alias(n) for n, c in sums.items()])
    return out if hot is None else out.unionByName(_running_split(hot, rows, keys, order, sums))


def _running_split(
    hot: DataFrame, rows: int, keys: list[str], order: list[str], sums: dict[str, Column]
) -> DataFrame:
    """Running totals of groups that are split: totals of the parts before, plus those here."""
    split = Split.of(hot, keys, order, rows)
    base = split.summary(
        [F.sum(c).alias(n) for n, c in sums.items()],
        {f"_before_{n}": F.sum(n).over(split.before()) for n in sums},
    )
    local = split.df.select(
        "*", *[F.sum(c).over(_to_here(split.local())).alias(n) for n, c in sums.items()]
    )
    # NULL only where no row so far had a value, as in SQL.
    totals = {
        n: F.when(F.col(n).isNull(), F.col(f"_before_{n}")).otherwise(
            F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))
        )
        for n in sums
    }
    return split.attach(local, base).select(
        *hot.columns, *[totals[n].cast(local.schema[n].dataType).alias(n) for n in sums]
    )


def _position_split(hot: DataFrame, rows: int, keys: list[str], order: list[str], name: str) -> DataFrame:
    return _running_split(hot, rows, keys, order, {name: F.lit(1).cast("bigint")})


def ranked(
    df: DataFrame, keys: list[str], by: list[str], tie: list[str], tiles: int, heat: Heat | None = None
) -> DataFrame:
    """row_number and ntile over (by, tie); rank and dense_rank over ``by`` alone."""
    cold, hot, rows = by_heat(df, keys, heat)
    fine, coarse = _plain(keys, [*by, *tie]), _plain(keys, by)
    out = cold.select(
        "*",
        F.row_number().over(fine).cast("bigint").alias("row_number"),
        F.rank().over(coarse).cast("bigint").alias("rank"),
        F.dense_rank().over(coarse).cast("bigint").alias("dense_rank"),
        F.ntile(tiles).over(fine).cast("bigint").alias("ntile"),
    )
    if hot is None:
        return out
    # Ranks need only the distinct sort values: ties fold in the map-side aggregate, so
    # a value shared by any number of rows is one row from here on.
    values = hot.groupBy(*keys, *names(by)).agg(F.count(F.lit(1)).alias("_ties"))
    values = running(values, keys, by, {"_upto": F.col("_ties"), "dense_rank": F.lit(1).cast("bigint")})
    values = values.select(
        *keys, *names(by), (F.col("_upto") - F.col("_ties") + 1).alias("rank"), "dense_rank"
    )
    totals = hot.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    numbered = _position_split(hot, rows, keys, [*by, *tie], "row_number")
    joined = join_on(join_on(numbered, values, [*keys, *names(by)]), totals, keys)
    small, extra = F.expr(f"_total div {tiles}"), F.expr(f"_total % {tiles}")
    head = extra * (small + 1)
    tile = F.when(
        F.col("row_number") <= head, F.ceil(F.col("row_number") / (small + 1))
    ).otherwise(extra + F.ceil((F.col("row_number") - head) / F.greatest(small, F.lit(1))))
    return out.unionByName(
        joined.select(*df.columns, "row_number", "rank", "dense_rank", tile.cast("bigint").alias("ntile"))
    )


def neighbourhood(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    before: int,
    after: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    heat: Heat | None = None,
) -> DataFrame:
    """Columns that look at most ``before`` rows back and ``after`` rows ahead.

    Covers LAG, LEAD and ROWS frames of bounded width. Hot groups are cut into blocks of
    equal length by row position; each block also receives copies of the few rows its
    edges can see.
    """
    cold, hot, rows = by_heat(df, keys, heat)
    out = cold.select("*", *[c.alias(n) for n, c in build(_plain(keys, order)).items()])
    if hot is None:
        return out
    size = max(hot_group_rows(df.sparkSession), before + 1, after + 1)
    placed = _position_split(hot, rows, keys, order, "_pos").withColumn("_home", F.expr(f"(_pos - 1) div {size}"))
    offset = F.expr(f"(_pos - 1) % {size}")
    copies = F.array_compact(
        F.array(
            F.col("_home"),
            F.when(offset >= size - before, F.col("_home") + 1) if before else F.lit(None),
            F.when((offset < after) & (F.col("_home") > 0), F.col("_home") - 1) if after else F.lit(None),
        )
    )
    blocks = placed.withColumn("_block", F.explode(copies))
    window = Window.partitionBy(*keys, "_block").orderBy("_pos")
    built = blocks.select("*", *[c.alias(n) for n, c in build(window).items()])
    return out.unionByName(built.where("_block = _home").select(*out.columns))


def edges(df: DataFrame, keys: list[str], first: dict[str, str], last: dict[str, str], order: list[str]) -> DataFrame:
    """FIRST_VALUE / LAST_VALUE over whole groups: one row per key each, joined on the keys.

    ``order`` must be unique within a group; a leading minus means descending.
    """
    out = df
    for wanted, along in ((first, order), (last, backwards(order))):
        if wanted:
            row = _leading(df, keys, along, list(dict.fromkeys(wanted.values())))
            out = join_on(out, row.select(*keys, *[F.col(f"_w_{c}").alias(n) for n, c in wanted.items()]), keys)
    return out


def _leading(df: DataFrame, keys: list[str], order: list[str], wanted: list[str]) -> DataFrame:
    """Per key, ``wanted`` columns (as ``_w_<name>``) of the first row. Only the columns needed are
    read, and every task passes on one row per key."""
    needed = dict.fromkeys([*keys, *names(order), *wanted])
    place = F.row_number().over(_plain(keys, order))
    rows = df.select(*needed).withColumn("_place", place).where(F.col("_place") == 1)
    return rows.select(*keys, *[F.col(c).alias(f"_w_{c}") for c in wanted])


def range_frame(
    df: DataFrame, keys: list[str], at: str, width: int, sums: dict[str, Column], heat: Heat | None = None
) -> DataFrame:
    """Sums over RANGE BETWEEN width PRECEDING AND CURRENT ROW of the integer column ``at``.

    A sliding range frame re-adds the frame for every row. Here each row enters at ``at``
    and leaves after ``at + width``, so the frame is a running total of signed amounts, which is
    lossless for the exact types that ``sums`` must have. As in SQL, a frame without any
    value gives NULL, and the rows whose ``at`` is NULL are each other's whole frame.
    """
    _exact(df, sums)
    kinds = {f.name: f.dataType for f in df.select(*[F.sum(c).alias(n) for n, c in sums.items()]).schema}
    timed = df.where(F.col(at).isNotNull())
    out = _timed_frames(timed, keys, at, width, sums, heat)
    out = out.select(*df.columns, *[F.col(n).cast(kinds[n]).alias(n) for n in sums])
    if not df.schema[at].nullable:
        return out
    untimed = df.where(F.col(at).isNull())
    peers = untimed.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return out.unionByName(join_on(untimed, peers, keys).select(*out.columns))


def _timed_frames(
    df: DataFrame, keys: list[str], at: str, width: int, sums: dict[str, Column], heat: Heat | None
) -> DataFrame:
    enters = F.struct(F.col(at).alias("_at"), F.lit(1).alias("_sign"))
    leaves = F.struct((F.col(at) + width + 1).alias("_at"), F.lit(-1).alias("_sign"))
    # Per sum, the signed amounts and the signed number of rows that have one.
    signed = {}
    for n in sums:
        signed[f"_m_{n}"] = F.col(f"_m_{n}") * F.col("_sign")
        signed[f"_c_{n}"] = F.col(f"_c_{n}") * F.col("_sign")
    totals = {n: F.when(F.col(f"_t_c_{n}") > 0, F.col(f"_t_m_{n}")) for n in sums}

    def moves(rows: DataFrame, payload: list[str]) -> DataFrame:
        amounts = [F.coalesce(c, F.lit(0)).alias(f"_m_{n}") for n, c in sums.items()]
        present = [c.isNotNull().cast("bigint").alias(f"_c_{n}") for n, c in sums.items()]
        doubled = rows.select("*", *amounts, *present).select("*", F.inline(F.array(enters, leaves)))
        # A leaving row only lowers the total: it carries no payload through the shuffle.
        kept = [F.when(F.col("_sign") == 1, F.col(c)).alias(c) for c in payload if c not in keys]
        return doubled.select(*keys, *kept, *signed, "_at", "_sign")

    cold, hot, rows = by_heat(df, keys, heat)
    upto = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = moves(cold, cold.columns).select("*", *[F.sum(c).over(upto).alias(f"_t{n}") for n, c in signed.items()])
    out = out.where(F.col("_sign") == 1).select(*df.columns, *[c.alias(n) for n, c in totals.items()])
    if hot is None:
        return out
    # One row per key and moment, folded map-side; running totals over those; and back.
    folded = moves(hot, []).groupBy(*keys, "_at").agg(*[F.sum(c).alias(f"_d{n}") for n, c in signed.items()])
    run = running(folded, keys, ["_at"], {f"_t{n}": F.col(f"_d{n}") for n in signed})
    run = run.select(*keys, F.col("_at").alias(at), *[c.alias(n) for n, c in totals.items()])
    back = join_on(hot, run, [*keys, at])
    return out.unionByName(back.select(*df.columns, *[F.col(n).cast(out.schema[n].dataType).alias(n) for n in sums]))


def newest_per_key(
    df: DataFrame, keys: list[str], order: list[str], keep: str = "last", columns: list[str] | None = None
) -> DataFrame:
    """One row per key, the first or last by ``order`` (a leading minus means descending).

    Of ``columns`` (default: all), which are pruned before the shuffle; every task passes on one
    row per key, so a hot key is no larger than any other.
    """
    wanted = columns or df.columns
    along = order if keep == "first" else backwards(order)
    found = _leading(df, keys, along, [c for c in wanted if c not in keys])
    return found.select(*[F.col(c) if c in keys else F.col(f"_w_{c}").alias(c) for c in wanted])
