"""Session windows for bounded data, split where one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import Heat, Split, by_heat, join_on


def sessions(
    df: DataFrame, keys: list[str], at: str, gap_seconds: int, aggs: dict[str, Column], heat: Heat | None = None
) -> DataFrame:
    """Rows at most ``gap_seconds`` apart share a session; it ends one gap after its last row.

    Hot keys fold to one row per moment before they are split, so neither a key nor a moment
    has to fit a task. Rows without a time are in no session.
    """
    cold, hot, rows = by_heat(df, keys, heat)
    window = F.session_window(F.col(at), f"{gap_seconds} seconds")
    out = cold.groupBy(*keys, window.alias("_w")).agg(*[c.alias(n) for n, c in aggs.items()])
    out = out.select(*keys, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *aggs)
    if hot is None:
        return out
    moments = hot.where(F.col(at).isNotNull()).select(*keys, at).distinct()
    split = Split.of(moments, keys, [at], rows)
    gap = F.expr(f"INTERVAL {gap_seconds} SECONDS")
    seen = split.summary([F.max(at).alias("_max")], {"_prev": F.max("_max").over(split.before())})
    lagged = split.df.withColumn("_lag", F.lag(at).over(split.local()))
    flagged = split.attach(lagged, seen).withColumn(
        "_new", F.when(F.col(at) > F.coalesce("_lag", "_prev") + gap, 1).otherwise(0)
    )
    # Sessions are numbered by their starts: starts in earlier parts plus those so far here.
    numbered = Split(flagged, keys, split.order)
    starts = numbered.summary([F.sum("_new").alias("_n")], {"_before": F.sum("_n").over(numbered.before())})
    here = numbered.local().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = numbered.attach(flagged.withColumn("_here", F.sum("_new").over(here)), starts)
    session = F.col("_here") + F.coalesce("_before", F.lit(0))
    placed = placed.select(*keys, at, session.alias("_session"))
    whole = join_on(hot.where(F.col(at).isNotNull()), placed, [*keys, at]).groupBy(*keys, "_session").agg(
        F.min(at).alias("session_start"),
        (F.max(at) + gap).alias("session_end"),
        *[c.alias(n) for n, c in aggs.items()],
    )
    return out.unionByName(whole.drop("_session"))
