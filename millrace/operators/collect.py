"""Ordered lists of groups of any size, as segments of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import Heat
from .windows import running

SEGMENT_ROWS = 10_000


def segments(
    df: DataFrame, keys: list[str], order: list[str], value: str, size: int = SEGMENT_ROWS, heat: Heat | None = None
) -> DataFrame:
    """(keys, segment, values): what ARRAY_AGG(value ORDER BY order) gives, in pieces of ``size`` values.

    The arrays of a group, one after another by ``segment`` (from 0), are its whole list; NULL values keep
    their place. A list in one row would grow with its group. Here a row's place is a running
    count, which cuts hot groups into parts, and a segment is gathered by (keys, segment), so that no task and no
    row holds more than its segments. ``order`` must be unique within a group.
    """
    if size < 1:
        raise ValueError(f"a segment cannot hold {size} values")
    rows = df.select(*dict.fromkeys([*keys, *[o.lstrip("-") for o in order], value]))
    placed = running(rows, keys, order, {"_place": F.lit(1).cast("bigint")}, heat)
    cut = placed.select(*keys, F.expr(f"(_place - 1) div {size}").alias("segment"), F.struct("_place", F.col(value).alias("_value")).alias("_item"))
    gathered = cut.groupBy(*keys, "segment").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    return gathered.select(*keys, "segment", F.col("_items._value").alias("values"))


def joined(listed: DataFrame, separator: str = ",") -> DataFrame:
    """``listed`` with ``text``: what STRING_AGG gives for each segment, NULLs left out.

    Joined by the same separator, the texts of a group are the whole STRING_AGG; a segment without
    any value has NULL, which is left out as well.
    """
    said = F.array_compact("values")
    text = F.when(F.size(said) > 0, F.array_join(said.cast("array<string>"), separator))
    return listed.withColumn("text", text)
