"""Event time: parsing a payload column, processing time and watermarks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .progress import watch

# Fixed values.
PROCESSED_TIME = "processed_time"
DEFAULT_OUT_OF_ORDERNESS_MS = 5000


@dataclass(frozen=True)
class EventTime:
    column: str
    pattern: str | None = None


def to_timestamp(column: Column, ddl: str, pattern: str | None = None) -> Column:
    """A TIMESTAMP from epoch milliseconds, text or a zone-less timestamp; NULL if unparseable."""
    if ddl in ("int", "bigint"):
        return F.timestamp_millis(column.cast("bigint"))
    if ddl == "double":
        return F.timestamp_millis(F.round(column).cast("bigint"))
    if ddl == "string":
        return F.try_to_timestamp(column, F.lit(pattern)) if pattern else F.try_to_timestamp(column)
    return column.cast("timestamp")


def lag_seconds(max_out_of_orderness_ms: int) -> int:
    """Watermark lag in whole seconds, rounded towards zero and never negative."""
    return max(int(max_out_of_orderness_ms / 1000), 0)


def with_processed_time(df: DataFrame) -> DataFrame:
    return df.withColumn(PROCESSED_TIME, F.current_timestamp())


def with_watermark(df: DataFrame, column: str, max_out_of_orderness_ms: int) -> DataFrame:
    """Declares event time. Spark watermarks TIMESTAMP only, so other types are converted. Late rows
    of a stream are recorded from here on."""
    if df.isStreaming:
        watch(df.sparkSession)
    field = df.schema[column].dataType
    if not isinstance(field, T.TimestampType):
        df = df.withColumn(column, to_timestamp(F.col(column), field.simpleString()))
    return df.withWatermark(column, f"{lag_seconds(max_out_of_orderness_ms)} seconds")
