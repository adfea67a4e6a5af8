"""Reconciliation: by counts, by time window, and record by record on business keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import WINDOW_UNITS
from ..streaming.ledger import Totals
from . import audit

# Texts of the discrepancies a report lists.
REJECTED_TEXT = "Schema validation rejected %d record(s)"
LAG_TEXT = (
    "Target lag: %d records transformed but only %d written "
    "(%.2f%% loss, tolerance=%.2f%%)"
)
DUPLICATION_TEXT = "Unexpected duplication: %d written > %d transformed"
INVALID_TEXT = "Invalid state: rejectedCount(%d) > sourceReadCount(%d)"

# Columns of the report table.
REPORT_COLUMNS = (
    "run_id",
    "job_name",
    "window_start",
    "window_end",
    "window_label",
    "source_read_count",
    "schema_rejected_count",
    "transformed_count",
    "target_written_count",
    "reconciled",
    "discrepancies",
)

_COUNTS = {
    audit.SOURCE_READ: "source_read_count",
    audit.SOURCE_REJECTED: "schema_rejected_count",
    audit.TRANSFORM_OUTPUT: "transformed_count",
    audit.TARGET_WRITTEN: "target_written_count",
}


def stage_totals(events: DataFrame, keys: list[str]) -> DataFrame:
    """The four counts per key, summed over every source and target; absent stages are 0."""
    return events.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("count"))), F.lit(0)).alias(name)
            for kind, name in _COUNTS.items()
        ]
    )


def batch_totals(events: DataFrame, keys: list[str]) -> DataFrame:
    """``stage_totals`` with what batches that lost rows, and batches that doubled some, hold apart.

    So a loss in one batch is not made up for by as many rows too many in another.
    """
    batch = F.get_json_object("metadata", "$.batch_id").alias("_batch")
    each = stage_totals(events.select("*", batch), [*keys, "_batch"])
    gap = F.col("transformed_count") - F.col("target_written_count")
    apart = [
        F.coalesce(F.sum(F.when(which, F.col(count))), F.lit(0)).alias(name)
        for which, names in ((gap > 0, ("_lag_out", "_lag_held")), (gap < 0, ("_extra_out", "_extra_held")))
        for count, name in zip(("transformed_count", "target_written_count"), names)
    ]
    return each.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _COUNTS.values()], *apart)


def totals_frame(spark: SparkSession, run_id: str, job_name: str, rows: list[tuple[int, int, Totals]]) -> DataFrame:
    """What ``batch_totals`` gives, from totals that are at hand: (from, to, totals) in epoch milliseconds."""
    records = []
    for begin, end, t in rows:
        sums = dict(zip(_COUNTS.values(), (t.counts[c] for c in ("read", "rejected", "transformed", "written"))))
        apart = dict(zip(("_lag_out", "_lag_held", "_extra_out", "_extra_held"), (*t.lag, *t.extra)))
        records.append({"_from": begin, "_to": end, **sums, **apart})
    kinds = ", ".join(f"{c}: bigint" for c in records[0]) if records else ""
    found = spark.sql(f"SELECT inline(from_json(:rows, 'array<struct<{kinds}>>'))", args={"rows": json.dumps(records)})
    return found.select(F.lit(run_id).alias("run_id"), F.lit(job_name).alias("job_name"), "*")


def discrepancies(tolerance_percent: float | Column = 0.0, by_batch: bool = False) -> Column:
    """Array of texts, empty when the four counts of a row agree within the tolerance.

    ``by_batch``: where some batches lost rows and others doubled some, each kind is told of its own batches.
    """
    read, rejected = F.col("source_read_count"), F.col("schema_rejected_count")
    transformed, written = F.col("transformed_count"), F.col("target_written_count")
    tolerance = F.lit(tolerance_percent).cast("double") if isinstance(tolerance_percent, (int, float)) else tolerance_percent
    lag_out, lag_held, extra_out, extra_held = transformed, written, transformed, written
    if by_batch:
        both = (F.col("_lag_out") > 0) & (F.col("_extra_held") > 0)
        own = lambda name, total: F.when(both, F.col(name)).otherwise(total)
        lag_out, lag_held = own("_lag_out", transformed), own("_lag_held", written)
        extra_out, extra_held = own("_extra_out", transformed), own("_extra_held", written)
    # Of all that was transformed, also where the loss is that of some batches.
    loss = F.lit(100.0) * (lag_out - lag_held) / F.when(transformed > 0, transformed)
    flowed = transformed > 0
    return F.array_compact(
        F.array(
            F.when(rejected > 0, F.printf(F.lit(REJECTED_TEXT), rejected)),
            F.when(
                flowed & (lag_out > lag_held) & (loss > tolerance),
                F.printf(F.lit(LAG_TEXT), lag_out, lag_held, loss, tolerance),
            ),
            F.when(flowed & (extra_held > extra_out), F.printf(F.lit(DUPLICATION_TEXT), extra_held, extra_out)),
            F.when(read < rejected, F.printf(F.lit(INVALID_TEXT), rejected, read)),
        )
    )


def report(
    totals: DataFrame,
    window_start: Column,
    window_end: Column,
    window_label: Column,
    tolerance_percent: float | Column = 0.0,
) -> DataFrame:
    """Report rows from rows of stage totals, with net input and target lag beside."""
    by_batch = "_lag_out" in totals.columns
    return totals.withColumn("_found", discrepancies(tolerance_percent, by_batch)).select(
        "run_id",
        "job_name",
        window_start.alias("window_start"),
        window_end.alias("window_end"),
        window_label.alias("window_label"),
        *_COUNTS.values(),
        (F.size("_found") == 0).alias("reconciled"),
        F.to_json("_found").alias("discrepancies"),
        (F.col("source_read_count") - F.col("schema_rejected_count")).alias("net_input_count"),
        (F.col("transformed_count") - F.col("target_written_count")).alias("target_lag"),
    )


def window_label(interval_ms: Column) -> Column:
    """Label of a window length in milliseconds: days, hours, minutes, else whole seconds."""
    out = F.when(interval_ms <= 0, "n/a")
    for unit, ms in WINDOW_UNITS:
        whole = F.floor(interval_ms / ms).cast("bigint").cast("string")
        out = out.when((interval_ms % ms == 0) | (F.lit(unit) == "s"), F.concat(whole, F.lit(unit)))
    return out


def window_ms(label: str) -> int:
    """Milliseconds of a window setting."""
    window_interval(label)
    return int(label[:-1]) * {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}[label[-1]]


def window_interval(label: str) -> str:
    """Spark interval of a window setting such as ``5m``, ``1h`` or ``1d``."""
    unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}.get(label[-1:])
    if unit is None or not label[:-1].isdigit() or int(label[:-1]) == 0:
        raise ValueError(f"window {label!r} is not a number followed by m, h or d")
    return f"{int(label[:-1])} {unit}"


def by_window(events: DataFrame, window: str, tolerance_percent: float = 0.0) -> DataFrame:
    """One report per run and time window of stage-count events; a batch belongs to the window of its time."""
    placed = events.withColumn("_w", F.window(F.col("ts"), window_interval(window)))
    totals = batch_totals(placed, ["run_id", "job_name", "_w"])
    return report(totals, F.col("_w.start"), F.col("_w.end"), F.lit(window), tolerance_percent)


def records(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Compares two tables on business keys; one row per key that does not agree.

    ``missing``     only in the source
    ``unexpected``  only in the target
    ``duplicated``  the target holds more rows of the key than the source
    ``lost``        the target holds fewer, but some
    ``changed``     as many rows, but not the same ones

    No join: both sides are stacked, equal rows fold map-side into one counted row, and
    those fold per key. A key shared by any number of rows costs one row per task, NULL
    keys and values compare as equal, and rows are compared in full.
    """
    other = [c for c in source.columns if c not in keys]

    def side(df: DataFrame, src: int, tgt: int) -> DataFrame:
        return df.select(*keys, *other, F.lit(src).cast("bigint").alias("_s"), F.lit(tgt).cast("bigint").alias("_t"))

    folded = (
        side(source, 1, 0)
        .unionByName(side(target, 0, 1))
        .groupBy(*keys, *other)
        .agg(F.sum("_s").alias("_s"), F.sum("_t").alias("_t"))
    )
    per_key = folded.groupBy(*keys).agg(
        F.sum("_s").alias("source_rows"),
        F.sum("_t").alias("target_rows"),
        F.count_if(F.col("_s") != F.col("_t")).alias("differing"),
    )
    status = (
        F.when(F.col("target_rows") == 0, "missing")
        .when(F.col("source_rows") == 0, "unexpected")
        .when(F.col("target_rows") > F.col("source_rows"), "duplicated")
        .when(F.col("target_rows") < F.col("source_rows"), "lost")
        .when(F.col("differing") > 0, "changed")
    )
    return per_key.withColumn("status", status).where("status IS NOT NULL").drop("differing")


def reject_alerts(rejects: DataFrame, at: str, window: str, more_than: int, for_windows: int = 1) -> DataFrame:
    """Windows with more than N rejects, the last of at least ``for_windows`` such in a row."""
    counted = (
        rejects.groupBy(F.window(F.col(at), window).alias("_w"))
        .agg(F.count(F.lit(1)).alias("rejects"))
        .where(F.col("rejects") > more_than)
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "rejects")
    )
    if for_windows <= 1:
        return counted
    # A run of n breaching windows ends here when all n - 1 windows before breach too:
    # each breach vouches for the windows that follow it, and vouchers are counted.
    width = F.col("window_end") - F.col("window_start")
    vouched = counted.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(for_windows - 1))).alias("_k")
    ).select((F.col("window_start") + width * F.col("_k")).alias("_at"))
    full = vouched.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == for_windows)
    return counted.join(full, F.col("window_start") == F.col("_at"), "left_semi")
