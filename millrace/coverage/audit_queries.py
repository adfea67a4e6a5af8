"""Stage counts, audit events, reconciliation. Every day of events is one run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, digests, reconcile
from ..session import fresh_path
from ..sources import ingest
from . import messages
from .messages import CLASSED
from .registry import query, table

# What the target of each run received, by arithmetic on the key: accepted rows pass the
# query when value > 20; of those, ids divisible by 31 are lost on the first ten days of
# the month and ids divisible by 37 are written twice on the second ten.
_FLOW_SQL = f"""{CLASSED},
staged AS (
  SELECT *, 'run-' || strftime(ts, '%Y%m%d') AS run_id,
    error_type IS NULL AND value > 20 AS passed,
    CASE WHEN day(ts) <= 10 AND event_id % 31 = 0 THEN 0
         WHEN day(ts) BETWEEN 11 AND 20 AND event_id % 37 = 0 THEN 2 ELSE 1 END AS copies
  FROM classed),
counts AS (
  SELECT run_id, 'events-job' AS job_name, count(*) AS read,
    count(*) FILTER (WHERE error_type IS NOT NULL) AS rejected,
    count(*) FILTER (WHERE passed) AS transformed,
    coalesce(CAST(sum(copies) FILTER (WHERE passed) AS BIGINT), 0) AS written
  FROM staged GROUP BY run_id)"""

_REPORT_SQL = """
SELECT *, len(found) = 0 AS reconciled,
  CASE WHEN len(found) = 0 THEN '[]' ELSE '["' || array_to_string(found, '","') || '"]' END AS discrepancies
FROM (
  SELECT *, list_filter([
    CASE WHEN rejected > 0 THEN printf('Schema validation rejected %d record(s)', rejected) END,
    CASE WHEN transformed > written AND 100.0 * (transformed - written) / transformed > {tolerance}
      THEN printf('Target lag: %d records transformed but only %d written (%.2f%% loss, tolerance=%.2f%%)',
                  transformed, written, CAST(100.0 * (transformed - written) / transformed AS DOUBLE),
                  CAST({tolerance} AS DOUBLE)) END,
    CASE WHEN transformed > 0 AND written > transformed
      THEN printf('Unexpected duplication: %d written > %d transformed', written, transformed) END],
    lambda t: t IS NOT NULL) AS found
  FROM {counts})"""


def _report_sql(counts: str, tolerance: float) -> str:
    return _REPORT_SQL.format(counts=counts, tolerance=tolerance)


def _copies(day, event_id):
    return (
        F.when((day <= 10) & (event_id % 31 == 0), 0)
        .when(day.between(11, 20) & (event_id % 37 == 0), 2)
        .otherwise(1)
    )


def _staged(spark, folder):
    """Each message with its verdict, its run and how often the target holds it."""
    events = table(spark, folder, "events")
    # The message text travels with its key and time, as transport metadata does.
    raw = events.select("event_id", "ts", messages.event_text().alias("value"))
    verdicts = ingest.classify(raw, messages.events_schema())
    at = F.col("raw.ts")
    passed = F.col("error_type").isNull() & (F.col("row.value") > 20)
    return verdicts.select(
        F.concat(F.lit("run-"), F.date_format(at, "yyyyMMdd")).alias("run_id"),
        F.lit("events-job").alias("job_name"),
        at.cast("timestamp").alias("ts"),
        "error_type",
        passed.alias("passed"),
        F.when(passed, _copies(F.dayofmonth(at), F.col("raw.event_id"))).otherwise(0).alias("copies"),
    )


def _counts(staged, *keys):
    return staged.groupBy("run_id", "job_name", *keys).agg(
        F.count(F.lit(1)).alias("read"),
        F.count_if(F.col("error_type").isNotNull()).alias("rejected"),
        F.count_if("passed").alias("transformed"),
        F.sum("copies").alias("written"),
    )


@query("stage_counts", f"WITH {_FLOW_SQL} SELECT * FROM counts")
def stage_counts(spark, folder):
    return _counts(_staged(spark, folder))


def _events(spark, folder):
    staged = _staged(spark, folder)
    counts = _counts(staged, F.date_trunc("hour", "ts").alias("at"))
    return audit.events_from_counts(
        counts, F.lit("events"), F.lit("enriched"), F.col("at"), F.struct(F.col("at").cast("string").alias("batch_id"))
    )


def _replayed(events):
    return events.unionByName(events.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND")))


@query(
    "recon_same_topic",
    f"""WITH {_FLOW_SQL}
        SELECT run_id, job_name, 2 * read AS source_read_count, 2 * rejected AS schema_rejected_count,
               transformed AS transformed_count, written AS target_written_count FROM counts""",
)
def recon_same_topic(spark, folder):
    """Two source tables over one topic: their batches have equal stages and ids, and both count."""
    hours = _counts(_staged(spark, folder), F.date_trunc("hour", "ts").alias("at"))

    def events(name: str, first: bool):
        note = F.struct(F.col("at").cast("string").alias("batch_id"), F.lit(name).alias("source"))
        kept = hours if first else hours.withColumns({"transformed": F.lit(0), "written": F.lit(0)})
        found = audit.events_from_counts(kept, F.lit("events"), F.lit("enriched"), F.col("at"), note)
        return found if first else found.where(F.col("event_type").startswith("SOURCE"))

    both = events("live", True).unionByName(events("again", False))
    return reconcile.stage_totals(audit.once_per_batch(_replayed(both)), ["run_id", "job_name"])


@query(
    "audit_events_from_counts",
    f"""WITH {_FLOW_SQL}
        SELECT run_id, job_name, 'SOURCE_READ' AS event_type, 'source/events' AS stage, read AS "count" FROM counts
        UNION ALL SELECT run_id, job_name, 'SOURCE_REJECTED', 'source/events', rejected FROM counts
        UNION ALL SELECT run_id, job_name, 'TRANSFORM_OUTPUT', 'transformation', transformed FROM counts
        UNION ALL SELECT run_id, job_name, 'TARGET_WRITTEN', 'target/enriched', written FROM counts""",
)
def audit_events_from_counts(spark, folder):
    counts = _counts(_staged(spark, folder))
    events = audit.events_from_counts(counts, F.lit("events"), F.lit("enriched"), F.current_timestamp())
    return events.drop("ts", "metadata")


@query(
    "recon_counts",
    f"""WITH {_FLOW_SQL}
        SELECT run_id, job_name, read AS source_read_count, rejected AS schema_rejected_count,
               transformed AS transformed_count, written AS target_written_count FROM counts""",
)
def recon_counts(spark, folder):
    """Hourly count events, each delivered twice as after a replay, summed per run."""
    return reconcile.stage_totals(audit.once_per_batch(_replayed(_events(spark, folder))), ["run_id", "job_name"])


@query(
    "audit_counters",
    f"""WITH {_FLOW_SQL}
        SELECT run_id, 'audit.source.events.read' AS counter, read AS value FROM counts
        UNION ALL SELECT run_id, 'audit.source.events.rejected', rejected FROM counts
        UNION ALL SELECT run_id, 'audit.transform.out', transformed FROM counts
        UNION ALL SELECT run_id, 'audit.target.enriched.written', written FROM counts""",
)
def audit_counters(spark, folder):
    return audit.counters(_replayed(_events(spark, folder)))


@query(
    "recon_report",
    f"""WITH {_FLOW_SQL}, reported AS ({_report_sql("counts", 3.0)})
        SELECT run_id, job_name, '1d' AS window_label, read AS source_read_count, rejected AS schema_rejected_count,
               transformed AS transformed_count, written AS target_written_count, reconciled, discrepancies,
               read - rejected AS net_input_count, transformed - written AS target_lag
        FROM reported""",
)
def recon_report(spark, folder):
    totals = reconcile.stage_totals(_events(spark, folder), ["run_id", "job_name"])
    day = F.to_timestamp(F.substring("run_id", 5, 8), "yyyyMMdd")
    report = reconcile.report(
        totals, day, day + F.expr("INTERVAL 1 DAY"), reconcile.window_label(F.lit(86_400_000)), 3.0
    )
    return report.drop("window_start", "window_end")


@query(
    "recon_windowed",
    f"""WITH {_FLOW_SQL},
        windowed AS (
          SELECT run_id, 'events-job' AS job_name, time_bucket(INTERVAL 6 HOUR, ts) AS slot, count(*) AS read,
            count(*) FILTER (WHERE error_type IS NOT NULL) AS rejected,
            count(*) FILTER (WHERE passed) AS transformed,
            coalesce(CAST(sum(copies) FILTER (WHERE passed) AS BIGINT), 0) AS written
          FROM staged GROUP BY ALL),
        reported AS ({_report_sql("windowed", 0.0)})
        SELECT run_id, epoch_us(slot) AS window_start, epoch_us(slot + INTERVAL 6 HOUR) AS window_end, '6h' AS window_label,
               read AS source_read_count, rejected AS schema_rejected_count, transformed AS transformed_count,
               written AS target_written_count, reconciled, discrepancies
        FROM reported""",
)
def recon_windowed(spark, folder):
    report = reconcile.by_window(_events(spark, folder), "6h")
    return report.select(
        "run_id",
        F.unix_micros("window_start").alias("window_start"),
        F.unix_micros("window_end").alias("window_end"),
        "window_label",
        "source_read_count",
        "schema_rejected_count",
        "transformed_count",
        "target_written_count",
        "reconciled",
        "discrepancies",
    )


@query(
    "window_label",
    """WITH gaps AS (SELECT event_id, (event_id % 289 - 1) * (CASE event_id % 3 WHEN 0 THEN 30000
                            WHEN 1 THEN 3600000 ELSE 300000 END) AS ms FROM events)
       SELECT event_id, CASE WHEN ms <= 0 THEN 'n/a'
           WHEN ms % 86400000 = 0 THEN (ms // 86400000) || 'd'
           WHEN ms % 3600000 = 0 THEN (ms // 3600000) || 'h'
           WHEN ms % 60000 = 0 THEN (ms // 60000) || 'm'
           ELSE (ms // 1000) || 's' END AS label FROM gaps""",
)
def window_label(spark, folder):
    unit = F.when(F.col("event_id") % 3 == 0, 30000).when(F.col("event_id") % 3 == 1, 3600000).otherwise(300000)
    interval = (F.col("event_id") % 289 - 1) * unit
    return table(spark, folder, "events").select("event_id", reconcile.window_label(interval).alias("label"))


@query(
    "audit_latest_status",
    """WITH life AS (
         SELECT 'run-' || user_id AS run_id, ts, event_id,
           CASE event_type WHEN 'signup' THEN 'SUBMITTING' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'FINISHED'
                           WHEN 'error' THEN 'FAILED' ELSE 'CANCELLED' END AS status
         FROM events)
       SELECT run_id, 'user-job' AS job_name, arg_max(status, ts) AS status, epoch_us(min(ts)) AS submitted_at,
              epoch_us(max(ts)) AS updated_at,
              CASE WHEN arg_max(status, ts) = 'FAILED' THEN 'event ' || arg_max(event_id, ts) END AS error_message
       FROM life GROUP BY run_id""",
)
def audit_latest_status(spark, folder):
    """The fold behind a job table: each user is a run, each event a lifecycle step."""
    kind = F.create_map(
        *[
            F.lit(x)
            for pair in (
                ("signup", audit.JOB_SUBMITTED),
                ("view", audit.JOB_RUNNING),
                ("purchase", audit.JOB_COMPLETED),
                ("error", audit.JOB_FAILED),
                ("click", audit.JOB_CANCELLED),
            )
            for x in pair
        ]
    )
    steps = table(spark, folder, "events").select(
        F.concat(F.lit("run-"), F.col("user_id")).alias("run_id"),
        F.lit("user-job").alias("job_name"),
        F.element_at(kind, F.col("event_type")).alias("event_type"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_json(F.struct(F.concat(F.lit("event "), F.col("event_id")).alias("error"))).alias("metadata"),
        "event_id",
    )
    status = audit.latest_status(steps, F.col("event_id"))
    return status.withColumns(
        {"submitted_at": F.unix_micros("submitted_at"), "updated_at": F.unix_micros("updated_at")}
    )


_RECORDS = """SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 'missing' WHEN o_orderkey % 37 = 0 THEN 'changed'
                               ELSE 'duplicated' END AS status,
              CAST(1 AS BIGINT) AS source_rows,
              CAST(CASE WHEN o_orderkey % 31 = 0 THEN 0 WHEN o_orderkey % 37 = 0 THEN 1 ELSE 2 END AS BIGINT)
                AS target_rows
       FROM orders WHERE o_orderkey % 31 = 0 OR o_orderkey % 37 = 0 OR o_orderkey % 41 = 0
       UNION ALL
       SELECT -o_orderkey, 'unexpected', 0, 1 FROM orders WHERE o_orderkey % 43 = 0 AND o_orderkey <> 0"""


def _damaged_orders(orders):
    """A copy with rows dropped, changed, doubled and invented."""
    key = F.col("o_orderkey")
    copies = F.when(key % 31 == 0, 0).when(key % 37 == 0, 1).when(key % 41 == 0, 2).otherwise(1)
    changed = (key % 37 == 0) & (key % 31 != 0)
    kept = (
        orders.withColumn("o_totalprice", F.when(changed, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies)))
        .drop("_copy")
    )
    invented = orders.where((key % 43 == 0) & (key != 0)).withColumn("o_orderkey", -key)
    return kept.unionByName(invented)


@query("recon_records", _RECORDS)
def recon_records(spark, folder):
    """Orders against a damaged copy."""
    orders = table(spark, folder, "orders")
    found = reconcile.records(orders, _damaged_orders(orders), ["o_orderkey"])
    return found.select("o_orderkey", "status", "source_rows", "target_rows")


@query("recon_digest_drill", _RECORDS)
def recon_digest_drill(spark, folder):
    """The same by snapshots, of which only leaves are read whose digests differ."""
    orders, base = table(spark, folder, "orders"), fresh_path(spark, "digests")
    digests.write_snapshot(orders, f"{base}/source", ["o_orderkey"])
    digests.write_snapshot(_damaged_orders(orders), f"{base}/target", ["o_orderkey"])
    found = digests.drill(spark, f"{base}/source", f"{base}/target", ["o_orderkey"], orders.schema)
    return found.select("o_orderkey", "status", "source_rows", "target_rows")


_DAILY_REJECTS = 8


@query(
    "reject_rate_alert",
    f"""WITH {CLASSED},
        daily AS (SELECT date_trunc('day', ts) AS slot, count(*) AS rejects FROM classed
                  WHERE error_type IS NOT NULL GROUP BY 1)
        SELECT epoch_us(slot) AS window_start, epoch_us(slot + INTERVAL 1 DAY) AS window_end, rejects
        FROM daily WHERE rejects > {_DAILY_REJECTS}""",
)
def reject_rate_alert(spark, folder):
    """Days with more rejects than a bar."""
    events = table(spark, folder, "events")
    raw = events.select("ts", messages.event_text().alias("value"))
    verdicts = ingest.classify(raw, messages.events_schema())
    rejects = ingest.rejected(verdicts).select(F.col("raw.ts").alias("at"))
    alerts = reconcile.reject_alerts(rejects, "at", "1 day", more_than=_DAILY_REJECTS)
    return alerts.select(
        F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_start"),
        F.unix_micros(F.col("window_end").cast("timestamp")).alias("window_end"),
        "rejects",
    )


@query(
    "reject_rate_sustained",
    f"""WITH {CLASSED},
        hourly AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS slot, count(*) AS rejects FROM classed
                   WHERE error_type IS NOT NULL GROUP BY 1 HAVING count(*) > 2)
        SELECT epoch_us(h.slot) AS window_start, h.rejects FROM hourly h
        WHERE EXISTS (SELECT 1 FROM hourly p WHERE p.slot = h.slot - INTERVAL 6 HOUR)
          AND EXISTS (SELECT 1 FROM hourly p WHERE p.slot = h.slot - INTERVAL 12 HOUR)""",
)
def reject_rate_sustained(spark, folder):
    """Three windows in a row above the bar."""
    events = table(spark, folder, "events")
    raw = events.select("ts", messages.event_text().alias("value"))
    verdicts = ingest.classify(raw, messages.events_schema())
    rejects = ingest.rejected(verdicts).select(F.col("raw.ts").alias("at"))
    alerts = reconcile.reject_alerts(rejects, "at", "6 hours", 2, for_windows=3)
    return alerts.select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_start"), "rejects")
