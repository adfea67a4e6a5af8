"""Audit: counter names, run ids, events from stage counts, latest status per run."""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The event types of the audit trail.
JOB_SUBMITTED = "JOB_SUBMITTED"
JOB_RUNNING = "JOB_RUNNING"
JOB_COMPLETED = "JOB_COMPLETED"
JOB_FAILED = "JOB_FAILED"
JOB_CANCELLED = "JOB_CANCELLED"
SOURCE_READ = "SOURCE_READ"
SOURCE_REJECTED = "SOURCE_REJECTED"
TRANSFORM_OUTPUT = "TRANSFORM_OUTPUT"
TARGET_WRITTEN = "TARGET_WRITTEN"
TARGET_FAILED = "TARGET_FAILED"
RECONCILIATION_COMPLETE = "RECONCILIATION_COMPLETE"
EVENT_TYPES = (
    JOB_SUBMITTED,
    JOB_RUNNING,
    JOB_COMPLETED,
    JOB_FAILED,
    JOB_CANCELLED,
    SOURCE_READ,
    SOURCE_REJECTED,
    TRANSFORM_OUTPUT,
    TARGET_WRITTEN,
    TARGET_FAILED,
    RECONCILIATION_COMPLETE,
)

# Stage labels, job status by lifecycle event, columns of the audit table.
LIFECYCLE_STAGE = "orchestrator"
TRANSFORM_STAGE = "transformation"
STATUS = {
    JOB_SUBMITTED: "SUBMITTING",
    JOB_RUNNING: "RUNNING",
    JOB_COMPLETED: "FINISHED",
    JOB_FAILED: "FAILED",
    JOB_CANCELLED: "CANCELLED",
}
EVENT_SCHEMA = (
    "run_id string, job_name string, event_type string, stage string, "
    "count bigint, ts timestamp, metadata string"
)

# Fixed value: the counter of rows the query gave.
TRANSFORM_OUT = "audit.transform.out"


def _label(name: str | None) -> str:
    return "unknown" if name is None else re.sub(r"[^a-zA-Z0-9_]", "_", name)


def source_read(table: str | None) -> str:
    return f"audit.source.{_label(table)}.read"


def source_rejected(table: str | None) -> str:
    return f"audit.source.{_label(table)}.rejected"


def target_written(topic: str | None) -> str:
    return f"audit.target.{_label(topic)}.written"


def source_stage(topic: str) -> str:
    return f"source/{topic}"


def target_stage(topic: str) -> str:
    return f"target/{topic}"


def new_run_id(job_name: str | None) -> str:
    """``<job>-<epoch ms>-<8 hex digits>``: sortable by start, unique in practice."""
    job = "job" if job_name is None else re.sub(r"[^a-zA-Z0-9_-]", "_", job_name)
    return f"{job}-{time.time_ns() // 1_000_000}-{uuid.uuid4().hex[:8]}"


def event(
    run_id: str,
    job_name: str,
    event_type: str,
    stage: str = LIFECYCLE_STAGE,
    count: int = 0,
    ts_ms: int | None = None,
    metadata: dict[str, str] | None = None,
) -> dict:
    """One audit event as a plain record; ``events_frame`` turns many into rows."""
    if event_type not in EVENT_TYPES:
        raise ValueError(f"unknown audit event type {event_type!r}")
    return {
        "run_id": run_id,
        "job_name": job_name,
        "event_type": event_type,
        "stage": stage,
        "count": count,
        "ts_ms": time.time_ns() // 1_000_000 if ts_ms is None else ts_ms,
        "metadata": None if metadata is None else json.dumps(metadata),
    }


def events_frame(spark: SparkSession, events: list[dict]) -> DataFrame:
    """Event records of one run (a handful per batch) as rows of the audit table."""
    shape = EVENT_SCHEMA.replace("ts timestamp", "ts_ms bigint")
    rows = spark.sql(
        f"SELECT inline(from_json(:events, 'array<struct<{shape.replace(' ', ':').replace(',:', ',')}>>'))",
        args={"events": json.dumps(events)},
    )
    columns = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    return rows.withColumn("ts", F.timestamp_millis("ts_ms")).select(*columns)


def events_from_counts(
    counts: DataFrame, source: Column, target: Column, ts: Column, metadata: Column | None = None
) -> DataFrame:
    """Stage counts (run_id, job_name, read, rejected, transformed, written) as event rows."""
    stages = [
        (SOURCE_READ, F.concat(F.lit(source_stage("")), source), "read"),
        (SOURCE_REJECTED, F.concat(F.lit(source_stage("")), source), "rejected"),
        (TRANSFORM_OUTPUT, F.lit(TRANSFORM_STAGE), "transformed"),
        (TARGET_WRITTEN, F.concat(F.lit(target_stage("")), target), "written"),
    ]
    stacked = F.array(
        *[
            F.struct(F.lit(kind).alias("event_type"), stage.alias("stage"), F.col(count).cast("bigint").alias("count"))
            for kind, stage, count in stages
        ]
    )
    note = F.lit(None).cast("string") if metadata is None else F.to_json(metadata)
    wide = counts.select(
        "run_id", "job_name", stacked.alias("_stages"), ts.cast("timestamp").alias("ts"), note.alias("metadata")
    )
    return wide.select("*", F.inline("_stages")).select(*[c.split()[0] for c in EVENT_SCHEMA.split(", ")])


def once_per_batch(events: DataFrame) -> DataFrame:
    """Count events with a replayed micro-batch folded: the same batch counts once.

    A batch is told by its id and its source table, both in the metadata: two sources may
    read one topic.
    """
    note = lambda name: F.get_json_object("metadata", f"$.{name}")
    lifecycle = events.where(note("batch_id").isNull())
    counted = events.where(note("batch_id").isNotNull())
    counted = counted.withColumns({"_batch": note("batch_id"), "_source": note("source")})
    keys = ["run_id", "job_name", "event_type", "stage"]
    folded = counted.groupBy(*keys, "_batch", "_source").agg(
        F.max_by(F.struct("count", "ts", "metadata"), F.struct("ts", "count")).alias("_e")
    )
    return lifecycle.unionByName(folded.select(*keys, "_e.*").select(*events.columns))


def counters(events: DataFrame) -> DataFrame:
    """Counter values per run, under their names, from count events (each batch once)."""
    label = F.regexp_replace(F.regexp_replace("stage", "^(source|target)/", ""), "[^a-zA-Z0-9_]", "_")
    kind = F.col("event_type")
    name = (
        F.when(kind == SOURCE_READ, F.concat(F.lit("audit.source."), label, F.lit(".read")))
        .when(kind == SOURCE_REJECTED, F.concat(F.lit("audit.source."), label, F.lit(".rejected")))
        .when(kind == TRANSFORM_OUTPUT, F.lit(TRANSFORM_OUT))
        .when(kind == TARGET_WRITTEN, F.concat(F.lit("audit.target."), label, F.lit(".written")))
    )
    named = once_per_batch(events).withColumn("counter", name).where(F.col("counter").isNotNull())
    return named.groupBy("run_id", "counter").agg(F.sum("count").alias("value"))


def latest_status(events: DataFrame, tie: Column | None = None) -> DataFrame:
    """Per run: latest status, first and last event time, and the error of a failed run."""
    is_lifecycle = F.col("event_type").isin(list(STATUS))
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    at = F.struct(F.col("ts"), tie if tie is not None else F.lit(0))
    folded = events.where(is_lifecycle).groupBy("run_id", "job_name").agg(
        F.max_by(F.struct("event_type", "metadata"), at).alias("_e"),
        F.min("ts").alias("submitted_at"),
        F.max("ts").alias("updated_at"),
    )
    failed = F.col("_e.event_type") == JOB_FAILED
    return folded.select(
        "run_id",
        "job_name",
        F.element_at(status, F.col("_e.event_type")).alias("status"),
        "submitted_at",
        "updated_at",
        F.when(failed, F.get_json_object("_e.metadata", "$.error")).alias("error_message"),
    )
