import json
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import audit


@pytest.mark.parametrize(
    "name, shown",
    [
        ("Meters_9", "Meters_9"),
        ("a.b-c:d", "a_b_c_d"),
        ("größe", "gr__e"),
        ("", ""),
        (None, "unknown"),
    ],
)
def test_counter_names(name, shown):
    assert audit.source_read(name) == f"audit.source.{shown}.read"
    assert audit.source_rejected(name) == f"audit.source.{shown}.rejected"
    assert audit.target_written(name) == f"audit.target.{shown}.written"


def test_run_ids():
    first, second = audit.new_run_id("my job/1"), audit.new_run_id("my job/1")
    assert first != second
    assert re.fullmatch(r"my_job_1-\d{13}-[0-9a-f]{8}", first)
    assert audit.new_run_id(None).startswith("job-")
    assert audit.new_run_id("a-b_c").startswith("a-b_c-")


def test_event_types_and_defaults(spark):
    assert len(audit.EVENT_TYPES) == len(set(audit.EVENT_TYPES)) == 11
    record = audit.event("r", "j", audit.JOB_FAILED, metadata={"error": "boom"})
    assert record["stage"] == "orchestrator" and record["count"] == 0 and record["ts_ms"] > 0
    assert json.loads(record["metadata"]) == {"error": "boom"}
    with pytest.raises(ValueError):
        audit.event("r", "j", "SOMETHING_ELSE")
    row = audit.events_frame(spark, [record]).first()
    assert row["event_type"] == "JOB_FAILED" and row["ts"] is not None


def test_events_of_one_run(spark):
    counts = spark.createDataFrame(
        [("r", "orders-job", 1000, 5, 995, 995)],
        "run_id string, job_name string, read long, rejected long, transformed long, written long",
    )
    events = audit.events_from_counts(counts, F.lit("orders"), F.lit("enriched"), F.current_timestamp())
    got = {(r["event_type"], r["stage"], r["count"]) for r in events.collect()}
    assert got == {
        ("SOURCE_READ", "source/orders", 1000),
        ("SOURCE_REJECTED", "source/orders", 5),
        ("TRANSFORM_OUTPUT", "transformation", 995),
        ("TARGET_WRITTEN", "target/enriched", 995),
    }


def _events(spark, *steps):
    return audit.events_frame(
        spark, [audit.event("r", "j", kind, count=n, ts_ms=at, metadata=meta) for at, kind, n, meta in steps]
    )


def test_a_replayed_batch_counts_once(spark):
    events = _events(
        spark,
        (0, audit.JOB_SUBMITTED, 0, None),
        (1, audit.SOURCE_READ, 10, {"batch_id": "0"}),
        (2, audit.SOURCE_READ, 11, {"batch_id": "0"}),
        (3, audit.SOURCE_READ, 5, {"batch_id": "1"}),
    )
    folded = audit.once_per_batch(events)
    assert folded.where("event_type = 'SOURCE_READ'").agg(F.sum("count")).first()[0] == 16
    assert folded.where("event_type = 'JOB_SUBMITTED'").count() == 1


@pytest.mark.parametrize(
    "last, status, error",
    [
        (audit.JOB_COMPLETED, "FINISHED", None),
        (audit.JOB_FAILED, "FAILED", "boom"),
        (audit.JOB_CANCELLED, "CANCELLED", None),
        (audit.JOB_RUNNING, "RUNNING", None),
    ],
)
def test_latest_status(spark, last, status, error):
    events = _events(
        spark,
        (1000, audit.JOB_SUBMITTED, 0, None),
        (2000, audit.SOURCE_READ, 9, None),
        (3000, last, 0, {"error": "boom"}),
        (9000, audit.RECONCILIATION_COMPLETE, 0, None),
    )
    row = audit.latest_status(events).withColumn("from", F.unix_millis("submitted_at")).first()
    assert (row["status"], row["error_message"], row["from"]) == (status, error, 1000)


def test_counters_carry_the_same_names(spark):
    events = audit.events_frame(
        spark,
        [
            audit.event("r", "j", audit.SOURCE_READ, audit.source_stage("my/topic.v2"), 3),
            audit.event("r", "j", audit.SOURCE_READ, audit.source_stage("my/topic.v2"), 4),
            audit.event("r", "j", audit.TARGET_WRITTEN, audit.target_stage("out"), 5),
            audit.event("r", "j", audit.JOB_COMPLETED),
        ],
    )
    got = {r["counter"]: r["value"] for r in audit.counters(events).collect()}
    assert got == {audit.source_read("my/topic.v2"): 7, audit.target_written("out"): 5}


def test_texts_with_quotes_survive(spark):
    record = audit.event("r'1", 'j"2', audit.JOB_FAILED, metadata={"error": "it's \\ \"bad\" \n\u00e9"})
    row = audit.events_frame(spark, [record]).first()
    assert (row["run_id"], row["job_name"]) == ("r'1", 'j"2')
    assert json.loads(row["metadata"]) == {"error": "it's \\ \"bad\" \n\u00e9"}
