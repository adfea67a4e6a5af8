import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import audit, reconcile


def _report(spark, counts, tolerance=0.0):
    totals = spark.createDataFrame(
        [("r", "j", *counts)],
        "run_id string, job_name string, source_read_count long, schema_rejected_count long, "
        "transformed_count long, target_written_count long",
    )
    now = F.current_timestamp()
    row = reconcile.report(totals, now, now, F.lit("1h"), tolerance).first()
    return row, json.loads(row["discrepancies"])


@pytest.mark.parametrize(
    "counts, tolerance, texts",
    [
        ((100, 0, 100, 100), 0.0, []),
        ((500, 0, 500, 500), 0.0, []),
        ((100, 5, 95, 95), 0.0, ["Schema validation rejected 5 record(s)"]),
        (
            (100, 0, 100, 90),
            0.0,
            ["Target lag: 100 records transformed but only 90 written (10.00% loss, tolerance=0.00%)"],
        ),
        ((100, 0, 100, 97), 5.0, []),
        ((100, 0, 100, 95), 5.0, []),
        (
            (100, 0, 100, 90),
            5.0,
            ["Target lag: 100 records transformed but only 90 written (10.00% loss, tolerance=5.00%)"],
        ),
        ((100, 0, 100, 110), 50.0, ["Unexpected duplication: 110 written > 100 transformed"]),
        ((0, 0, 0, 10), 0.0, []),
        (
            (3, 5, 0, 0),
            0.0,
            ["Schema validation rejected 5 record(s)", "Invalid state: rejectedCount(5) > sourceReadCount(3)"],
        ),
    ],
)
def test_discrepancies(spark, counts, tolerance, texts):
    row, found = _report(spark, counts, tolerance)
    assert found == texts
    assert row["reconciled"] == (not texts)
    assert row["net_input_count"] == counts[0] - counts[1]
    assert row["target_lag"] == counts[2] - counts[3]


def test_totals_sum_over_sources_and_default_to_zero(spark):
    events = audit.events_frame(
        spark,
        [
            audit.event("r", "j", audit.SOURCE_READ, "source/a", 120),
            audit.event("r", "j", audit.SOURCE_READ, "source/b", 80),
            audit.event("r", "j", audit.SOURCE_REJECTED, "source/b", 10),
            audit.event("other", "j", audit.JOB_SUBMITTED),
        ],
    )
    totals = {r["run_id"]: tuple(r)[2:] for r in reconcile.stage_totals(events, ["run_id", "job_name"]).collect()}
    assert totals == {"r": (200, 10, 0, 0), "other": (0, 0, 0, 0)}


@pytest.mark.parametrize(
    "ms, label",
    [(2 * 86400000, "2d"), (36 * 3600000, "36h"), (7 * 60000, "7m"), (7001, "7s"), (12, "0s"), (-7, "n/a")],
)
def test_window_label(spark, ms, label):
    assert spark.range(1).select(reconcile.window_label(F.lit(ms).cast("bigint"))).first()[0] == label


def test_window_setting():
    assert reconcile.window_interval("5m") == "5 minutes"
    assert reconcile.window_interval("1d") == "1 days"
    for bad in ("", "m", "0h", "5x", "h5", "-1h"):
        with pytest.raises(ValueError):
            reconcile.window_interval(bad)


def test_records_against_brute_force(spark):
    """Random multisets with NULL keys and values, and one key holding a third of all rows."""
    rng = random.Random(7)

    def rows(n):
        return [
            (None if rng.random() < 0.1 else 0 if rng.random() < 0.33 else rng.randrange(40), rng.choice(["a", "b", None]))
            for _ in range(n)
        ]

    source, target = rows(300), rows(300)
    shape = "k int, v string"
    found = reconcile.records(spark.createDataFrame(source, shape), spark.createDataFrame(target, shape), ["k"])
    expected = {}
    for key in {k for k, _ in source + target}:
        s = sorted((str(v) for k, v in source if k == key))
        t = sorted((str(v) for k, v in target if k == key))
        status = (
            "missing" if not t else "unexpected" if not s
            else "duplicated" if len(t) > len(s) else "lost" if len(t) < len(s)
            else "changed" if s != t else None
        )
        if status:
            expected[key] = (status, len(s), len(t))
    assert {r["k"]: (r["status"], r["source_rows"], r["target_rows"]) for r in found.collect()} == expected


def test_sustained_alert(spark):
    minutes = [0] * 5 + [1] * 5 + [2] * 5 + [3] + [4] * 5 + [5] * 5
    rejects = spark.createDataFrame([(m,) for m in minutes], "m int").select(F.timestamp_seconds(F.col("m") * 60).alias("at"))

    def starts(n):
        found = reconcile.reject_alerts(rejects, "at", "1 minute", more_than=3, for_windows=n)
        return sorted(r[0] // 60 for r in found.select(F.unix_seconds("window_start")).collect())

    assert starts(1) == [0, 1, 2, 4, 5]
    assert starts(2) == [1, 2, 5]
    assert starts(3) == [2]
