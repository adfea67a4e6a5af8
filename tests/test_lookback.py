"""As-of joins with a lookback, bounded and as streams, against brute force and the plain as-of join."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.joins import asof_join, asof_within
from millrace.session import fresh_path
from millrace.streaming import event_time
from millrace.streaming.progress import dropped_late

START = dt.datetime(2024, 1, 1)
LEFT = "k string, at timestamp, id int"
RIGHT = "k string, seen timestamp, price int"


def at(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


def brute(left, right, seconds):
    out = []
    for k, t, i in left:
        met = [(s, p) for key, s, p in right if None not in (k, t, s) and key == k and dt.timedelta(0) <= t - s <= dt.timedelta(seconds=seconds)]
        out.append((k, t, i, max(met)[1] if met else None))
    return sorted(out, key=repr)


def data(seed=1):
    rng = random.Random(seed)
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    left = [(key(), at(rng.choice([rng.randint(0, 300), None] + [rng.randint(0, 300)] * 9)), rng.randint(0, 40)) for _ in range(150)]
    right = [(key(), at(rng.choice([rng.randint(0, 300), None] + [rng.randint(0, 300)] * 9)), rng.randint(0, 5)) for _ in range(150)]
    # Repeated rows, and a match at the very end of the lookback.
    return left + left[:5] + [("e", at(60), 1), ("f", at(61), 1)], right + right[:5] + [("e", at(30), 7), ("f", at(30), 7)]


def rows(frame):
    return sorted(map(tuple, frame.select("k", "at", "id", "price").collect()), key=repr)


def test_equals_brute_force(spark):
    left, right = data()
    sides = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    assert rows(asof_within(*sides, ["k"], "at", "seen", ["price"], 1800)) == brute(left, right, 1800)
    assert rows(asof_within(sides[0], sides[1].where("false"), ["k"], "at", "seen", ["price"], 60)) == brute(left, [], 60)
    assert asof_within(sides[0].where("false"), sides[1], ["k"], "at", "seen", ["price"], 60).count() == 0


def test_equals_the_plain_join_where_the_lookback_holds(spark):
    left, right = data(2)
    sides = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    assert rows(asof_within(*sides, ["k"], "at", "seen", ["price"], 301 * 60)) == rows(asof_join(*sides, ["k"], "at", "seen", ["price"]))


@pytest.fixture
def streamed(spark):
    """Runs both sides as streams, a batch to a list of rows of either."""

    def run(batches, seconds):
        base = fresh_path(spark, "lookback")
        for number, (left, right) in enumerate(batches):
            spark.createDataFrame(left, LEFT).coalesce(1).write.parquet(f"{base}/left/{number}")
            spark.createDataFrame(right, RIGHT).coalesce(1).write.parquet(f"{base}/right/{number}")

        def side(name, ddl, column):
            stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", "1").parquet(f"{base}/{name}/*")
            return event_time.with_watermark(stream, column, 60_000)

        joined = asof_within(side("left", LEFT, "at"), side("right", RIGHT, "seen"), ["k"], "at", "seen", ["price"], seconds)
        started = (
            joined.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", f"{base}/checkpoint").start(f"{base}/out")
        )
        started.awaitTermination()
        return rows(spark.read.schema(joined.schema).parquet(f"{base}/out").where("k is null or k <> 'end'")), started

    return run


def ends(day):
    return [("end", at(1440 * day), 0)], [("end", at(1440 * day), 0)]


def test_stream_equals_brute_force(streamed):
    left, right = data(3)
    cut = lambda side, lo, hi: [r for r in side if (lo <= r[1] < hi if r[1] else lo == at(0))]
    batches = [(cut(left, at(lo), at(lo + 100)), cut(right, at(lo), at(lo + 100))) for lo in (0, 100, 200, 300)]
    batches = [b if b[0] and b[1] else ([*b[0], ("end", at(301), 0)], [*b[1], ("end", at(301), 0)]) for b in batches]
    found, started = streamed(batches + [ends(n) for n in (1, 2, 3)], 1800)
    assert found == brute(left, right, 1800)
    assert dropped_late(started) == 0


def test_late_rows_are_counted(streamed):
    """What is behind the watermark neither matches nor comes out, and is counted."""
    first = [("a", at(600), 1)], [("a", at(590), 5)]
    late = [("a", at(10), 2)], [("a", at(9), 6)]
    found, started = streamed([first, ends(1), ends(2), late, ends(3), ends(4)], 1800)
    assert found == [("a", at(600), 1, 5)]
    assert dropped_late(started) >= 2


def test_streams_are_planned_without_an_action(spark):
    side = lambda n: spark.readStream.format("rate").load().select(
        F.col("value").alias("k"), F.col("timestamp").alias(n)
    ).withWatermark(n, "1 minute")
    plan = asof_within(side("at"), side("seen").withColumn("price", F.lit(1)), ["k"], "at", "seen", ["price"], 60)
    assert plan.isStreaming and plan.columns == ["k", "at", "price"]
