"""Distinct counts over spans: the exact ones against sets, the estimates against their stated error."""

import datetime as dt
import random

from pyspark.sql import functions as F

from millrace.operators import distincts

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def spans_of(spark, *spans):
    return spark.createDataFrame([(name, day(a), day(b)) for name, a, b in spans], "span string, first_day date, last_day date")


SPANS = [("one", 0, 0), ("week", 1, 7), ("over", 5, 9), ("whole", 0, 9), ("none", 40, 50), ("backwards", 7, 3)]


def test_counts_over_spans(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y", None]), dt.datetime(2024, 1, 1 + rng.randint(0, 9), rng.randint(0, 23)), rng.choice([None, *range(60)])) for _ in range(900)]
    rows += [("x", None, 99), ("n", dt.datetime(2024, 1, 3), None)] + rows[:20]
    events = spark.createDataFrame([(*r, "e") for r in rows], "k string, ts timestamp, v int, span string")
    spans = spans_of(spark, *SPANS)
    wanted = {}
    for name, a, b in SPANS:
        for k, t, v in rows:
            if t is not None and v is not None and day(a) <= t.date() <= day(b):
                wanted.setdefault((k, name), set()).add(v)
    wanted = {at: len(values) for at, values in wanted.items()}
    counted = distincts.exact(events, ["k"], "ts", "v", spans)
    assert {(r.k, r.span): r.exact for r in counted.collect()} == wanted
    found = distincts.estimated(distincts.day_sketches(events, ["k"], "ts", "v"), ["k"], spans)
    # So few values are counted exactly by a sketch.
    assert {(r.k, r.span): r.estimate for r in found.collect()} == wanted
    assert distincts.exact(events.where("false"), ["k"], "ts", "v", spans).count() == 0
    assert distincts.day_sketches(events.where("false"), ["k"], "ts", "v").count() == 0


def test_many_values_stay_within_the_error(spark):
    """Days overlap, one key holds most rows, and the sketches of one day come in two sizes."""
    ids = spark.range(200_000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"),
        F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") % 10) * 86_400).alias("ts"),
        (F.col("id") % 70_001).alias("v"),
    )
    spans = spans_of(spark, ("whole", 0, 9), ("part", 2, 4))
    small = distincts.day_sketches(ids.where("v % 2 = 0"), ["k"], "ts", "v", bits=12)
    sketches = small.unionByName(distincts.day_sketches(ids.where("v % 2 = 1"), ["k"], "ts", "v"))
    both = distincts.estimated(sketches, ["k"], spans).join(distincts.exact(ids, ["k"], "ts", "v", spans), ["k", "span"])
    held = both.select(distincts.within(F.col("estimate"), F.col("exact"), 12).alias("near"), "exact").collect()
    assert len(held) == 3 and all(r.near and r.exact > 5_000 for r in held)


def test_tasks_sketch_before_the_shuffle(spark):
    events = spark.range(10).select(F.lit("k").alias("k"), F.current_timestamp().alias("ts"), F.col("id").alias("v"))
    plan = distincts.day_sketches(events, ["k"], "ts", "v")._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketch_agg" in plan
