"""Moving extremes and segmented lists, plain and split, against Spark's own windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import collect, extremes, groups
from tests.test_hot_groups import _rows, plain, same, splits  # noqa: F401

LIMITS = [40, 1_000_000]


def wanted_columns():
    return {"low": ("min", F.col("v")), "high": ("max", F.col("v")), "rare": ("max", F.when(F.col("id") % 17 == 0, F.col("x")))}


@pytest.fixture
def timed(spark):
    """NULL keys, times and values; one key and one moment with a third of the rows; times on both sides of zero."""
    data = spark.createDataFrame(_rows(), "k int, id long, v int, at timestamp").repartition(5)
    minute = F.unix_seconds("at") / 60 - F.lit(1704067200 / 60 + 1500)
    odd = F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).when(F.col("id") % 4 == 1, F.lit(float("-inf"))).otherwise(F.col("id").cast("double"))
    return data.select("k", "id", "v", F.when(F.col("id") % 6 != 0, minute.cast("bigint")).alias("t"), odd.alias("x")).cache()


def spark_own(df, window):
    return df.select("*", *[getattr(F, kind)(c).over(window).alias(n) for n, (kind, c) in wanted_columns().items()])


def shown(df):
    """NaN compares equal to itself as text."""
    return df.withColumn("x", F.col("x").cast("string")).withColumn("rare", F.col("rare").cast("string"))


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("width", [0, 1, 60, 100_000])
def test_range_extremes(timed, spark, hot, limit, width):
    spark.conf.set(groups.HOT_GROUP_ROWS, str(limit))
    frame = Window.partitionBy("k").orderBy("t").rangeBetween(-width, 0)
    same(shown(extremes.range_extremes(timed, ["k"], "t", width, wanted_columns())), shown(spark_own(timed, frame)))


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("before", [0, 2, 50, 10_000])
def test_rows_extremes(timed, spark, hot, limit, before):
    spark.conf.set(groups.HOT_GROUP_ROWS, str(limit))
    frame = plain("t", "id").rowsBetween(-before, 0)
    same(shown(extremes.rows_extremes(timed, ["k"], ["t", "id"], before, wanted_columns())), shown(spark_own(timed, frame)))


def test_no_rows_and_no_frame(timed):
    assert extremes.range_extremes(timed.where("false"), ["k"], "t", 5, wanted_columns()).count() == 0
    for wrong in (lambda: extremes.range_extremes(timed, ["k"], "t", -1, wanted_columns()), lambda: extremes.rows_extremes(timed, ["k"], ["id"], -1, wanted_columns())):
        with pytest.raises(ValueError):
            wrong()


def test_a_hot_block_is_split(spark, hot, splits):  # noqa: F811
    """One key, and all its rows in one block."""
    rows = spark.range(900).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") * 7919 % 1000).alias("v"))
    found = extremes.range_extremes(rows, ["k"], "t", 5000, {"low": ("min", F.col("v"))})
    least, wanted = 1000, []
    for t in range(900):
        least = min(least, t * 7919 % 1000)
        wanted.append((t, least))
    assert [tuple(r) for r in found.orderBy("t").select("t", "low").collect()] == wanted
    assert splits and all(max(sizes) <= 3 * groups.hot_group_rows(spark) for sizes in splits)


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_segments(timed, spark, hot, limit, size):
    """Segments in order are the whole list, NULLs in place; no segment is longer than asked."""
    spark.conf.set(groups.HOT_GROUP_ROWS, str(limit))
    listed = collect.joined(collect.segments(timed, ["k"], ["-t", "id"], "v", size), "|").orderBy("k", "segment").collect()
    whole = {}
    for r in sorted(timed.collect(), key=lambda r: (r.t is None, -(r.t or 0), r.id)):
        whole.setdefault(r.k, []).append(r.v)
    found, texts = {}, {}
    for r in listed:
        assert len(r.values) <= size and r.segment * size == len(found.setdefault(r.k, []))
        found[r.k] += r.values
        texts.setdefault(r.k, []).append(r.text)
    assert found == whole
    for k, values in whole.items():
        assert "|".join(t for t in texts[k] if t is not None) == "|".join(str(v) for v in values if v is not None)
    assert collect.segments(timed.where("false"), ["k"], ["id"], "v").count() == 0
    with pytest.raises(ValueError):
        collect.segments(timed, ["k"], ["id"], "v", 0)
