"""The split paths against brute force: one key, and one moment, hold a third of the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import groups, joins, windows
from millrace.operators.sessions import sessions

START = datetime(2024, 1, 1)


def _rows(n=600, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = None if rng.random() < 0.05 else 0 if rng.random() < 0.4 else rng.randrange(1, 12)
        value = None if rng.random() < 0.05 else 7 if rng.random() < 0.33 else rng.randrange(30)
        at = START + timedelta(minutes=0 if rng.random() < 0.2 else rng.randrange(3000))
        out.append((key, i, value, at))
    return out


@pytest.fixture
def data(spark):
    return spark.createDataFrame(_rows(), "k int, id long, v int, at timestamp").repartition(5).cache()


def same(found, expected):
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    key = lambda row: repr(tuple(row))
    left = sorted(found.select(columns).collect(), key=key)
    right = sorted(expected.select(columns).collect(), key=key)
    assert left == right


def plain(*order):
    return Window.partitionBy("k").orderBy(*groups.ordering(list(order)))


def test_running(data, hot):
    sums = {"s": F.col("v").cast("bigint"), "n": F.lit(1).cast("bigint")}
    rows = plain("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(
        windows.running(data, ["k"], ["at", "id"], sums),
        data.select("*", *[F.sum(c).over(rows).alias(n) for n, c in sums.items()]),
    )


@pytest.mark.parametrize("tiles", [1, 4, 7, 1000])
def test_ranked(data, hot, tiles):
    fine, coarse = plain("-v", "id"), plain("-v")
    same(
        windows.ranked(data, ["k"], ["-v"], ["id"], tiles),
        data.select(
            "*",
            F.row_number().over(fine).cast("bigint").alias("row_number"),
            F.rank().over(coarse).cast("bigint").alias("rank"),
            F.dense_rank().over(coarse).cast("bigint").alias("dense_rank"),
            F.ntile(tiles).over(fine).cast("bigint").alias("ntile"),
        ),
    )


@pytest.mark.parametrize("before, after", [(1, 0), (0, 1), (3, 2), (60, 60)])
def test_neighbourhood(data, hot, before, after):
    def build(w):
        return {
            "back": F.lag("id", before).over(w) if before else F.lit(0),
            "ahead": F.lead("id", after).over(w) if after else F.lit(0),
            "near": F.sum("v").over(w.rowsBetween(-before, after)),
        }

    same(
        windows.neighbourhood(data, ["k"], ["at", "id"], before, after, build),
        data.select("*", *[c.alias(n) for n, c in build(plain("at", "id")).items()]),
    )


@pytest.mark.parametrize("order", [["at", "id"], ["-v", "id"], ["v", "-id"]])
def test_edges(data, hot, order):
    whole = plain(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same(
        windows.edges(data, ["k"], {"a": "id", "b": "v"}, {"z": "id"}, order),
        data.select(
            "*", F.first("id").over(whole).alias("a"), F.first("v").over(whole).alias("b"), F.last("id").over(whole).alias("z")
        ),
    )


@pytest.mark.parametrize("limit", [40, 1_000_000])
def test_range_frame(data, spark, hot, limit):
    """NULL keys, times and values, on the split and on the plain path."""
    spark.conf.set(groups.HOT_GROUP_ROWS, str(limit))
    timed = data.withColumn("t", F.when(F.col("id") % 6 != 0, F.unix_seconds("at")))
    frame = Window.partitionBy("k").orderBy("t").rangeBetween(-3600, 0)
    rare = F.when(F.col("id") % 9 == 0, F.col("v")).cast("bigint")
    sums = {"n": F.lit(1).cast("bigint"), "s": F.col("v").cast("bigint"), "r": rare}
    found = windows.range_frame(timed, ["k"], "t", 3600, sums)
    same(found, timed.select("*", *[F.sum(c).over(frame).alias(n) for n, c in sums.items()]))


def test_sums_must_be_exact(data):
    for sums in ({"s": F.col("v").cast("double")}, {"s": F.col("v").cast("float")}):
        with pytest.raises(TypeError, match="decimal"):
            windows.running(data, ["k"], ["id"], sums)
        with pytest.raises(TypeError, match="decimal"):
            windows.range_frame(data.withColumn("t", F.col("id")), ["k"], "t", 5, sums)


@pytest.mark.parametrize("order, keep", [(["at", "id"], "last"), (["-v", "id"], "last"), (["-v", "-id"], "first")])
def test_newest(data, hot, order, keep):
    along = order if keep == "first" else groups.backwards(order)
    expected = data.withColumn("rn", F.row_number().over(plain(*along))).where("rn = 1").drop("rn")
    same(windows.newest_per_key(data, ["k"], order, keep), expected)
    same(windows.newest_per_key(data, ["k"], order, keep, ["v", "k"]), expected.select("v", "k"))


@pytest.mark.parametrize("gap", [60, 600, 100_000])
def test_sessions(data, spark, hot, gap):
    aggs = {"n": F.count(F.lit(1)), "s": F.sum("v")}
    found = sessions(data, ["k"], "at", gap, aggs)
    spark.conf.set(groups.HOT_GROUP_ROWS, "1000000")
    same(found, sessions(data, ["k"], "at", gap, aggs))


@pytest.mark.parametrize("limit", [40, 1_000_000])
def test_asof_join(spark, hot, limit):
    """NULL keys and times match nothing; of equal times the larger row id counts."""
    spark.conf.set(groups.HOT_GROUP_ROWS, str(limit))
    unknown = F.when(F.col("id") % 10 != 0, F.col("at"))
    left = spark.createDataFrame(_rows(400, 1), "k int, id long, v int, at timestamp").withColumn("at", unknown)
    right = spark.createDataFrame(_rows(200, 2), "k int, id long, rv int, at timestamp")
    right = right.select("k", F.col("id").alias("rid"), "rv", unknown.alias("rat"))
    found = joins.asof_join(left, right, ["k"], "at", "rat", ["rid", "rv"], tie=["rid"])
    rows = [r.asDict() for r in right.collect()]
    expected = []
    for r in left.collect():
        prior = [
            p for p in rows
            if None not in (r["k"], r["at"], p["rat"]) and p["k"] == r["k"] and p["rat"] <= r["at"]
        ]
        best = max(prior, key=lambda p: (p["rat"], p["rid"])) if prior else {"rid": None, "rv": None}
        expected.append((r["id"], best["rid"], best["rv"]))
    assert sorted(map(repr, [tuple(x) for x in found.select("id", "rid", "rv").collect()])) == sorted(map(repr, expected))


def test_interval_join_finds_each_pair_once(spark):
    left = spark.createDataFrame(_rows(200, 5), "k int, id long, v int, at timestamp")
    right = spark.createDataFrame(_rows(200, 6), "k int, rid long, rv int, rat timestamp")
    found = joins.interval_join(left, right, ["k"], "at", "rat", 3600).select("id", "rid").collect()
    expected = [
        (a["id"], b["rid"])
        for a in left.collect()
        for b in right.collect()
        if a["k"] is not None and a["k"] == b["k"] and a["at"] <= b["rat"] <= a["at"] + timedelta(hours=1)
    ]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_range_join_edges(spark):
    points = spark.createDataFrame([(float(x) / 4,) for x in range(-8, 50)], "x double")
    ranges = spark.createDataFrame([(1, -1.0, 0.5), (2, 0.5, 10.0), (3, 3.0, 3.0), (4, 9.75, 11.0), (5, -1e9, 1e9), (6, 2.0, 2.0001), (7, None, 5.0)], "r int, lo double, hi double")
    found = joins.range_join(points, ranges, "x", "lo", "hi").select("x", "r").collect()
    expected = [
        (p["x"], r["r"])
        for p in points.collect()
        for r in ranges.collect()
        if r["lo"] is not None and r["lo"] <= p["x"] < r["hi"]
    ]
    assert sorted(map(tuple, found)) == sorted(expected)


@pytest.fixture
def splits(monkeypatch):
    """The part sizes of every split that is made."""
    seen, of = [], groups.Split.of.__func__

    def spy(cls, df, keys, order, rows):
        split = of(cls, df, keys, order, rows)
        seen.append([r["count"] for r in split.df.groupBy(groups.PART).count().collect()])
        return split

    monkeypatch.setattr(groups.Split, "of", classmethod(spy))
    return seen


def test_a_split_bounds_every_part(data, spark, hot, splits):
    _, heated, rows = groups.by_heat(data, ["k"])
    groups.Split.of(heated, ["k"], ["at", "id"], rows)
    assert sum(splits[0]) == rows and len(splits[0]) > 1
    assert max(splits[0]) <= 3 * groups.hot_group_rows(spark)


def test_one_moment_is_split_too(spark, hot, splits):
    """All rows of one key, and nearly all of them at one moment."""
    rows = [(0, i, 1, START if i else START - timedelta(hours=9)) for i in range(900)]
    same_moment = spark.createDataFrame(rows, "k int, id long, v int, at timestamp").repartition(6)
    found = sessions(same_moment, ["k"], "at", 60, {"n": F.count(F.lit(1))})
    assert sorted(r["n"] for r in found.collect()) == [1, 899]
    right = spark.createDataFrame([(0, 7, START - timedelta(hours=1))], "k int, rid long, rat timestamp")
    joined = joins.asof_join(same_moment, right, ["k"], "at", "rat", ["rid"])
    assert joined.where("rid = 7").count() == 899 and joined.count() == 900
    assert len(splits) == 2 and max(splits[1]) <= 3 * groups.hot_group_rows(spark)
    assert sum(splits[0]) == 2 and sum(splits[1]) == 901


def test_heat_is_found_once_and_shared(data, hot, monkeypatch):
    heat = groups.Heat.found(data, ["k"])
    assert heat.rows > 0
    monkeypatch.setattr(groups.Heat, "found", None)
    sums = {"n": F.lit(1).cast("bigint")}
    totals = windows.running(data, ["k"], ["at", "id"], sums, heat)
    moving = windows.neighbourhood(totals, ["k"], ["at", "id"], 1, 0, lambda w: {"b": F.lag("id").over(w)}, heat)
    assert moving.count() == data.count()
    cold = windows.running(data, ["k"], ["at", "id"], sums, groups.Heat(["k"]))
    same(cold, totals)
    with pytest.raises(ValueError):
        windows.running(data, ["v"], ["at", "id"], sums, heat)


def test_ordinary_groups_stay_on_the_plain_path(data):
    cold, heated, rows = groups.by_heat(data, ["k"])
    assert heated is None and rows == 0 and cold is data


INF, NAN = float("inf"), float("nan")


def below(a, b):
    """As in SQL: NaN is above everything."""
    return False if a is None or b is None or a != a else True if b != b else a < b


def not_above(a, b):
    return a is not None and b is not None and (below(a, b) or a == b or (a != a and b != b))


ENDS = [None, -INF, -1e308, -5.5, 0.0, 1e-300, 3.0, 4.0, 1e17, 1e300, 1e308, INF, NAN]


def test_range_join_without_ends(spark):
    points = spark.createDataFrame([(x,) for x in [*ENDS, 3.5, -1e200, 2.0**70]], "x double")
    ranges = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in ENDS for b in ENDS)]
    laid = spark.createDataFrame(ranges, "r int, lo double, hi double")
    wanted = sorted((x, r) for (x,) in points.collect() for r, a, b in ranges if not_above(a, x) and below(x, b) and below(a, b))
    found = joins.range_join(points, laid, "x", "lo", "hi").select("x", "r").collect()
    assert sorted(map(tuple, found)) == wanted
    # With the levels at hand nothing is run while the plan is built.
    levels = joins.levels_of(laid, "lo", "hi")
    spark.sparkContext.setJobGroup("lazy", "no job")
    lazy = joins.range_join(points, laid, "x", "lo", "hi", levels)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, lazy.select("x", "r").collect())) == wanted


def test_overlaps_are_told_once(spark):
    rng = random.Random(4)
    ends = [-INF, INF, None, NAN, *[rng.uniform(-50, 50) for _ in range(30)], *range(-5, 6)]
    side = lambda n: [(i, rng.choice(ends), rng.choice(ends)) for i in range(n)]
    one, two = side(120) + [(500, 0.0, 3.0)] * 2, side(120) + [(600, 0.0, 3.0), (601, 3.0, 4.0), (602, -1.0, 0.0)]
    as_double = lambda rows: [(i, *(None if x is None else float(x) for x in r)) for i, *r in rows]
    left = spark.createDataFrame(as_double(one), "a int, al double, ah double")
    right = spark.createDataFrame(as_double(two), "b int, bl double, bh double")
    wanted = sorted(
        (a, b) for a, al, ah in as_double(one) for b, bl, bh in as_double(two)
        if below(al, bh) and below(bl, ah) and below(al, ah) and below(bl, bh)
    )
    found = joins.overlap_join(left, right, "al", "ah", "bl", "bh").select("a", "b").collect()
    assert sorted(map(tuple, found)) == wanted


def test_a_hot_bin_is_split(spark):
    """A third of all points in one bin: the join's partitions are cut, and nothing is lost."""
    points = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 1000 + 0.5).alias("x"))
    ranges = spark.createDataFrame([(i, float(i), float(i + 1)) for i in range(1000)], "r int, lo double, hi double")
    joined = joins.range_join(points, ranges, "x", "lo", "hi")
    assert joined.groupBy("r").count().where("r = 5").first()["count"] == 20_000 + points.where("x > 5 and x < 6").count()
    assert joined.count() == 60_000


def test_endless_ranges_meet_points_in_bounded_tasks(spark, monkeypatch):
    """However few bytes they have, the pairs of points and ranges without end are dealt to as many tasks as they need."""
    monkeypatch.setattr(joins, "ENDLESS_ROWS", 32, raising=False)
    monkeypatch.setattr(joins, "ENDLESS_PAIRS", 1000, raising=False)
    points = spark.range(600).select((F.col("id") * 1.0).alias("x"))
    ranges = spark.range(100).select(F.col("id").alias("r"), (F.col("id") * 5.0).alias("lo"), F.lit(float("inf")).alias("hi"))
    joined = joins.range_join(points, ranges, "x", "lo", "hi")
    sizes = [len(part) for part in joined.select("x", "r").rdd.glom().collect()]
    assert sum(sizes) == sum(600 - 5 * r for r in range(100))
    assert sum(1 for s in sizes if s) > 20 and max(sizes) < sum(sizes) / 8
