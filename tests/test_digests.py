"""Snapshots compared by digests, against the comparison of all rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import digests, reconcile

KIND = "k bigint, part string, v double, note string"


def tables(spark, seed=1, differ=True):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(400)]), rng.choice(["a", None]), rng.choice([0.5, -0.0, float("nan"), None]), "n") for _ in range(2000)]
    rows += [(7, "hot", 1.0, "same")] * 500
    other = list(rows)
    if differ:
        other = [r for i, r in enumerate(rows) if i % 701 != 3] + rows[5:6] * 2 + [(9000, "new", 1.0, None)]
        other[11] = (*other[11][:3], "changed")
    rng.shuffle(other)
    return spark.createDataFrame(rows, KIND), spark.createDataFrame(other, KIND).select("note", "v", "part", "k")


def shown(df):
    return sorted(map(str, df.select("k", "part", "status", "source_rows", "target_rows").collect()))


@pytest.mark.parametrize("branches, leaves", [(4, 8), (1, 1), (64, 64)])
def test_drill_finds_what_records_finds(spark, tmp_path, branches, leaves):
    source, target = tables(spark)
    target = target.select(*source.columns)
    for name, df in (("s", source), ("t", target)):
        digests.write_snapshot(df, str(tmp_path / name), ["k", "part"], branches, leaves, spread=3)
    found = digests.drill(spark, str(tmp_path / "s"), str(tmp_path / "t"), ["k", "part"], source.schema)
    wanted = shown(reconcile.records(source, target, ["k", "part"]))
    assert shown(found) == wanted and len(wanted) >= 4


def test_what_agrees_is_not_read(spark, tmp_path):
    source, _ = tables(spark)
    changed = source.withColumn("note", F.when((F.col("k") == 17) & F.col("part").isNull(), "other").otherwise(F.col("note")))
    for name, df in (("s", source), ("t", changed), ("same", source.repartition(7))):
        digests.write_snapshot(df, str(tmp_path / name), ["k", "part"], 16, 16)
    s, t, same = (str(tmp_path / n) for n in ("s", "t", "same"))
    assert digests.differing_leaves(spark, s, same) == ([], [])
    assert digests.drill(spark, s, same, ["k", "part"], source.schema).count() == 0
    branches, leaves = digests.differing_leaves(spark, s, t)
    assert len(branches) == len(leaves) == 1 and leaves[0] // 16 == branches[0]
    found = digests.drill(spark, s, t, ["k", "part"], source.schema)
    assert [(r.k, r.part, r.status) for r in found.collect()] == [(17, None, "changed")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_branch", plan) and re.search(r"PushedFilters: \[[^\]]*_leaf", plan)


def test_digests_see_repeats_and_no_order(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, "x"), (1, "a", 1.0, "x"), (2, None, None, None)], KIND)
    of = lambda df: digests.digests(digests.placed(df, ["k"], 1, 1), [digests.BRANCH]).first()
    assert of(rows) == of(rows.orderBy(F.desc("k"))) == of(rows.select("v", "k", "note", "part"))
    assert of(rows) != of(rows.distinct()) and of(rows) != of(rows.union(rows))
    swapped = spark.createDataFrame([(None, "a", 1.0, None), (None, None, 1.0, "a")], KIND)
    a, b = (of(swapped.where(F.col("note").isNull() == x)) for x in (True, False))
    assert a != b


def test_an_empty_side(spark, tmp_path):
    source, _ = tables(spark)
    digests.write_snapshot(source, str(tmp_path / "s"), ["k"], 4, 4)
    digests.write_snapshot(source.where("false"), str(tmp_path / "t"), ["k"], 4, 4)
    found = digests.drill(spark, str(tmp_path / "s"), str(tmp_path / "t"), ["k"], source.schema)
    assert {r.status for r in found.collect()} == {"missing"} and found.count() == source.select("k").distinct().count()
