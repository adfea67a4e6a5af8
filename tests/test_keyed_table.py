"""First rows per key over batches, with repeats, compactions and crashes in between."""

import random

import pytest

from millrace.streaming import commit_log, keyed_table
from millrace.streaming.keyed_table import KeyedTable

KIND = "k bigint, at bigint, v string"


def brute(rows, n, newest=True):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    sign = -1 if newest else 1
    return sorted((r for own in out.values() for r in sorted(own, key=lambda r: sign * r[1])[:n]), key=str)


def shown(table):
    return sorted(map(tuple, table.read().collect()), key=str)


@pytest.mark.parametrize("n, compact", [(1, 2), (3, 3), (2, 100)])
def test_batches(spark, tmp_path, n, compact):
    rng, rows = random.Random(n), []
    schema = spark.createDataFrame([], KIND).schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], ["-at"], n, compact)
    assert table.read().count() == 0
    times = rng.sample(range(10_000), 700)
    for number in range(7):
        part = [(rng.choice([None, 1, 1, 1, *range(20)]), times.pop(), rng.choice("abc")) for _ in range(rng.choice([0, 5, 90]))]
        rows += part
        batch = spark.createDataFrame(part, KIND).select("v", "k", "at")
        table.apply(batch, number)
        if number % 2:  # the batch comes again
            table.apply(batch, number)
        assert shown(table) == brute(rows, n)
    deltas = commit_log.names(spark, str(tmp_path / "t/deltas"))
    assert len(deltas) < compact and len(commit_log.names(spark, str(tmp_path / "t/base"))) <= 1
    # A batch that the base has changes nothing, even if it came with other rows.
    if table.base() >= 0:
        table.apply(spark.createDataFrame([(1, 10**9, "x")], KIND), table.base())
        assert shown(table) == brute(rows, n)


def test_a_crash_while_compacting(spark, tmp_path, monkeypatch):
    """The new base is there but not its number: the old one counts, and the next attempt succeeds."""
    schema = spark.createDataFrame([], KIND).schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], ["at"], 1, 2)
    table.apply(spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], KIND), 0)
    with monkeypatch.context() as broken:
        broken.setattr(keyed_table.commit_log, "write_text", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            table.apply(spark.createDataFrame([(1, 4, "c")], KIND), 1)
    assert table.base() == -1 and shown(table) == [(1, 4, "c"), (2, 5, "b")]
    table.apply(spark.createDataFrame([(1, 4, "c")], KIND), 1)
    assert table.base() == 1 and shown(table) == [(1, 4, "c"), (2, 5, "b")]


def test_a_delta_cut_short_does_not_count(spark, tmp_path):
    schema = spark.createDataFrame([], KIND).schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], ["at"], 1, 50)
    table.apply(spark.createDataFrame([(1, 5, "a")], KIND), 0)
    table.apply(spark.createDataFrame([(1, 1, "b")], KIND), 1)
    commit_log.delete(spark, str(tmp_path / "t/deltas/1/_SUCCESS"))
    assert shown(table) == [(1, 5, "a")]


def test_rows_that_the_order_does_not_tell_apart(spark, tmp_path):
    rows = [(1, 3, v) for v in "abcdef"] * 2
    schema, found = spark.createDataFrame([], KIND).schema, []
    for name, parts in (("x", [rows]), ("y", [rows[:4], rows[4:7], rows[7:]])):
        table = KeyedTable(spark, str(tmp_path / name), schema, ["k"], ["at"], 4, 2)
        for number, part in enumerate(parts):
            table.apply(spark.createDataFrame(part, KIND).repartition(3), number)
        found.append(shown(table))
    assert found[0] == found[1] and len(found[0]) == 4


def test_a_task_passes_on_few_rows_of_a_key(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], KIND).schema, ["k"], ["-at"], 2)
    plan = table.first(spark.createDataFrame([(1, 1, "a")], KIND))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
