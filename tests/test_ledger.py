"""The count ledger: what a round reads, what survives a crash, what sinks get, what is trimmed."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import audit, reconcile
from millrace.plans import runner, sinks, spec
from millrace.plans.spec import SpecError
from millrace.sources import connectors
from millrace.streaming import commit_log, ledger
from millrace.streaming.ledger import OBSERVATIONS, Entry, FileStage, Ledger, Totals

SCHEMA = json.dumps({"properties": {"id": {"type": "integer"}, "amount": {"type": "number"}}, "required": ["id"]})


def put(tmp_path, name, *ids):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text("".join(json.dumps({"id": i, "amount": 1}) + "\n" if i else "oops\n" for i in ids))


def job(tmp_path, **sections):
    base = {
        "jobName": "counted",
        "sources": [{"tableName": "orders", "files": {"path": str(tmp_path / "in")}, "schema": {"definition": SCHEMA}}],
        "transformation": {"sqlContent": "SELECT id, amount FROM orders"},
        "target": {"type": "FILE", "path": str(tmp_path / "out"), "fileFormat": "parquet"},
        "engine": {"checkpointDir": str(tmp_path / "checkpoint")},
        "audit": {"sinkType": "FILE", "destination": str(tmp_path / "audit")},
        "reconciliation": {"sinkType": "LOG"},
    }
    return spec.load({**base, **sections})


def drain(spark, spec_, **options):
    run = runner.run_stream(spark, spec_, available_now=True, **options)
    return run, run.await_end(timeout=300).first()


def counts(row):
    return [row[c] for c in ("source_read_count", "schema_rejected_count", "transformed_count", "target_written_count")]


def test_a_round_reads_only_what_is_new(spark, tmp_path, monkeypatch):
    looked, original = [], ledger._by_batch
    monkeypatch.setattr(ledger, "_by_batch", lambda count, batches: looked.append([f for b in batches for f in b.files]) or original(count, batches))
    for i in range(3):
        put(tmp_path, f"{i}", i * 10 + 1, i * 10 + 2, 0)
        _, row = drain(spark, job(tmp_path))
        assert counts(row) == [3 * (i + 1), i + 1, 2 * (i + 1), 2 * (i + 1)]
    opened = [f for files in looked for f in files]
    assert len(opened) == len(set(opened)) > 0
    # What the queries told is not counted again: only the target's files are.
    assert all("/out/" in f for f in opened)


def test_lost_counts_are_taken_from_the_files_of_those_batches(spark, tmp_path):
    put(tmp_path, "a", 1, 2, 0)
    drain(spark, job(tmp_path))
    put(tmp_path, "b", 3, 0, 0)
    for query in runner.run_stream(spark, job(tmp_path), available_now=True).queries():
        query.awaitTermination()
    OBSERVATIONS.counts.clear()
    put(tmp_path, "c", 4)
    run, row = drain(spark, job(tmp_path))
    assert counts(row) == [7, 3, 4, 4]
    rows = {(r.stage, r.batch): r for r in run.trail.ledger.rows().collect()}
    assert sorted(rows) == [("main", 0), ("main", 1), ("main", 2), ("source", 0), ("source", 1), ("source", 2)]
    assert (rows["source", 1].read, rows["source", 1].rejected, rows["main", 1].written) == (3, 2, 1)


def test_a_target_that_lost_a_file_lags(spark, tmp_path):
    """Also where it held rows before the run, which are not this run's."""
    spark.range(50).selectExpr("cast(id as int) id", "1.0 amount").write.parquet(str(tmp_path / "out"))
    put(tmp_path, "a", 1, 2, 3)
    for query in (begun := runner.run_stream(spark, job(tmp_path), available_now=True)).queries():
        query.awaitTermination()
    whole = begun.await_end(timeout=300).first()
    assert counts(whole) == [3, 0, 3, 3] and whole["reconciled"]
    put(tmp_path, "b", 4, 5)
    begun = runner.run_stream(spark, job(tmp_path), available_now=True)
    for query in begun.queries():
        query.awaitTermination()
    newest = commit_log.sink_batches(spark, str(tmp_path / "out"), 0, 0)[-1]
    for file in newest.files:
        commit_log.delete(spark, file)
    row = begun.await_end(timeout=300).first()
    assert counts(row) == [5, 0, 5, 3] and "only 3 written" in row["discrepancies"]


def test_another_streams_target_is_refused(spark, tmp_path):
    put(tmp_path, "a", 1)
    drain(spark, job(tmp_path))
    with pytest.raises(SpecError, match="another stream"):
        runner.run_stream(spark, job(tmp_path, engine={"checkpointDir": str(tmp_path / "second")}), available_now=True)
    assert not spark.streams.active


def test_a_batch_that_the_ledger_has_is_not_sent_again(spark, tmp_path):
    sent = []

    def write(rows, target):
        sent.append(rows.count())
        connectors.write_outgoing(rows, target)

    target = {"type": "FILE", "path": str(tmp_path / "out"), "fileFormat": "json", "batchColumns": True}
    put(tmp_path, "a", 1, 2)
    run, row = drain(spark, job(tmp_path, target=target), write=write)
    assert counts(row) == [2, 0, 2, 2] and sent == [2]
    # The batch was delivered and counted, but its commit is lost: it comes again.
    for name in ("0", ".0.crc"):
        os.remove(tmp_path / "checkpoint" / "main" / "commits" / name)
    run, row = drain(spark, job(tmp_path, target=target), write=write)
    assert counts(row) == [2, 0, 2, 2] and sent == [2]
    stored = spark.read.json(str(tmp_path / "out"))
    assert [(r.id, r.run_id, r.batch_id) for r in stored.orderBy("id").collect()] == [(1, run.run_id, 0), (2, run.run_id, 0)]
    assert commit_log.names(spark, str(tmp_path / "checkpoint/staged/main")) == []


def test_a_repeated_batch_replaces_itself_in_a_folder(spark, tmp_path):
    target = spec.Target(type="FILE", path=str(tmp_path / "t"), batch_columns=True)
    for rows in (spark.range(5), spark.range(3)):
        connectors.write_batch(rows, target, "run", 7)
    connectors.write_batch(spark.range(2), target, "run", 8)
    assert [connectors.held(spark, target, "run", n) for n in (7, 8, 9)] == [3, 2, 0]
    assert connectors.held(spark, target, "run") == 5 and connectors.held(spark, target, "other") == 0


def test_a_sink_that_fails_now_and_then_gets_every_event_once(spark, tmp_path, monkeypatch):
    taken, turn = [], iter(range(1000))

    def emit(rows, config):
        if next(turn) % 2:
            return False
        taken.extend(r for r in rows.collect() if "event_type" in rows.columns)
        return True

    monkeypatch.setattr(sinks, "emit", emit)
    for i in range(5):
        put(tmp_path, f"{i}", i + 1, 0)
        run = runner.run_stream(spark, job(tmp_path), available_now=True)
        for query in run.queries():
            query.awaitTermination()
        run.poll()
    for _ in range(2):
        run.trail.tell()
    counted = [r for r in taken if r.event_type in (audit.SOURCE_READ, audit.SOURCE_REJECTED, audit.TRANSFORM_OUTPUT, audit.TARGET_WRITTEN)]
    keys = [(r.event_type, json.loads(r.metadata)["batch_id"]) for r in counted]
    assert len(keys) == len(set(keys)) == 20
    assert Ledger(spark, str(tmp_path / "checkpoint/ledger")).untold == []


def test_what_is_done_with_is_trimmed(spark, tmp_path):
    staged = str(tmp_path / "checkpoint" / "staged" / "intake-orders" / "*.parquet")
    sizes = []
    for i in range(4):
        put(tmp_path, f"{i}", i * 3 + 1, i * 3 + 2, 0)
        _, row = drain(spark, job(tmp_path, dlq={"enabled": True, "path": str(tmp_path / "dlq")}))
        sizes.append(len(glob.glob(staged)))
    assert counts(row) == [12, 4, 8, 8]
    # Those of the newest batch stay.
    assert max(sizes) <= 2 * sizes[0] and sizes[-1] <= sizes[0]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 4, 5, 7, 8, 10, 11]
    assert spark.read.text(str(tmp_path / "dlq/orders")).count() == 4


def test_logs_that_repeat_earlier_entries(spark, tmp_path):
    """Every tenth entry of a sink's log holds all before it; own entries may be gone."""
    folder = str(tmp_path / "sink")
    for i in range(12):
        put(tmp_path, f"{i:02}", i + 1)
    rows = spark.readStream.option("maxFilesPerTrigger", "1").text(str(tmp_path / "in"))
    query = rows.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(folder, format="parquet")
    query.awaitTermination()
    log = os.path.join(folder, "_spark_metadata")
    assert "9.compact" in os.listdir(log)
    every = commit_log.sink_batches(spark, folder, -1, 0)
    assert [c.batch for c in every] == list(range(12)) and [c.upto for c in every] == list(range(1, 13))
    assert len({f for c in every for f in c.files}) == 12
    assert commit_log.sink_batches(spark, folder, 9, 10) == every[10:]
    for name in ("7", "8"):
        os.remove(os.path.join(log, name))
    joint = commit_log.sink_batches(spark, folder, 6, 7)
    assert [(c.batch, len(c.files)) for c in joint] == [(9, 3), (10, 1), (11, 1)]
    assert commit_log.committed_upto(spark, str(tmp_path / "cp")) == 11
    assert commit_log.batch_time(spark, str(tmp_path / "cp"), 11) > commit_log.batch_time(spark, str(tmp_path / "cp"), 10)
    assert commit_log.batch_time(spark, str(tmp_path / "cp"), 99) is None
    taken = commit_log.source_files(spark, str(tmp_path / "cp"), 3, 5)
    assert len(taken) == 2


def test_loss_and_duplication_do_not_cancel(spark):
    hour = 3_600_000
    batches = [(0, 10, 10), (1, 20, 15), (2, 30, 35), (3, 5, 5)]
    entries = [Entry("main", "", b, at, 0, {"transformed": t, "written": w}) for (b, t, w), at in zip(batches, (0, 1, 2, hour))]
    windows = ledger.by_window(entries, hour)
    assert sorted(windows) == [0, hour] and windows[0].lag == (20, 15) and windows[0].extra == (30, 35)
    rows = [(at, at + hour, t) for at, t in sorted(windows.items())]
    found = reconcile.report(reconcile.totals_frame(spark, "r", "j", rows), F.lit(0), F.lit(0), F.lit("1h")).collect()
    assert [r.reconciled for r in found] == [False, True]
    assert json.loads(found[0].discrepancies) == [
        "Target lag: 20 records transformed but only 15 written (8.33% loss, tolerance=0.00%)",
        "Unexpected duplication: 35 written > 30 transformed",
    ]
    assert ledger.totals_of([]) == Totals()


def test_folded_events_give_the_same_reports(spark):
    """By a table of events as by totals at hand."""
    events = [
        audit.event("r", "j", kind, "s", n, 1000 * b, {"batch_id": str(b)})
        for b, (t, w) in enumerate([(10, 8), (10, 12), (7, 7)])
        for kind, n in ((audit.TRANSFORM_OUTPUT, t), (audit.TARGET_WRITTEN, w))
    ]
    (row,) = reconcile.by_window(audit.events_frame(spark, events), "1h").collect()
    assert not row.reconciled and row.target_lag == 0
    assert ["lag" in d or "duplication" in d for d in json.loads(row.discrepancies)] == [True, True]


def test_a_stage_waits_for_the_newest_batch_only(spark, tmp_path):
    class Running:
        isActive, runId = True, "nobody"

    folder = str(tmp_path / "sink")
    put(tmp_path, "a", 1)
    rows = spark.readStream.text(str(tmp_path / "in"))
    rows.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(folder, format="parquet").awaitTermination()
    stage = FileStage("source", "t", folder, str(tmp_path / "cp"), lambda files: connectors.rows_by_file(spark, spec.Target(path="x"), files, "read"), query=Running())
    assert stage.news(spark, None) == []
    stage.query = None
    (entry,) = stage.news(spark, None)
    assert entry.counts == {"read": 1} and entry.files == 1 and entry.at_ms > 0
