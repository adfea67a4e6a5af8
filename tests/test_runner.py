import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import audit
from millrace.plans import runner, spec, transform
from millrace.plans.spec import SpecError, Transformation
from millrace.streaming import event_time

SCHEMA = json.dumps(
    {"properties": {"id": {"type": "integer"}, "amount": {"type": "number"}, "at": {"type": "string"}}, "required": ["id"]}
)


def write_lines(folder, name, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(line + "\n" for line in lines))


def order(i, amount, at="2024-01-01 00:00:00"):
    return json.dumps({"id": i, "amount": amount, "at": at})


@pytest.fixture
def job(tmp_path):
    """A job over message files; keyword arguments replace sections."""

    def make(sql="SELECT id, amount FROM orders WHERE amount > 10", **sections):
        base = {
            "jobName": "orders job",
            "sources": [{"tableName": "orders", "files": {"path": str(tmp_path / "in")}, "schema": {"definition": SCHEMA}}],
            "transformation": {"sqlContent": sql},
            "target": {"type": "FILE", "path": str(tmp_path / "out"), "fileFormat": "json"},
            "engine": {"checkpointDir": str(tmp_path / "checkpoint")},
            "dlq": {"enabled": True, "path": str(tmp_path / "dlq")},
            "audit": {"sinkType": "FILE", "destination": str(tmp_path / "audit"), "tags": {"team": "x"}},
            "reconciliation": {"sinkType": "FILE", "destination": str(tmp_path / "reports")},
        }
        return spec.load({**base, **sections})

    return make


def kinds(spark, tmp_path):
    rows = spark.read.schema(audit.EVENT_SCHEMA).parquet(str(tmp_path / "audit")).collect()
    steps = ["JOB_SUBMITTED", "JOB_RUNNING", "SOURCE_READ", "SOURCE_REJECTED", "TRANSFORM_OUTPUT", "TARGET_WRITTEN"]
    rank = lambda r: steps.index(r["event_type"]) if r["event_type"] in steps else len(steps)
    rows.sort(key=lambda r: (rank(r), r["ts"]))
    return [(r["event_type"], r["stage"].split("/")[0], r["count"]) for r in rows]


# -- SQL text -----------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["INLINE", "inline", None])
def test_inline_sql(spark, kind):
    assert transform.resolve_sql(spark, Transformation(kind, "SELECT a FROM b")) == "SELECT a FROM b"


def test_sql_from_a_file(spark, tmp_path):
    path = tmp_path / "q.sql"
    path.write_text("SELECT 1 AS x\nWHERE true")
    assert transform.resolve_sql(spark, Transformation("FILE", None, str(path))) == "SELECT 1 AS x\nWHERE true"
    assert transform.resolve_sql(spark, Transformation("INLINE", "", str(path))) == "SELECT 1 AS x\nWHERE true"
    assert transform.resolve_sql(spark, Transformation("INLINE", "SELECT 2", str(path))) == "SELECT 2"


@pytest.mark.parametrize(
    "bad", [Transformation("INLINE", ""), Transformation(), Transformation("FILE"), Transformation("PYTHON", "print(1)")]
)
def test_sql_errors(spark, bad):
    with pytest.raises(SpecError):
        transform.resolve_sql(spark, bad)


def test_the_result_becomes_a_view(spark):
    transform.run_sql(spark, Transformation(sql_content="SELECT 7 AS x", result_table_name="sevens"))
    assert spark.table("sevens").first()[0] == 7


# -- bounded runs -------------------------------------------------------------------


def test_batch_run(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", order(1, 5), order(2, 50), "oops", '{"amount":1}', order(3, 11))
    run = runner.run_batch(spark, job())
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [2, 3]
    letters = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "dlq/orders")).collect()]
    assert sorted(x["errorType"] for x in letters) == ["MALFORMED", "SCHEMA_VALIDATION"]
    report = run.report.first()
    assert [report[c] for c in ("source_read_count", "schema_rejected_count", "transformed_count", "target_written_count")] == [5, 2, 2, 2]
    assert not report["reconciled"] and json.loads(report["discrepancies"]) == ["Schema validation rejected 2 record(s)"]
    assert kinds(spark, tmp_path) == [
        ("JOB_SUBMITTED", "orchestrator", 0),
        ("JOB_RUNNING", "orchestrator", 0),
        ("SOURCE_READ", "source", 5),
        ("SOURCE_REJECTED", "source", 2),
        ("TRANSFORM_OUTPUT", "transformation", 2),
        ("TARGET_WRITTEN", "target", 2),
        ("JOB_COMPLETED", "orchestrator", 0),
        ("RECONCILIATION_COMPLETE", "orchestrator", 0),
    ]
    stored = spark.read.parquet(str(tmp_path / "reports"))
    assert stored.count() == 1 and stored.first()["run_id"] == run.run_id and stored.first()["window_label"] == "1h"
    tags = spark.read.parquet(str(tmp_path / "audit")).select(F.get_json_object("metadata", "$.team")).distinct().collect()
    assert [r[0] for r in tags] == ["x"]


def test_batch_without_rejects_reconciles(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", order(1, 50), order(2, 60))
    run = runner.run_batch(spark, job(dlq={"enabled": False}))
    assert run.report.first()["reconciled"]


def test_batch_of_an_aggregate_counts_results(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", *[order(i, i % 3) for i in range(30)])
    run = runner.run_batch(spark, job("SELECT amount, count(*) AS n FROM orders GROUP BY amount"))
    report = run.report.first()
    assert (report["source_read_count"], report["transformed_count"], report["target_written_count"]) == (30, 3, 3)


def test_two_sources_and_an_alias(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", order(1, 50), order(2, 60))
    spark.createDataFrame([(1, "ann")], "id int, name string").write.parquet(str(tmp_path / "people"))
    two = job(
        "SELECT o.id, p.name FROM orders o JOIN p ON o.id = p.id",
        sources=[
            {"tableName": "orders", "files": {"path": str(tmp_path / "in")}, "schema": SCHEMA},
            {"tableName": "people", "alias": "p", "files": {"path": str(tmp_path / "people"), "format": "parquet"}},
        ],
    )
    run = runner.run_batch(spark, two)
    assert spark.read.json(str(tmp_path / "out")).collect()[0].asDict() == {"id": 1, "name": "ann"}
    assert run.report.first()["source_read_count"] == 3


def test_a_failed_run_is_recorded_and_raised(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", order(1, 50))
    with pytest.raises(Exception, match="nowhere"):
        runner.run_batch(spark, job("SELECT * FROM nowhere"))
    events = spark.read.parquet(str(tmp_path / "audit"))
    status = audit.latest_status(events).first()
    assert status["status"] == "FAILED" and "nowhere" in status["error_message"]


def test_a_failed_target_is_recorded(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", order(1, 50))
    (tmp_path / "out").mkdir()
    taken = {"type": "FILE", "path": str(tmp_path / "out"), "fileFormat": "json", "mode": "errorifexists"}
    with pytest.raises(Exception, match="exists"):
        runner.run_batch(spark, job(target=taken))
    names = [k for k, _, _ in kinds(spark, tmp_path)]
    assert sorted(names) == ["JOB_FAILED", "JOB_RUNNING", "JOB_SUBMITTED", "TARGET_FAILED"]


def test_without_audit_nothing_is_kept_but_the_result(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", order(1, 50))
    run = runner.run_batch(spark, job(audit=None, reconciliation=None, dlq={}))
    assert run.report is None and not (tmp_path / "audit").exists()
    assert spark.read.json(str(tmp_path / "out")).count() == 1


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv", "text"])
def test_file_targets(spark, tmp_path, job, fmt):
    write_lines(tmp_path / "in", "a", order(1, 50), order(2, 70))
    target = {"type": "FILE", "path": str(tmp_path / "out"), "fileFormat": fmt}
    runner.run_batch(spark, job(target=target))
    back = spark.read.format(fmt).load(str(tmp_path / "out"))
    assert back.count() == 2
    if fmt == "text":
        assert sorted(r[0] for r in back.collect()) == ['{"id":1,"amount":50.0}', '{"id":2,"amount":70.0}']


def test_records_that_differ(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", *[order(i, 50) for i in range(5)])
    keyed = {"sinkType": "LOG", "businessKeyFields": ["id"]}
    target = {"type": "FILE", "path": str(tmp_path / "out"), "fileFormat": "parquet"}
    run = runner.run_batch(spark, job(target=target, reconciliation=keyed))
    assert run.differing.count() == 0
    again = runner.run_batch(spark, job(target=target, reconciliation=keyed))
    assert {(r["status"], r["target_rows"]) for r in again.differing.collect()} == {("duplicated", 2)}
    assert len(again.differing.collect()) == 5


def test_a_staged_source_gives_the_same_rows(spark, tmp_path):
    from millrace.plans.spec import Files, Schema, Source
    from millrace.sources import ingest

    raw = spark.createDataFrame([(order(1, 5),), ("oops",), (order(2, 7),)], "value string")
    source = Source(table_name="s", files=Files("-"), schema=Schema(SCHEMA))
    direct, staged = runner.intake(raw, source), runner.intake(raw, source, stage=True)
    assert sorted(direct.view.collect()) == sorted(staged.view.collect())
    assert staged.verdicts.agg(*ingest.intake_metrics()).first().asDict() == {"read": 3, "rejected": 1}
    assert ingest.rejected(staged.verdicts).first()["raw"]["value"] == "oops"
    assert "intake-" in staged.view.inputFiles()[0]


# -- pre-flight ---------------------------------------------------------------------


def test_preflight(spark, tmp_path, job):
    assert runner.preflight(spark, job()) == []
    assert "nowhere" in runner.preflight(spark, job("SELECT * FROM nowhere"))[0]
    assert "empty" in runner.preflight(spark, job("  "))[0]
    proctime = {"strategy": "BOUNDED", "mode": "PROCESS_TIME"}
    source = {"tableName": "orders", "files": {"path": "/none"}, "schema": SCHEMA}
    sql = "SELECT id, processed_time FROM orders"
    assert runner.preflight(spark, job(sql, sources=[{**source, "watermark": proctime}])) == []
    assert runner.preflight(spark, job(sql, sources=[source])) != []
    assert runner.preflight(spark, job(sources=[{**source, "schema": '{"type":"object"}'}])) != []
    both = [source, {**source, "tableName": "second"}]
    assert runner.preflight(spark, job("SELECT a.id FROM orders a JOIN second b ON a.id = b.id", sources=both)) == []


@pytest.mark.parametrize("address, good", [("file:///cp", True), ("s3://b/cp", True), ("/cp", True), (None, True), ("file://cp", False)])
def test_checkpoint_address(address, good):
    if good:
        runner.check_checkpoint(address)
    else:
        with pytest.raises(SpecError):
            runner.check_checkpoint(address)


# -- streams ------------------------------------------------------------------------


def drain(spark, job):
    run = runner.run_stream(spark, job, available_now=True)
    return run, run.await_end(timeout=300)


def test_stream_run_equals_batch(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", order(1, 5), order(2, 50), "oops", '{"amount":1}', order(3, 11))
    run, report = drain(spark, job())
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [2, 3]
    assert spark.read.text(str(tmp_path / "dlq/orders")).count() == 2
    row = report.first()
    assert [row[c] for c in ("source_read_count", "schema_rejected_count", "transformed_count", "target_written_count")] == [5, 2, 2, 2]
    windows = run.trail.windows().agg(F.sum("source_read_count"), F.sum("target_written_count")).first()
    assert tuple(windows) == (5, 2)
    names = [k for k, _, _ in kinds(spark, tmp_path)]
    assert names[:2] == ["JOB_SUBMITTED", "JOB_RUNNING"] and names[-2:] == ["JOB_COMPLETED", "RECONCILIATION_COMPLETE"]


def test_restart_goes_on_without_duplicates(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", order(1, 50))
    first, _ = drain(spark, job())
    write_lines(tmp_path / "in", "b", order(2, 60), "oops")
    second, report = drain(spark, job())
    assert first.run_id == second.run_id
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 2]
    assert spark.read.text(str(tmp_path / "dlq/orders")).count() == 1
    row = report.first()
    assert (row["source_read_count"], row["schema_rejected_count"], row["target_written_count"]) == (3, 1, 2)


def test_counts_survive_a_failure(spark, tmp_path, job):
    """A batch that fails after its source was staged is counted once it gets through."""
    write_lines(tmp_path / "in", "a", order(1, 50), "oops")
    first, _ = drain(spark, job())
    write_lines(tmp_path / "in", "b", order(2, 60), order(3, 70))
    broken = runner.run_stream(spark, job("SELECT id, amount / (id - 2) AS amount FROM orders"), available_now=True)
    with pytest.raises(Exception, match="(?i)zero"):
        broken.await_end(timeout=300)
    write_lines(tmp_path / "in", "c", order(4, 80))
    last, report = drain(spark, job())
    assert first.run_id == broken.run_id == last.run_id
    row = report.first()
    assert [row[c] for c in ("source_read_count", "schema_rejected_count", "transformed_count", "target_written_count")] == [5, 1, 4, 4]
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 2, 3, 4]
    told = audit.counters(spark.read.schema(audit.EVENT_SCHEMA).parquet(str(tmp_path / "audit"))).collect()
    assert sorted(r["value"] for r in told) == [1, 4, 4, 5]


def test_a_stream_needs_its_checkpoint(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", order(1, 50))
    with pytest.raises(SpecError, match="checkpointDir"):
        runner.run_stream(spark, job(engine={}))


def test_reports_by_window(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", order(1, 50), order(2, 60))
    drain(spark, job(dlq={"enabled": False}))
    reports = spark.read.parquet(str(tmp_path / "reports")).collect()
    assert len(reports) == 2 and all(r["reconciled"] and r["target_written_count"] == 2 for r in reports)
    assert {(r["window_end"] - r["window_start"]).total_seconds() == 3600 for r in reports} == {True, False}


def test_processed_time_does_not_differ(spark, tmp_path, job):
    """The rows delivered are compared, not the query run again."""
    write_lines(tmp_path / "in", "a", *[order(i, 50) for i in range(5)])
    timed = {"strategy": "BOUNDED", "mode": "PROCESS_TIME"}
    source = {"tableName": "orders", "files": {"path": str(tmp_path / "in")}, "schema": SCHEMA, "watermark": timed}
    run = runner.run_batch(
        spark,
        job(
            "SELECT id, processed_time, rand() AS r FROM orders",
            sources=[source],
            target={"type": "FILE", "path": str(tmp_path / "out"), "fileFormat": "parquet"},
            reconciliation={"sinkType": "LOG", "businessKeyFields": ["id"]},
        ),
    )
    assert run.differing.count() == 0 and run.report.first()["target_written_count"] == 5


def test_one_job_without_audit_and_one_parse_with_it(spark, tmp_path, job):
    from millrace.plans.spec import Files, Schema, Source

    write_lines(tmp_path / "in", "a", order(1, 50))
    plain = job(audit=None, reconciliation=None, dlq={})
    spark.sparkContext.setJobGroup("plain", "a job that nobody counts")
    runner.run_batch(spark, plain)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("plain")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    raw = spark.createDataFrame([(order(1, 5),)], "value string")
    source = Source(table_name="s", files=Files("-"), schema=Schema(SCHEMA))
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "parseJson" in text(runner.intake(raw, source).view)
    staged = runner.intake(raw, source, stage=True)
    assert "parseJson" not in text(staged.view) and "parseJson" not in text(staged.verdicts)


def test_stream_of_a_closed_window(spark, tmp_path, job):
    at = ["2024-01-01 00:00:10", "2024-01-01 00:00:20", "2024-01-01 00:05:00"]
    write_lines(tmp_path / "in", "a", *[order(i, 1, t) for i, t in enumerate(at)], order(9, 1, "never"))
    timed = {
        "tableName": "orders",
        "files": {"path": str(tmp_path / "in")},
        "schema": SCHEMA,
        "watermark": {"strategy": "BOUNDED", "mode": "EXISTING", "timestampColumn": "at", "timestampFormat": "yyyy-MM-dd HH:mm:ss"},
    }
    sql = "SELECT window(at, '1 minute').start AS w, count(*) AS n FROM orders GROUP BY window(at, '1 minute')"
    _, report = drain(spark, job(sql, sources=[timed]))
    assert [r["n"] for r in spark.read.json(str(tmp_path / "out")).collect()] == [2]
    row = report.first()
    assert (row["source_read_count"], row["schema_rejected_count"], row["transformed_count"]) == (4, 1, 1)


def test_unbounded_aggregate_is_refused_in_append(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", order(1, 50))
    with pytest.raises(Exception, match="watermark"):
        runner.run_stream(spark, job("SELECT amount, count(*) AS n FROM orders GROUP BY amount"), available_now=True)
    assert audit.latest_status(spark.read.parquet(str(tmp_path / "audit"))).first()["status"] == "FAILED"
    assert not spark.streams.active


def test_a_stream_that_breaks_is_recorded_and_raised(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", order(1, 50), order(2, 60))
    run = runner.run_stream(spark, job("SELECT 1 / (id - 2) AS x FROM orders"), available_now=True)
    with pytest.raises(Exception, match="(?i)zero"):
        run.await_end(timeout=120)
    assert audit.latest_status(spark.read.parquet(str(tmp_path / "audit"))).first()["status"] == "FAILED"
    assert not spark.streams.active


def test_cancel(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", order(1, 50))
    run = runner.run_stream(spark, job(engine={"checkpointDir": str(tmp_path / "cp"), "checkpointInterval": 100}))
    for query in run.queries():
        query.processAllAvailable()
    report = run.cancel()
    assert report.first()["target_written_count"] == 1
    assert audit.latest_status(spark.read.parquet(str(tmp_path / "audit"))).first()["status"] == "CANCELLED"


def test_raw_source_as_a_stream(spark, tmp_path, job):
    write_lines(tmp_path / "in", "a", "one", "two")
    raw = [{"tableName": "lines", "files": {"path": str(tmp_path / "in")}, "watermark": {"strategy": "BOUNDED", "mode": "PROCESS_TIME"}}]
    _, report = drain(spark, job("SELECT f0, processed_time IS NOT NULL AS stamped FROM lines", sources=raw, dlq={}))
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert sorted((r["f0"], r["stamped"]) for r in rows) == [("one", True), ("two", True)]
    assert report.first()["reconciled"]


# -- event time ---------------------------------------------------------------------


@pytest.mark.parametrize("ms, seconds", [(5000, 5), (1500, 1), (999, 0), (0, 0), (-3000, 0), (-500, 0)])
def test_watermark_lag(ms, seconds):
    assert event_time.lag_seconds(ms) == seconds


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """One file per batch; a filler batch in between, as a watermark acts one batch later."""
    from millrace.streaming.progress import dropped_late

    batches = [["00:00:10"], ["00:05:00"], ["00:05:01"], ["00:00:20", "00:04:58"], ["00:10:00"]]
    folder = tmp_path / "late"
    out, checkpoint = str(tmp_path / "late-out"), str(tmp_path / "late-cp")
    dropped = 0
    for i, times in enumerate(batches):
        write_lines(folder, f"{i}", *[f"2024-01-01 {t}" for t in times])
        lines = spark.readStream.text(str(folder)).select(F.to_timestamp("value").alias("at"))
        counts = event_time.with_watermark(lines, "at", 5000).groupBy(F.window("at", "1 minute").alias("w")).count()
        query = (
            counts.select(F.unix_seconds("w.start").alias("start"), "count")
            .writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination()
        dropped += dropped_late(query)
    found = {r["start"] - 1704067200: r["count"] for r in spark.read.parquet(out).collect()}
    assert dropped == 1
    assert found == {0: 1, 240: 1, 300: 2}


def test_interval_join_meets_across_batches_and_forgets(spark, tmp_path):
    """A click waits in state for its purchase, and leaves it once the watermark has passed."""
    from millrace.operators.joins import interval_join

    batches = [
        ["click,1,00:10:00", "click,2,00:11:00", "purchase,9,00:00:00"],
        ["purchase,1,00:40:00", "purchase,2,01:30:00"],
        ["click,3,09:00:00", "purchase,3,09:30:00"],
        ["click,4,09:01:00"],
    ]
    folder, out, checkpoint = tmp_path / "pairs", str(tmp_path / "pairs-out"), str(tmp_path / "pairs-cp")
    removed = 0
    for i, lines in enumerate(batches):
        write_lines(folder, f"{i}", *lines)

        def side(kind):
            parts = F.split("value", ",")
            at = F.to_timestamp(F.concat(F.lit("2024-01-01 "), parts[2]))
            rows = spark.readStream.text(str(folder)).select(
                parts[0].alias("kind"), parts[1].cast("int").alias("user"), at.alias(f"{kind}_at")
            )
            return event_time.with_watermark(rows, f"{kind}_at", 60_000).where(F.col("kind") == kind).drop("kind")

        pairs = interval_join(side("click"), side("purchase"), ["user"], "click_at", "purchase_at", 3600)
        query = (
            pairs.writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination()
        removed += sum(p["stateOperators"][0]["numRowsRemoved"] for p in query.recentProgress if p["stateOperators"])
    assert sorted(r["user"] for r in spark.read.parquet(out).collect()) == [1, 3]
    assert removed >= 4


def test_written_is_what_the_target_holds(spark, tmp_path):
    from millrace.plans.spec import Kafka, Target
    from millrace.sources import connectors

    target = Target(type="FILE", path=str(tmp_path / "t"))
    assert runner.deliver(spark.range(5), target) == 5
    assert runner.deliver(spark.range(8), target, lambda rows, to: connectors.write_outgoing(rows.where("id > 5"), to)) == 2
    assert runner.deliver(spark.range(3), Target(type="FILE", path=str(tmp_path / "t"), mode="overwrite")) == 3
    topic = Target(type="KAFKA", kafka=Kafka("t", "b:9092", format="JSON"))
    taken = lambda rows, to: rows.write.format("noop").mode("overwrite").save()
    assert runner.deliver(spark.range(5), topic, taken) == 5


def test_a_repeated_batch_replaces_itself_in_a_table(spark, monkeypatch):
    from millrace.plans.spec import SpecError as Bad
    from millrace.plans.spec import Target
    from millrace.sources import connectors

    steps = []
    monkeypatch.setattr(connectors, "write_outgoing", lambda rows, target: steps.append(rows))
    monkeypatch.setattr(connectors, "_execute", lambda spark, target, *statement: steps.append(statement))
    noted = Target(type="JDBC", connection="jdbc:x", table="shop.orders", batch_columns=True)
    connectors.write_batch(spark.range(2), noted, "run-1", 7)
    assert steps[0] == ("DELETE FROM shop.orders WHERE run_id = ? AND batch_id = ?", "run-1", 7)
    assert [tuple(r) for r in steps[1].orderBy("id").collect()] == [(0, "run-1", 7), (1, "run-1", 7)]
    connectors.write_batch(spark.range(2), Target(type="JDBC", connection="jdbc:x", table="t"), None, 8)
    assert steps[2].columns == ["id"] and len(steps) == 3
    with pytest.raises(Bad):
        connectors.forget_batch(Target(type="JDBC", table="t; DROP TABLE t"))
    with pytest.raises(Bad):
        connectors.write_batch(spark.range(2), noted, None, 8)


def test_dead_letter_targets(job):
    from millrace.plans.spec import Dlq, Kafka, Source

    def taken(source, schema=object()):
        return runner.Intake(source, None, None, schema)

    source = taken(Source(table_name="s", kafka=Kafka("orders-raw", "b:9092")))
    assert runner._dlq_target(job(dlq={}), source) is None
    assert runner._dlq_target(job(dlq={"enabled": True}), taken(source.source, None)) is None
    named = runner._dlq_target(job(dlq={"enabled": True}), source)
    assert (named.kafka.topic, named.kafka.bootstrap_servers) == ("orders-raw-dlq", "b:9092")
    own = runner._dlq_target(job(dlq={"enabled": True, "topic": "bad", "bootstrapServers": "c:9092"}), source)
    assert (own.kafka.topic, own.kafka.bootstrap_servers) == ("bad", "c:9092")
    with pytest.raises(SpecError):
        runner._dlq_target(job(dlq={"enabled": True}), taken(job().sources[0]))
    assert Dlq().enabled is False


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from millrace.session import shared_dir

    conf = SimpleNamespace(get=lambda name, default: default)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://head:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: "s3a://shared/x/"))
    assert shared_dir(named) == "s3a://shared/x"
