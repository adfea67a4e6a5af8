"""Runs a job specification, bounded or as streams, with the same plan for both.

A job without audit, reconciliation and dead letters is one query from its sources to its
target. Any other job is staged: every source is read and parsed once into classified rows, and the
counts of every batch go into a ledger as the batch commits. What was delivered is asked of the target's own
commit log, batch by batch, so counts are exact, outlive the process, and tell which batch lost rows.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit, reconcile
from ..session import fresh_path, materialize, prepare
from ..sources import connectors, ingest
from ..sources.schema import Declared, declared
from ..streaming import commit_log, event_time
from ..streaming.ledger import Entry, FileStage, Ledger, Totals, by_window, observed, totals_of, watch
from . import sinks, transform
from .spec import Job, Kafka, Source, SpecError, Target

#: The ledger's name of the query's own stage; a source's is that of its table.
MAIN, SOURCE = "main", "source"
#: Seconds between two rounds of counting while a stream is awaited.
ROUND_SECONDS = 60.0

Write = Callable[[DataFrame, Target], None]


@dataclass(frozen=True)
class Intake:
    """One source in a plan: the view's rows, and every row with its verdict."""

    source: Source
    view: DataFrame
    verdicts: DataFrame
    schema: Declared | None = None


def _timed(df: DataFrame, source: Source) -> DataFrame:
    mark = source.watermark
    if mark.is_mode("PROCESS_TIME"):
        return event_time.with_processed_time(df)
    if mark.is_mode("EXISTING") and mark.timestamp_column:
        return event_time.with_watermark(df, mark.timestamp_column, mark.max_out_of_orderness)
    return df


def classified(raw: DataFrame, source: Source) -> tuple[DataFrame, Declared | None]:
    """(rows with ``row``, ``error_type``, ``error_message`` and, if a schema is declared, ``raw``; schema)."""
    mark = source.watermark
    when = (
        event_time.EventTime(mark.timestamp_column, mark.timestamp_format)
        if mark.is_mode("EXISTING") and mark.timestamp_column
        else None
    )
    messages = "value" in raw.columns and (source.files is None or source.files.format in ("text", "json"))
    if messages and source.schema is not None and source.schema.has_definition:
        schema = declared(source.schema.definition, source.format)
        verdicts = ingest.classify(raw, schema, event_time=when)
        # Only rejects are asked for their message again.
        message = F.when(F.col("error_type").isNotNull(), F.col("raw")).alias("raw")
        return verdicts.select(message, "row", "error_type", "error_message"), schema
    table = raw
    if messages:
        table = ingest.raw_table(raw)
        if when is not None:
            if when.column not in table.columns:
                raise SpecError(f"source {source.table_name} has no column {when.column!r} for its event time")
            table = table.withColumn(when.column, event_time.to_timestamp(F.col(when.column), "string", when.pattern))
    sound = [F.lit(None).cast("string").alias(c) for c in ("error_type", "error_message")]
    return table.select(F.struct("*").alias("row"), *sound), None


def intake(raw: DataFrame, source: Source, stage: bool = False) -> Intake:
    """Raw rows of a source to its typed view: validated when a schema is declared.

    ``stage`` writes the classified rows once, for everybody who asks for them.
    """
    verdicts, schema = classified(raw, source)
    if stage:
        verdicts = materialize(verdicts, "intake")
    return Intake(source, _timed(ingest.accepted(verdicts), source), verdicts, schema)


def _tracked(job: Job) -> bool:
    """Whether anybody asks for counts."""
    return any(part is not None and part.enabled for part in (job.audit, job.reconciliation))


def _staged(job: Job) -> bool:
    return _tracked(job) or job.dlq.enabled


def plan(spark: SparkSession, job: Job, streaming: bool) -> tuple[list[Intake], DataFrame]:
    """Every source as a view, and the lazy result of the job's query.

    A bounded read of a topic is staged in any case: every job over it would look up the
    latest offsets anew and see a different end.
    """
    intakes = []
    for source in job.sources:
        raw = connectors.read(spark, source, streaming, job.engine.parallelism)
        stage = not streaming and (source.kafka is not None or _staged(job))
        intakes.append(intake(raw, source, stage))
        transform.register(source, intakes[-1].view)
    return intakes, transform.run_sql(spark, job.transformation)


def preflight(spark: SparkSession, job: Job) -> list[str]:
    """Problems found without reading data: schemas, checkpoint address, the query's analysis."""
    prepare(spark)
    problems = []
    try:
        check_checkpoint(job.engine.checkpoint_dir)
        if not transform.resolve_sql(spark, job.transformation).strip():
            raise SpecError("the SQL text is empty")
        for source in job.sources:
            if source.files is not None and source.files.format not in ("text", "json"):
                raw = connectors.read(spark, source, streaming=False).limit(0)
            else:
                raw = spark.createDataFrame([], "value string")
            transform.register(source, intake(raw, source).view)
        result = transform.run_sql(spark, job.transformation)
        if job.target.type.upper() == "KAFKA" and (job.target.kafka.format or "").upper() != "AVRO":
            connectors.messages(result, job.target)
    except Exception as error:  # noqa: BLE001 - any failure is a finding here
        problems.append(f"{type(error).__name__}: {str(error).splitlines()[0]}")
    return problems


def check_checkpoint(address: str | None) -> None:
    if address and re.match(r"file://[^/]", address):
        raise SpecError(f"checkpoint {address!r} names a host: a local folder starts with file:///")


def _dlq_target(job: Job, taken: Intake) -> Target | None:
    """Where a source's rejects go: a folder, or the topic named, or ``<topic>-dlq``."""
    source = taken.source
    if not job.dlq.enabled or taken.schema is None:
        return None
    if job.dlq.path:
        return Target(type="FILE", path=f"{job.dlq.path}/{source.table_name}", file_format="text")
    if source.kafka is None:
        raise SpecError(f"source {source.table_name} has no topic: give dlq.path")
    servers = job.dlq.bootstrap_servers or source.kafka.bootstrap_servers
    return Target(
        kafka=Kafka(
            topic=job.dlq.topic or f"{source.kafka.topic}-dlq",
            bootstrap_servers=servers,
            authentication=source.kafka.authentication,
        )
    )


def _envelopes(taken: Intake, job: Job) -> DataFrame:
    return ingest.dead_letters(taken.verdicts, taken.source.topic, job.job_name)


@dataclass
class Trail:
    """The audit trail of one run: lifecycle events, and the counts of its batches.

    A bounded run is one batch, whose counts are ``entries``; a stream's are in its ``ledger``. The driver
    keeps lifecycle events, and the counts that are still to be passed on: a handful per batch.
    """

    spark: SparkSession
    job: Job
    run_id: str
    ledger: Ledger | None = None
    entries: list[Entry] = field(default_factory=list)
    events: list[dict] = field(default_factory=list)
    _told: bool = False

    @property
    def tags(self) -> dict[str, str]:
        return self.job.audit.tags if self.job.audit else {}

    def _emit(self, rows: DataFrame) -> bool:
        return self.job.audit is None or not self.job.audit.enabled or sinks.emit(rows, self.job.audit)

    def add(self, event_type: str, stage: str = audit.LIFECYCLE_STAGE, **metadata) -> None:
        note = {k: str(v) for k, v in {**self.tags, **metadata}.items()}
        self.events.append(audit.event(self.run_id, self.job.job_name, event_type, stage, 0, metadata=note))
        self._emit(audit.events_frame(self.spark, self.events[-1:]))

    def _steps(self, stage: str, source: str) -> list[tuple[str, str, str]]:
        """(event type, stage, count) of the events that a row of the ledger stands for."""
        if stage == SOURCE:
            topic = next((s.topic for s in self.job.sources if s.table_name == source), source)
            at = audit.source_stage(topic)
            return [(audit.SOURCE_READ, at, "read"), (audit.SOURCE_REJECTED, at, "rejected")]
        target = audit.target_stage(self.job.target.topic)
        return [(audit.TRANSFORM_OUTPUT, audit.TRANSFORM_STAGE, "transformed"), (audit.TARGET_WRITTEN, target, "written")]

    def _as_events(self, entries: list[Entry]) -> DataFrame:
        out = []
        for e in entries:
            note = {"batch_id": str(e.batch), **self.tags, **({"source": e.source} if e.source else {})}
            if e.counts.get("late"):
                note["late"] = str(e.counts["late"])
            for kind, stage, count in self._steps(e.stage, e.source):
                if count in e.counts:
                    out.append(audit.event(self.run_id, self.job.job_name, kind, stage, e.counts[count], e.at_ms, note))
        return audit.events_frame(self.spark, out)

    def counted(self) -> DataFrame | None:
        """All count events of the run, of earlier processes' batches too."""
        if self.ledger is None:
            return self._as_events(self.entries) if self.entries else None
        if self.ledger.empty():
            return None
        steps = [(s, t, *step) for s, t in self.ledger.last for step in self._steps(s, t)]
        counts = F.create_map(*[x for c in ("read", "rejected", "transformed", "written") for x in (F.lit(c), F.col(c))])
        note = [F.col("batch").cast("string").alias("batch_id"), *[F.lit(v).alias(k) for k, v in self.tags.items()]]
        note += [F.nullif("source", F.lit("")).alias("source"), F.when(F.col("late") > 0, F.col("late").cast("string")).alias("late")]
        each = [
            F.when(
                (F.col("stage") == s) & (F.col("source") == t),
                F.struct(F.lit(kind).alias("event_type"), F.lit(at).alias("stage"), counts[count].alias("count")),
            )
            for s, t, kind, at, count in steps
        ]
        wide = self.ledger.rows().select(
            F.lit(self.run_id).alias("run_id"), F.lit(self.job.job_name).alias("job_name"),
            F.timestamp_millis("at_ms").alias("ts"), F.to_json(F.struct(*note)).alias("metadata"),
            F.inline(F.filter(F.array(*each), lambda e: e["count"].isNotNull())),
        )
        return wide.select(*[c.split()[0] for c in audit.EVENT_SCHEMA.split(", ")])

    def catch_up(self) -> None:
        """Enters what the stages have committed since the last round."""
        if self.ledger is not None:
            self.ledger.catch_up()

    def tell(self) -> None:
        """Passes on the counts that no sink has taken yet; those that it takes are marked."""
        if self.ledger is not None:
            if (waiting := list(self.ledger.untold)) and self._emit(self._as_events(waiting)):
                self.ledger.told(waiting)
        elif self.entries and not self._told:
            self._told = self._emit(self._as_events(self.entries))

    def frame(self) -> DataFrame:
        """All events of the run, of earlier processes' batches too; lifecycle of this process."""
        own = audit.events_frame(self.spark, self.events)
        counts = self.counted()
        return own if counts is None else own.unionByName(counts)

    def _reports(self, rows: list[tuple[int, int, Totals]], label: str) -> DataFrame:
        """Report rows from totals and their spans in epoch milliseconds. A handful of numbers: no job is run."""
        config = self.job.reconciliation
        found = reconcile.totals_frame(self.spark, self.run_id, self.job.job_name, rows)
        span = [F.timestamp_millis(c) for c in ("_from", "_to")]
        return reconcile.report(found, *span, F.lit(label), config.tolerance_percent if config else 0.0)

    def report(self) -> DataFrame:
        """The report of the whole run, over the time of its events."""
        config = self.job.reconciliation
        totals = self.ledger.totals if self.ledger is not None else totals_of(self.entries)
        times = [e["ts_ms"] for e in self.events] + [t for t in (totals.first_ms, totals.last_ms) if t is not None]
        return self._reports([(min(times), max(times), totals)], config.window if config else "n/a")

    def windows(self) -> DataFrame | None:
        """One report per window of the configured length, from the times of all counts."""
        config, counts = self.job.reconciliation, self.counted()
        if counts is None:
            return None
        return reconcile.by_window(audit.once_per_batch(counts), config.window, config.tolerance_percent)

    def report_windows(self, closed_at: float | None = None) -> None:
        """Passes on the reports of windows not yet reported; up to a moment, of closed ones only.

        Of a stream, the counts that belong to windows still open are at hand: nothing is read.
        """
        config = self.job.reconciliation
        if config is None or not config.enabled:
            return
        width = reconcile.window_ms(config.window)
        open_windows = by_window(self.entries if self.ledger is None else self.ledger.open, width)
        rows = [(at, at + width, t) for at, t in sorted(open_windows.items()) if closed_at is None or at + width <= closed_at * 1000]
        if rows and sinks.emit(self._reports(rows, config.window).select(*reconcile.REPORT_COLUMNS), config):
            if self.ledger is not None:
                self.ledger.report_upto(rows[-1][1])

    def reconcile(self) -> DataFrame | None:
        config = self.job.reconciliation
        if config is None or not config.enabled:
            return None
        report = self.report()
        sinks.emit(report.select(*reconcile.REPORT_COLUMNS), config)
        self.add(audit.RECONCILIATION_COMPLETE)
        return report


def _reason(error: Exception) -> str:
    return str(error).splitlines()[0] if str(error) else type(error).__name__


# -- bounded ------------------------------------------------------------------------


@dataclass(frozen=True)
class BatchRun:
    """A finished run: its events, its report, and the records that differ, lazily."""

    run_id: str
    trail: Trail
    report: DataFrame | None
    differing: DataFrame | None = None


def _differing(job: Job, delivered: DataFrame) -> DataFrame | None:
    """The rows delivered against what the target now holds, on the business keys of the job.

    Only columnar files give back the rows as they were; rows of earlier runs in an
    appended target show as unexpected.
    """
    config, target = job.reconciliation, job.target
    if config is None or not config.business_key_fields or target.type.upper() != "FILE":
        return None
    if target.file_format not in ("parquet", "orc"):
        return None
    stored = delivered.sparkSession.read.schema(delivered.schema).format(target.file_format).load(target.path)
    return reconcile.records(delivered, stored, list(config.business_key_fields))


def deliver(result: DataFrame, target: Target, write: Write = connectors.write_outgoing) -> int:
    """Writes the rows; how many of them the target holds then.

    Of a folder, the files that are new are counted. A topic does not tell whose rows it holds:
    there, those that the producer has taken count.
    """
    rows, kind, spark = connectors.outgoing(result, target), target.type.upper(), result.sparkSession
    if kind == "KAFKA":
        return _taken(rows, target, write)
    if kind == "FILE":
        before = set() if target.mode == "overwrite" else connectors.files_of(spark, target)
        write(rows, target)
        return connectors.rows_in(spark, target, sorted(connectors.files_of(spark, target) - before))
    before = 0 if target.mode == "overwrite" else connectors.held(spark, target)
    write(rows, target)
    return connectors.held(spark, target) - before


def _taken(rows: DataFrame, target: Target, write: Write) -> int:
    sent = Observation("sent")
    write(rows.observe(sent, F.count(F.lit(1)).alias("rows")), target)
    return sent.get["rows"]


def run_batch(spark: SparkSession, job: Job, write: Write = connectors.write_outgoing) -> BatchRun:
    """Reads what the sources hold now, runs the query, writes the result, reconciles.

    ``write`` puts rows into the target; whatever it does, the target is asked what it holds.
    """
    prepare(spark)
    trail = Trail(spark, job, audit.new_run_id(job.job_name))
    trail.add(audit.JOB_SUBMITTED)
    result = None
    try:
        intakes, result = plan(spark, job, streaming=False)
        trail.add(audit.JOB_RUNNING)
        for taken in intakes:
            if (letters := _dlq_target(job, taken)) is not None:
                connectors.write_outgoing(_envelopes(taken, job), letters)
        if _tracked(job):
            result = materialize(result, "result")
        try:
            if _tracked(job):
                written = deliver(result, job.target, write)
            else:
                write(connectors.outgoing(result, job.target), job.target)
        except Exception as error:
            trail.add(audit.TARGET_FAILED, audit.target_stage(job.target.topic), error=_reason(error))
            raise
        if _tracked(job):
            trail.entries = _batch_entries(intakes, result, written)
            trail.tell()
        trail.add(audit.JOB_COMPLETED)
    except Exception as error:
        trail.add(audit.JOB_FAILED, error=_reason(error))
        raise
    return BatchRun(trail.run_id, trail, trail.reconcile(), _differing(job, result))


def _batch_entries(intakes: list[Intake], result: DataFrame, written: int) -> list[Entry]:
    now, entries = time.time_ns() // 1_000_000, []
    for taken in intakes:
        counts = taken.verdicts.agg(*ingest.intake_metrics()).first().asDict()
        entries.append(Entry(SOURCE, taken.source.table_name, 0, now, 0, counts))
    return [*entries, Entry(MAIN, "", 0, now, 0, {"transformed": result.count(), "written": written})]


# -- streams ------------------------------------------------------------------------


@dataclass
class StreamRun:
    """The queries of a streaming job, in the order in which rows pass them.

    A staged job has one intake per source, one query for a source's dead letters, and the main query,
    which delivers.
    """

    trail: Trail
    main: StreamingQuery
    intakes: dict[str, StreamingQuery]
    letters: dict[str, StreamingQuery] = field(default_factory=dict)
    trim: Callable[[], None] = lambda: None
    in_flight: Callable[[], float] = time.time
    _counted_at: float = 0.0

    @property
    def run_id(self) -> str:
        return self.trail.run_id

    def queries(self) -> list[StreamingQuery]:
        return [*self.intakes.values(), *self.letters.values(), self.main]

    def poll(self) -> None:
        """A round: enters and passes on new counts, reports windows that have closed, trims what is done with."""
        self._counted_at = time.time()
        closed = self.in_flight()
        self.trail.catch_up()
        self.trail.tell()
        self.trail.report_windows(closed_at=closed)
        self.trim()

    def _wait(self, queries: list[StreamingQuery], deadline: float | None) -> bool:
        """False when the time is up. Raises the error of any query at once."""
        while active := [q for q in queries if q.isActive]:
            for query in self.queries():
                if query.exception() is not None:
                    query.awaitTermination()
            if deadline is not None and time.monotonic() > deadline:
                return False
            if time.time() - self._counted_at > ROUND_SECONDS:
                self.poll()
            active[0].awaitTermination(1)
        for query in queries:
            query.awaitTermination()
        return True

    def await_end(self, timeout: float | None = None) -> DataFrame | None:
        """Waits for all queries, counting as they go; then reconciles. Raises their errors.

        Counts are those of what was committed, so a failure loses none of them.
        """
        deadline = None if timeout is None else time.monotonic() + timeout
        self._counted_at = self._counted_at or time.time()
        try:
            if not self._wait(self.queries(), deadline):
                return None
        except Exception as error:
            self._stop()
            self.trail.catch_up()
            self.trail.tell()
            self.trail.add(audit.JOB_FAILED, error=_reason(error))
            raise
        return self._end(audit.JOB_COMPLETED)

    def cancel(self) -> DataFrame | None:
        self._stop()
        return self._end(audit.JOB_CANCELLED)

    def _stop(self) -> None:
        for query in self.queries():
            query.stop()

    def _end(self, event_type: str) -> DataFrame | None:
        self.trail.catch_up()
        self.trail.tell()
        self.trail.add(event_type)
        self.trail.report_windows()
        self.trim()
        return self.trail.reconcile()


def _lasting_run_id(spark: SparkSession, checkpoint: str, job_name: str) -> str:
    """The run id kept beside a checkpoint, so a restarted stream goes on under its name."""
    path = f"{checkpoint}/run-id"
    fresh = spark.sql("SELECT :run AS value", args={"run": audit.new_run_id(job_name)})
    fresh.write.mode("ignore").text(path)
    return spark.read.text(path).first()[0]


def _make_folder(spark: SparkSession, path: str) -> None:
    """A folder that a stream can read before anything is in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


class _Flow:
    """Starts the queries of one streaming job; rows pass from one to the next in folders that Spark's
    file sink commits batch by batch, so every row passes once, whatever is restarted."""

    def __init__(self, spark: SparkSession, job: Job, checkpoint: str, available_now: bool):
        self.spark, self.job, self.checkpoint = spark, job, checkpoint
        interval = {"processingTime": f"{job.engine.checkpoint_interval} milliseconds"}
        self.trigger = {"availableNow": True} if available_now else interval
        self.started: list[StreamingQuery] = []

    def start(self, writer, name: str) -> StreamingQuery:
        query = (
            writer.outputMode("append")
            .option("checkpointLocation", f"{self.checkpoint}/{name}")
            .trigger(**self.trigger)
            .start()
        )
        self.started.append(query)
        return query

    def folder(self, name: str) -> str:
        return f"{self.checkpoint}/staged/{name}"

    def checkpoint_of(self, name: str) -> str:
        return f"{self.checkpoint}/{name}"

    def stage(self, rows: DataFrame, name: str) -> StreamingQuery:
        _make_folder(self.spark, self.folder(name))
        return self.start(rows.writeStream.format("parquet").option("path", self.folder(name)), name)

    def following(self, rows: DataFrame, name: str) -> DataFrame:
        """What ``stage`` commits of ``rows``, as a stream."""
        return self.spark.readStream.schema(rows.schema).parquet(self.folder(name))


class _Trim:
    """Deletes staged files that every query behind them has committed and the ledger has counted.

    A query with several sources may read one folder twice: its files stay for one more batch, when all
    its sources have taken them.
    """

    def __init__(self, flow: _Flow, ledger: Ledger, followers: dict[str, list[str]]):
        self.flow, self.ledger, self.followers = flow, ledger, followers
        self.seen: dict[str, int] = {}
        self.waiting: dict[str, set[str]] = {}
        self.entered: dict[str, tuple[int, int]] = {}
        self.counted: set[str] = set()

    def __call__(self) -> None:
        spark = self.flow.spark
        for table, followers in self.followers.items():
            last = self.ledger.last.get((SOURCE, table))
            if last is None:
                continue
            batch, files = self.entered.get(table, (-1, 0))
            for done in commit_log.sink_batches(spark, self.flow.folder(f"intake-{table}"), batch, files):
                if done.batch <= last.batch:
                    self.counted.update(_name(f) for f in done.files)
                    self.entered[table] = (done.batch, done.upto)
            own = f"/staged/intake-{table}/"
            for follower in followers:
                checkpoint = self.flow.checkpoint_of(follower)
                upto, mark = commit_log.committed_upto(spark, checkpoint) - 1, f"{table}/{follower}"
                taken = commit_log.source_files(spark, checkpoint, self.seen.get(mark, -1), upto)
                for file in taken:
                    if own in file:
                        self.waiting.setdefault(file, set()).add(follower)
                self.seen[mark] = max(upto, self.seen.get(mark, -1))
            gone = [f for f, by in self.waiting.items() if own in f and len(by) == len(followers) and _name(f) in self.counted]
            for file in gone:
                commit_log.delete(spark, file)
                self.counted.discard(_name(file))
                del self.waiting[file]


def _name(file: str) -> str:
    return file.rsplit("/", 1)[-1]


def run_stream(spark: SparkSession, job: Job, available_now: bool = False, write: Write | None = None) -> StreamRun:
    """Starts the job's streams. ``available_now`` works off what is there and ends; it returns
    when the sources are staged and the main query has started. ``write`` puts the rows of a batch into
    the target; whatever it does, the target is asked what it holds of the batch."""
    prepare(spark)
    check_checkpoint(job.engine.checkpoint_dir)
    if not job.engine.checkpoint_dir and not available_now:
        raise SpecError("a stream needs engine.checkpointDir: without it a restart would begin anew")
    checkpoint = job.engine.checkpoint_dir or fresh_path(spark, "stream")
    trail = Trail(spark, job, _lasting_run_id(spark, checkpoint, job.job_name))
    trail.add(audit.JOB_SUBMITTED)
    flow = _Flow(spark, job, checkpoint, available_now)
    try:
        run = _start_staged(flow, trail, write) if _staged(job) else _start_direct(flow, trail)
        trail.add(audit.JOB_RUNNING)
        return run
    except Exception as error:
        for query in flow.started:
            query.stop()
        trail.add(audit.JOB_FAILED, error=_reason(error))
        raise


def _start_direct(flow: _Flow, trail: Trail) -> StreamRun:
    _, result = plan(flow.spark, flow.job, streaming=True)
    return StreamRun(trail, flow.start(connectors.stream_writer(result, flow.job.target), "main"), {})


def _start_staged(flow: _Flow, trail: Trail, write: Write | None) -> StreamRun:
    spark, job = flow.spark, flow.job
    if _tracked(job):
        watch(spark)
        trail.ledger = Ledger(spark, f"{flow.checkpoint}/ledger")
    intakes, letters, staged, followers = {}, {}, [], {}
    for source in job.sources:
        raw = connectors.read(spark, source, streaming=True, parallelism=job.engine.parallelism)
        rows, schema = classified(raw, source)
        name = f"intake-{source.table_name}"
        query = flow.stage(_watched(rows, trail), name)
        intakes[source.table_name] = query
        followers[source.table_name] = [MAIN]
        if trail.ledger is not None:
            recount = _verdicts_by_file(spark)
            stage = FileStage(SOURCE, source.table_name, flow.folder(name), flow.checkpoint_of(name), recount, query=query)
            trail.ledger.stages.append(stage)
        taken = Intake(source, _timed(ingest.accepted(flow.following(rows, name)), source), flow.following(rows, name), schema)
        transform.register(source, taken.view)
        staged.append((source, taken))
    if flow.trigger.get("availableNow"):
        for query in intakes.values():
            query.awaitTermination()
    for source, taken in staged:
        if (target := _dlq_target(job, taken)) is not None:
            name = f"letters-{source.table_name}"
            letters[source.table_name] = flow.start(connectors.message_stream(_envelopes(taken, job), target), name)
            followers[source.table_name].append(name)
    result = transform.run_sql(spark, job.transformation)
    if trail.ledger is None:
        return StreamRun(trail, flow.start(connectors.stream_writer(result, job.target), MAIN), intakes, letters)
    main = _start_main(flow, trail, result, write)
    stages = list(trail.ledger.stages)

    def in_flight() -> float:
        """Since when a batch may be under way whose counts are not known: windows before that are closed."""
        since = [time.time()]
        for checkpoint in [s.checkpoint for s in stages] + [flow.checkpoint_of(MAIN)]:
            begun = max((int(n) for n in commit_log.names(spark, f"{checkpoint}/offsets") if n.isdigit()), default=-1)
            if begun > commit_log.committed_upto(spark, checkpoint):
                since.append((commit_log.batch_time(spark, checkpoint, begun) or 0) / 1000)
        return min(since)

    return StreamRun(trail, main, intakes, letters, _Trim(flow, trail.ledger, followers), in_flight)


def _watched(rows: DataFrame, trail: Trail) -> DataFrame:
    if trail.ledger is None:
        return rows
    return observed(rows, read=F.count(F.lit(1)), rejected=F.count_if(F.col("error_type").isNotNull()))


def _verdicts_by_file(spark: SparkSession) -> Callable[[list[str]], DataFrame]:
    def count(files: list[str]) -> DataFrame:
        rows = spark.read.schema("error_type string").parquet(*files)
        return rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.count(F.lit(1)).alias("read"), F.count_if(F.col("error_type").isNotNull()).alias("rejected")
        )

    return count


def _start_main(flow: _Flow, trail: Trail, result: DataFrame, write: Write | None) -> StreamingQuery:
    """The main query, which delivers.

    A folder is written by Spark's file sink, whose log tells the files of every batch. Into any other
    target, and by a ``write`` of the caller's, batches are put one by one.
    """
    spark, target, checkpoint = flow.spark, flow.job.target, flow.checkpoint_of(MAIN)
    if target.type.upper() == "FILE" and not target.batch_columns and write is None:
        begun = commit_log.names(spark, f"{checkpoint}/offsets")
        if not begun and commit_log.names(spark, f"{target.path}/{commit_log.SINK_LOG}"):
            raise SpecError(f"{target.path} holds the log of another stream: its batches would be taken for this one's")
        rows = observed(connectors.outgoing(result, target), transformed=F.count(F.lit(1)))
        query = flow.start(connectors.message_stream(rows, target), MAIN)
        held = lambda name: lambda files: connectors.rows_by_file(spark, target, files, name)
        trail.ledger.stages.append(
            FileStage(MAIN, "", target.path, checkpoint, held("transformed"), held("written"), query)
        )
        return query
    return flow.start(result.writeStream.foreachBatch(_Delivery(flow, trail, write)), MAIN)


class _Delivery:
    """Puts batches into a target that keeps no log of them.

    A batch is kept in the shared folder until the target has taken it and the ledger has its counts, so
    that its rows are the same when it is repeated. A batch that the ledger has is not sent again.
    """

    def __init__(self, flow: _Flow, trail: Trail, write: Write | None):
        self.flow, self.trail = flow, trail
        self.write = write or connectors.write_outgoing

    def __call__(self, batch: DataFrame, number: int) -> None:
        last = self.trail.ledger.last.get((MAIN, ""))
        if last is not None and last.batch >= number:
            return
        spark, target, folder = batch.sparkSession, self.flow.job.target, self.flow.folder(f"{MAIN}/{number}")
        batch.write.mode("overwrite").parquet(folder)
        rows = spark.read.schema(batch.schema).parquet(folder)
        transformed = rows.count()
        if target.batch_columns:
            connectors.write_batch(connectors.outgoing(rows, target), target, self.trail.run_id, number, self.write)
            written = connectors.held(spark, target, self.trail.run_id, number)
        else:
            written = _taken(connectors.outgoing(rows, target), target, self.write)
        at = commit_log.batch_time(spark, self.flow.checkpoint_of(MAIN), number) or time.time_ns() // 1_000_000
        self.trail.ledger.append([Entry(MAIN, "", number, at, 0, {"transformed": transformed, "written": written})])
        commit_log.delete(spark, folder)


__all__ = [
    "BatchRun",
    "Intake",
    "StreamRun",
    "intake",
    "plan",
    "preflight",
    "run_batch",
    "run_stream",
]
