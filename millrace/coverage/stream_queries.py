"""The same work as streams: each runs to the end of its input and reads its output back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import serialize
from ..operators import audit, reconcile
from ..operators.joins import asof_within, interval_join
from ..plans import runner, spec
from ..session import fresh_path
from ..sources import connectors, ingest
from ..streaming import commit_log, event_time
from ..streaming.keyed_table import KeyedTable
from ..streaming.ledger import OBSERVATIONS
from ..streaming.progress import dropped_late
from . import messages
from .messages import CLASSED
from .registry import query, table

_LAG_MS = 600_000


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _drain(df: DataFrame, purpose: str, fmt: str = "parquet") -> DataFrame:
    """Runs an append stream over everything available, then reads what it wrote."""
    spark = df.sparkSession
    out = fresh_path(spark, purpose)
    started = (
        df.writeStream.format(fmt)
        .option("checkpointLocation", fresh_path(spark, purpose + "-checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    started.awaitTermination()
    return spark.read.schema(df.schema).format(fmt).load(out)


def _timed_events(spark, folder):
    return event_time.with_watermark(_stream(spark, folder, "events"), "ts", _LAG_MS)


@query(
    "stream_filter",
    f"""WITH {CLASSED}
        SELECT event_id, event_type, value FROM classed WHERE error_type IS NULL AND value > 100""",
)
def stream_filter(spark, folder):
    """Messages in, JSON messages out."""
    raw = messages.event_messages(_stream(spark, folder, "events"))
    ingest.accepted(ingest.classify(raw, messages.events_schema())).createOrReplaceTempView("events_live")
    result = spark.sql("SELECT event_id, event_type, value FROM events_live WHERE value > 100")
    sent = _drain(result.select(serialize.json_value(result).alias("value")), "filter", "text")
    return sent.select(F.from_json("value", "event_id bigint, event_type string, value double").alias("r")).select("r.*")


@query(
    "stream_enrich",
    """SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_orderstatus = 'O'""",
)
def stream_enrich(spark, folder):
    """A stream of orders against a bounded customer table."""
    orders = _stream(spark, folder, "orders").where("o_orderstatus = 'O'")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return _drain(joined.select("o_orderkey", "o_totalprice", "c_mktsegment"), "enrich")


@query(
    "stream_interval_join",
    """SELECT c.event_id AS click_id, p.event_id AS purchase_id
       FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR
       WHERE c.event_type = 'click' AND p.event_type = 'purchase'""",
)
def stream_interval_join(spark, folder):
    """Two streams, state bounded by both watermarks and the time range, spread over time slots."""

    def side(kind: str) -> DataFrame:
        events = _timed_events(spark, folder).where(F.col("event_type") == kind)
        return events.select("user_id", F.col("event_id").alias(f"{kind}_id"), F.col("ts").alias(f"{kind}_ts"))

    pairs = interval_join(side("click"), side("purchase"), ["user_id"], "click_ts", "purchase_ts", 3600)
    return _drain(pairs.select("click_id", "purchase_id"), "interval")


def _in_order(spark: SparkSession, events: DataFrame, parts: int) -> str:
    """A folder with the events by time, a file to a part, and after them three of a key that nobody has,
    each a day later: the watermark passes every event."""
    base = fresh_path(spark, "in-order")
    ends = events.agg(F.unix_micros(F.min("ts")).alias("low"), F.unix_micros(F.max("ts")).alias("high")).first()
    step = (ends.high - ends.low) // parts + 1
    part = F.floor((F.unix_micros("ts") - ends.low) / step)
    for number in range(parts):
        events.where(part == number).coalesce(1).write.parquet(f"{base}/{number}")
    last = events.orderBy(F.desc("ts")).limit(1).withColumn("user_id", F.lit(-1).cast(events.schema["user_id"].dataType))
    for number, kinds in ((parts + n, F.array(F.lit("click"), F.lit("purchase"))) for n in range(3)):
        later = F.col("ts") + F.make_dt_interval(F.lit(number - parts + 1))
        last.withColumns({"ts": later, "event_type": F.explode(kinds)}).coalesce(1).write.parquet(f"{base}/{number}")
    return base


@query(
    "stream_asof",
    """WITH latest AS (
         SELECT p.event_id, p.user_id, max(c.ts) AS at FROM events p LEFT JOIN events c
           ON c.event_type = 'click' AND c.user_id = p.user_id AND c.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts
         WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.user_id)
       SELECT l.event_id AS purchase_id, coalesce(max(c.event_id), -1) AS click_id
       FROM latest l LEFT JOIN events c ON c.event_type = 'click' AND c.user_id = l.user_id AND c.ts = l.at
       GROUP BY l.event_id""",
)
def stream_asof(spark, folder):
    """The last click up to six hours before each purchase: a stream join, then the latest per purchase."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    base = _in_order(spark, events, 4)

    def side(kind: str) -> DataFrame:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(f"{base}/*")
        of_kind = event_time.with_watermark(stream, "ts", _LAG_MS).where(F.col("event_type") == kind)
        return of_kind.select("user_id", F.col("event_id").alias(f"{kind}_id"), F.col("ts").alias(f"{kind}_ts"))

    found = asof_within(side("purchase"), side("click"), ["user_id"], "purchase_ts", "click_ts", ["click_id"], 6 * 3600)
    kept = _drain(found.select("user_id", "purchase_id", "click_id"), "asof").where("user_id <> -1")
    return kept.select("purchase_id", F.coalesce("click_id", F.lit(-1)).alias("click_id"))


@query(
    "stream_tumble_closed",
    f"""WITH edge AS (SELECT max(ts) - INTERVAL {_LAG_MS // 60000} MINUTE AS mark FROM events)
        SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, count(*) AS events
        FROM events, edge WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2""",
)
def stream_tumble_closed(spark, folder):
    """Hourly counts of the windows the watermark has closed; open ones stay in state."""
    counts = (
        _timed_events(spark, folder)
        .groupBy("event_type", F.window("ts", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    return _drain(counts.select("event_type", F.unix_micros("w.start").alias("window_start"), "events"), "tumble")


@query(
    "stream_session_closed",
    f"""WITH edge AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {_LAG_MS // 60000} MINUTE AS mark FROM events),
       flagged AS (
         SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR
                   THEN 0 ELSE 1 END AS starts FROM events),
       numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM flagged)
       SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS events
       FROM numbered, edge GROUP BY user_id, session, mark HAVING max(ts) + INTERVAL 6 HOUR <= mark""",
)
def stream_session_closed(spark, folder):
    found = (
        _timed_events(spark, folder)
        .groupBy("user_id", F.session_window("ts", "6 hours").alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    return _drain(found.select("user_id", F.unix_micros("w.start").alias("session_start"), "events"), "session")


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, folder):
    """Every event delivered twice; the second copy is dropped while its key is in state."""
    events = _timed_events(spark, folder)
    twice = events.unionByName(_timed_events(spark, folder))
    once = twice.dropDuplicatesWithinWatermark(["event_id"])
    return _drain(once.select("event_id", "user_id", "event_type"), "dedup")


def _in_batches(spark: SparkSession, rows: DataFrame, files: int) -> tuple[DataFrame, str]:
    """(a stream of ``rows``, a file to a batch; a folder for what it leaves)."""
    base = fresh_path(spark, "batches")
    rows.repartition(files, F.pmod(F.xxhash64("event_id"), F.lit(files))).write.parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(f"{base}/in"), base


def _followed(keyed: KeyedTable, stream: DataFrame, base: str) -> DataFrame:
    """Runs the table's stream to its end, gives it its last batch once more, and reads the table."""
    for _ in range(2):
        keyed.follow(stream, f"{base}/checkpoint", availableNow=True).awaitTermination()
        last = commit_log.committed_upto(keyed.spark, f"{base}/checkpoint")
        commit_log.delete(keyed.spark, f"{base}/checkpoint/commits/{last}")
    return keyed.read()


@query(
    "stream_keep_last",
    """SELECT user_id, event_id, event_type, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def stream_keep_last(spark, folder):
    """The latest event of every user, kept up to date over many batches, one of them repeated."""
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value", "ts")
    stream, base = _in_batches(spark, events, 6)
    keyed = KeyedTable(spark, f"{base}/table", events.schema, ["user_id"], ["-ts", "-event_id"], compact_after=3)
    return _followed(keyed, stream, base).drop("ts")


@query(
    "stream_topn",
    """SELECT event_type, event_id, value FROM events
       QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 25""",
)
def stream_topn(spark, folder):
    """The highest values of every type: five keys share all rows."""
    events = table(spark, folder, "events").select("event_type", "event_id", "value")
    stream, base = _in_batches(spark, events, 5)
    keyed = KeyedTable(spark, f"{base}/table", events.schema, ["event_type"], ["-value", "event_id"], n=25, compact_after=2)
    return _followed(keyed, stream, base)


@query(
    "late_rows",
    f"""WITH edge AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {_LAG_MS // 60000} MINUTE AS mark
                      FROM events WHERE event_id % 10 <> 0)
        SELECT count(*) FILTER (WHERE event_id % 10 <> 0 OR ts > mark) AS kept,
               count(*) FILTER (WHERE event_id % 10 = 0 AND ts <= mark) AS dropped
        FROM events, edge""",
)
def late_rows(spark, folder):
    """A tenth of the events arrives after the others: what is behind the watermark is dropped and counted."""
    events = table(spark, folder, "events").select("event_id", "ts")
    late, base = F.col("event_id") % 10 == 0, fresh_path(spark, "late")
    # A batch moves the watermark of the next: the second only repeats a row.
    for number, part in enumerate((events.where(~late), events.where(~late).limit(1), events.where(late))):
        part.coalesce(1).write.parquet(f"{base}/in/{number}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(f"{base}/in/*")
    once = event_time.with_watermark(stream, "ts", _LAG_MS).dropDuplicatesWithinWatermark(["event_id"])
    query = (
        once.writeStream.format("parquet")
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(f"{base}/out")
    )
    query.awaitTermination()
    kept = spark.read.schema(once.schema).parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("kept"))
    return kept.withColumn("dropped", F.lit(dropped_late(query)).cast("bigint"))


COUNTS = ("source_read_count", "schema_rejected_count", "transformed_count", "target_written_count")

_JOB_SQL = "SELECT event_id, user_id, event_type, value FROM live WHERE value > 20"

_JOB_ORACLE = f"""WITH {CLASSED}
    SELECT count(*) AS source_read_count, count(*) FILTER (WHERE error_type IS NOT NULL) AS schema_rejected_count,
           count(*) FILTER (WHERE error_type IS NULL AND value > 20) AS transformed_count,
           count(*) FILTER (WHERE error_type IS NULL AND value > 20) AS target_written_count,
           count(*) FILTER (WHERE error_type IS NOT NULL) = 0 AS reconciled,
           '["Schema validation rejected ' || count(*) FILTER (WHERE error_type IS NOT NULL) || ' record(s)"]'
             AS discrepancies,
           count(*) FILTER (WHERE error_type IS NULL AND value > 20) AS delivered,
           count(*) FILTER (WHERE error_type IS NOT NULL) AS dead_letters
    FROM classed"""


def _write_messages(rows: DataFrame, path: str, files: int | None) -> None:
    rows = rows.select("value")
    (rows.repartition(files) if files else rows).write.mode("append").text(path)


def _add_messages(rows: DataFrame, job: spec.Job, files: int | None = None) -> None:
    _write_messages(rows, job.sources[0].files.path, files)


def job_spec(spark: SparkSession, folder: str, files: int | None = None, rows: DataFrame | None = None) -> dict:
    """A whole job over message files that Spark writes from the events table, or from ``rows`` of it."""
    base = fresh_path(spark, "job")
    _write_messages(messages.raw_events(spark, folder) if rows is None else rows, f"{base}/in", files)
    return {
        "jobName": "events-job",
        "sources": [
            {"tableName": "live", "files": {"path": f"{base}/in"}, "schema": {"definition": messages.EVENTS_SCHEMA}}
        ],
        "transformation": {"type": "INLINE", "sqlContent": _JOB_SQL, "resultTableName": "kept"},
        "target": {"type": "FILE", "path": f"{base}/out", "fileFormat": "text", "kafka": {"format": "JSON"}},
        "engine": {"checkpointDir": f"{base}/checkpoint"},
        "dlq": {"enabled": True, "path": f"{base}/dlq"},
        "audit": {"sinkType": "FILE", "destination": f"{base}/audit"},
        "reconciliation": {"sinkType": "FILE", "destination": f"{base}/reports"},
    }


def _outcome(spark: SparkSession, job: spec.Job, report: DataFrame) -> DataFrame:
    delivered = spark.read.text(job.target.path).agg(F.count(F.lit(1)).alias("delivered"))
    letters = spark.read.text(f"{job.dlq.path}/live").agg(F.count(F.lit(1)).alias("dead_letters"))
    counts = report.select(*COUNTS, "reconciled", "discrepancies")
    # One row each: stacked and folded into one.
    return counts.unionByName(delivered, True).unionByName(letters, True).agg(
        *[F.max(c).alias(c) for c in (*COUNTS, "reconciled", "discrepancies", "delivered", "dead_letters")]
    )


@query("job_batch", _JOB_ORACLE)
def job_batch(spark, folder):
    """Source, SQL, target, dead letters, audit and report of a bounded run."""
    job = spec.load(job_spec(spark, folder))
    return _outcome(spark, job, runner.run_batch(spark, job).report)


@query("job_stream", _JOB_ORACLE)
def job_stream(spark, folder):
    """The same specification as streams, run to the end of the input."""
    job = spec.load(job_spec(spark, folder))
    report = runner.run_stream(spark, job, available_now=True).await_end(timeout=1800)
    return _outcome(spark, job, report)


@query("job_many_batches", _JOB_ORACLE)
def job_many_batches(spark, folder):
    """A stream of one input file per batch, of which the session remembers two: all are counted."""
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, "2")
    try:
        form = job_spec(spark, folder, files=24)
        form["sources"][0]["files"]["options"] = {"maxFilesPerTrigger": "1"}
        job = spec.load(form)
        return _outcome(spark, job, runner.run_stream(spark, job, available_now=True).await_end(timeout=1800))
    finally:
        spark.conf.set(kept, before)


@query(
    "job_windowed_reports",
    f"""WITH {CLASSED}
        SELECT count(*) AS source_read_count, count(*) FILTER (WHERE error_type IS NOT NULL) AS schema_rejected_count,
               count(*) FILTER (WHERE error_type IS NULL AND value > 20) AS transformed_count,
               count(*) FILTER (WHERE error_type IS NULL AND value > 20) AS target_written_count,
               0 AS lagging, '1h' AS window_label
        FROM classed""",
)
def job_windowed_reports(spark, folder):
    """The reports by window that a stream leaves behind add up to the whole run."""
    job = spec.load(job_spec(spark, folder))
    runner.run_stream(spark, job, available_now=True).await_end(timeout=1800)
    reports = spark.read.parquet(job.reconciliation.destination)
    # A window's report spans the window; the report of the whole run spans its counts.
    width = F.unix_seconds("window_end") - F.unix_seconds("window_start")
    return reports.where((width == 3600) & (F.unix_seconds("window_start") % 3600 == 0)).agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.count_if(F.col("discrepancies").contains("lag")).cast("int").alias("lagging"),
        F.max("window_label").alias("window_label"),
    )


@query(
    "job_lossy_target",
    f"""WITH {CLASSED},
        kept AS (SELECT event_id FROM classed WHERE error_type IS NULL AND value > 20),
        sums AS (
          SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 31 <> 0) AS lossy,
                 count(*) + count(*) FILTER (WHERE event_id % 37 = 0) AS doubled FROM kept)
        SELECT 'lossy' AS target, n AS transformed_count, lossy AS target_written_count, lossy = n AS reconciled,
               CASE WHEN lossy < n THEN printf('Target lag: %d records transformed but only %d written (%.2f%% loss, tolerance=0.00%%)',
                 n, lossy, CAST(100.0 * (n - lossy) / n AS DOUBLE)) END AS found FROM sums
        UNION ALL
        SELECT 'doubling', n, doubled, doubled = n,
               CASE WHEN doubled > n THEN printf('Unexpected duplication: %d written > %d transformed', doubled, n) END FROM sums""",
)
def job_lossy_target(spark, folder):
    """Targets that lose and double known rows: written is what they hold, not what was sent."""

    def writing(copies):
        def write(rows, target):
            number = F.get_json_object("value", "$.event_id").cast("bigint")
            put = rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies(number)))).drop("_copy")
            connectors.write_outgoing(put, target)

        return write

    reports = []
    for name, copies in (
        ("lossy", lambda n: F.when(n % 31 == 0, 0).otherwise(1)),
        ("doubling", lambda n: F.when(n % 37 == 0, 2).otherwise(1)),
    ):
        job = spec.load(job_spec(spark, folder))
        report = runner.run_batch(spark, job, write=writing(copies)).report
        found = F.from_json("discrepancies", "array<string>")
        other = F.get(F.filter(found, lambda t: ~t.startswith("Schema")), F.lit(0))
        reports.append(
            report.select(
                F.lit(name).alias("target"),
                "transformed_count",
                "target_written_count",
                (F.col("transformed_count") == F.col("target_written_count")).alias("reconciled"),
                other.alias("found"),
            )
        )
    return reports[0].unionByName(reports[1])


def _event_parts(spark: SparkSession, folder: str, parts: int) -> DataFrame:
    """Event messages with the part they arrive in, by their number."""
    return table(spark, folder, "events").select((F.col("event_id") % parts).alias("part"), messages.event_text().alias("value"))


@query(
    "job_ledger",
    f"""WITH {CLASSED}
        SELECT count(*) AS source_read_count, count(*) FILTER (WHERE error_type IS NOT NULL) AS schema_rejected_count,
               count(*) FILTER (WHERE error_type IS NULL AND value > 20) AS transformed_count,
               count(*) FILTER (WHERE error_type IS NULL AND value > 20) AS target_written_count,
               24 AS source_batches, 26 AS ledger_rows
        FROM classed""",
)
def job_ledger(spark, folder):
    """24 batches, of which the first half was committed by a process that died before it counted any."""
    form = job_spec(spark, folder, rows=_event_parts(spark, folder, 24).where("part < 12"), files=12)
    form["sources"][0]["files"]["options"] = {"maxFilesPerTrigger": "1"}
    job = spec.load(form)
    for begun in runner.run_stream(spark, job, available_now=True).queries():
        begun.awaitTermination()
    # What the queries told is lost with their process.
    OBSERVATIONS.counts.clear()
    _add_messages(_event_parts(spark, folder, 24).where("part >= 12"), job, 12)
    run = runner.run_stream(spark, job, available_now=True)
    report = run.await_end(timeout=1800)
    rows = run.trail.ledger.rows().agg(
        F.count_if(F.col("stage") == "source").cast("int").alias("source_batches"), F.count(F.lit(1)).cast("int").alias("ledger_rows")
    )
    counts = report.select(*COUNTS).unionByName(rows, True)
    return counts.agg(*[F.max(c).alias(c) for c in (*COUNTS, "source_batches", "ledger_rows")])


_LOST, _DOUBLED = 40, 40

_LOSS = f"""WITH {CLASSED},
    kept AS (SELECT event_id % 4 AS part, event_id, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS n
             FROM classed WHERE error_type IS NULL AND value > 20),
    held AS (SELECT part, count(*) AS transformed,
                    count(*) - count(*) FILTER (WHERE part = 1 AND n <= {_LOST}) + count(*) FILTER (WHERE part = 2 AND n <= {_DOUBLED}) AS written
             FROM kept GROUP BY part)
    SELECT CAST(part AS BIGINT) AS batch, transformed AS transformed_count, written AS target_written_count,
           written < transformed AS lag, written > transformed AS duplication, transformed = written AS reconciled FROM held"""


@query("job_loss_in_window", _LOSS)
def job_loss_in_window(spark, folder):
    """A target that loses rows of one batch and doubles as many of another: each shows in its own window."""
    parts = _event_parts(spark, folder, 4)
    form = job_spec(spark, folder, rows=parts.where("part = 0"))
    form["target"] = {"type": "FILE", "path": f"{form['target']['path']}", "fileFormat": "parquet", "batchColumns": True}
    form["dlq"] = {"enabled": False}
    job = spec.load(form)

    def write(rows, target):
        part = F.col("event_id") % 4
        first = rows.orderBy("event_id").limit(_LOST).select("event_id")
        lossy = rows.where(part == 1).join(first, "event_id", "left_anti")
        doubled = rows.where(part == 2).join(first, "event_id", "left_semi")
        connectors.write_outgoing(rows.where(part != 1).unionByName(lossy).unionByName(doubled), target)

    for number in range(4):
        if number:
            _add_messages(parts.where(F.col("part") == number), job)
        run = runner.run_stream(spark, job, available_now=True, write=write)
        run.await_end(timeout=1800)
    rows = run.trail.ledger.rows().where("stage = 'main'")
    # Every batch in a window of its own: its number stands for the time.
    placed = rows.withColumn("at_ms", F.col("batch") * 3_600_000)
    spread = audit.events_from_counts(
        placed.select(F.lit("run").alias("run_id"), F.lit("job").alias("job_name"), F.lit(0).alias("read"), F.lit(0).alias("rejected"),
                      "transformed", "written", "at_ms", "batch"),
        F.lit("s"), F.lit("t"), F.timestamp_millis("at_ms"), F.struct(F.col("batch").cast("string").alias("batch_id")),
    )
    found = reconcile.by_window(spread, "1h")
    return found.select(
        (F.unix_seconds("window_start") / 3600).cast("bigint").alias("batch"), "transformed_count", "target_written_count",
        F.col("discrepancies").contains("lag").alias("lag"), F.col("discrepancies").contains("duplication").alias("duplication"), "reconciled",
    )


@query(
    "sink_parquet_roundtrip",
    "SELECT o_orderkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS placed FROM orders",
)
def sink_parquet_roundtrip(spark, folder):
    """A typed file source to a FILE target, partitioned by status."""
    out = fresh_path(spark, "sink")
    job = spec.load(
        {
            "jobName": "copy",
            "sources": [{"tableName": "orders_in", "files": {"path": f"{folder}/orders.parquet", "format": "parquet"}}],
            "transformation": {"sqlContent": "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders_in"},
            "target": {"type": "FILE", "path": out, "partitionBy": ["o_orderstatus"]},
        }
    )
    runner.run_batch(spark, job)
    back = spark.read.parquet(out)
    return back.select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("placed")
    )
