"""Ingest, rejects, dead letters and event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import serialize
from ..plans.runner import intake
from ..plans.spec import Files, Schema, Source, Transformation, Watermark
from ..plans.transform import register, run_sql
from ..sources import ingest
from ..sources.schema import declared
from ..streaming.event_time import EventTime, to_timestamp
from . import messages
from .messages import CLASSED
from .registry import query, table


def _verdicts(spark, folder):
    return ingest.classify(messages.raw_events(spark, folder), messages.events_schema())


@query(
    "raw_f0",
    """SELECT CASE WHEN event_id % 29 <> 0 THEN event_id ELSE -1 END AS event_id,
              event_id % 29 = 0 AS is_cut
       FROM events""",
)
def raw_f0(spark, folder):
    raw = ingest.raw_table(messages.raw_events(spark, folder))
    number = F.regexp_extract("f0", r'"event_id":(\d+)', 1)
    return raw.select(
        F.when(number != "", number.cast("bigint")).otherwise(-1).alias("event_id"),
        (F.col("f0") == F.lit('{"event_id')).alias("is_cut"),
    )


@query(
    "ingest_json_valid",
    f"""WITH {CLASSED}
        SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ts,
               CASE WHEN event_id % 13 <> 0 THEN props END AS props
        FROM classed WHERE error_type IS NULL""",
)
def ingest_json_valid(spark, folder):
    return ingest.accepted(_verdicts(spark, folder))


@query(
    "ingest_json_rejected",
    f"""WITH {CLASSED}
        SELECT CASE WHEN error_type <> 'MALFORMED' THEN event_id ELSE -1 END AS event_id,
               error_type, error_message
        FROM classed WHERE error_type IS NOT NULL""",
)
def ingest_json_rejected(spark, folder):
    number = F.regexp_extract("raw.value", r'"event_id":(\d+)', 1)
    return ingest.rejected(_verdicts(spark, folder)).select(
        F.when(number != "", number.cast("bigint")).otherwise(-1).alias("event_id"), "error_type", "error_message"
    )


@query(
    "reject_counts_by_reason",
    f"""WITH {CLASSED}
        SELECT error_type, error_message, count(*) AS records
        FROM classed WHERE error_type IS NOT NULL GROUP BY 1, 2""",
)
def reject_counts_by_reason(spark, folder):
    rejected = ingest.rejected(_verdicts(spark, folder))
    return rejected.groupBy("error_type", "error_message").agg(F.count(F.lit(1)).alias("records"))


@query(
    "dlq_envelope",
    f"""WITH {CLASSED}
        SELECT CASE WHEN error_type <> 'MALFORMED' THEN event_id ELSE -1 END AS event_id,
               error_type AS "errorType", error_message AS "errorMessage", 'events' AS sourcetopic, 'orders-job' AS "jobName",
               true AS has_time, true AS whole
        FROM classed WHERE error_type IS NOT NULL""",
)
def dlq_envelope(spark, folder):
    letters = ingest.dead_letters(_verdicts(spark, folder), "events", "orders-job")
    shape = (
        "originalPayload string, errorType string, errorMessage string, "
        "sourcetopic string, jobName string, timestamp string"
    )
    fields = letters.select(F.from_json("value", shape).alias("e")).select("e.*")
    number = F.regexp_extract("originalPayload", r'"event_id":(\d+)', 1)
    return fields.select(
        F.when(number != "", number.cast("bigint")).otherwise(-1).alias("event_id"),
        "errorType",
        "errorMessage",
        "sourcetopic",
        "jobName",
        F.col("originalPayload").isNotNull().alias("whole"),
        F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$").alias("has_time"),
    )


@query(
    "conformance_profile",
    f"""WITH {CLASSED},
        cells AS (
          SELECT coalesce(error_type, 'ACCEPTED') AS outcome, error_type = 'MALFORMED' AS cut, event_id, error_message
          FROM classed),
        facts AS (
          SELECT outcome, f.field,
            CASE WHEN coalesce(cut, false) THEN 1
                 WHEN f.field = 'user_id' AND error_message = '$.user_id: required' THEN 1
                 WHEN f.field = 'props' AND outcome = 'ACCEPTED' AND event_id % 13 = 0 THEN 1
                 ELSE 0 END AS is_null
          FROM cells,
            (VALUES ('event_id'), ('user_id'), ('event_type'), ('value'), ('ts'), ('props')) AS f(field))
        SELECT outcome, count(*) AS rows, field, CAST(sum(is_null) AS BIGINT) AS nulls
        FROM facts GROUP BY outcome, field""",
)
def conformance_profile(spark, folder):
    return ingest.conformance(_verdicts(spark, folder), messages.events_schema())


@query(
    "ingest_avro_json",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS o_orderstatus,
              o_totalprice
       FROM orders""",
)
def ingest_avro_json(spark, folder):
    raw = messages.raw_orders_avro(spark, folder)
    return ingest.accepted(ingest.classify(raw, messages.orders_avro()))


@query(
    "event_time_parse",
    """SELECT event_id, epoch_us(ts) // 1000 AS from_millis, epoch_us(date_trunc('second', ts)) AS from_text,
              event_id % 7 = 0 AS unparseable
       FROM events""",
)
def event_time_parse(spark, folder):
    pattern = "dd/MM/yyyy HH:mm:ss"
    shown = table(spark, folder, "events").select(
        "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"),
        F.date_format("ts", pattern).alias("text"),
        F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.date_format("ts", pattern)).alias("mixed"),
    )
    return shown.select(
        "event_id",
        F.unix_millis(to_timestamp(F.col("millis"), "bigint")).alias("from_millis"),
        F.unix_micros(to_timestamp(F.col("text"), "string", pattern)).alias("from_text"),
        to_timestamp(F.col("mixed"), "string", pattern).isNull().alias("unparseable"),
    )


@query(
    "event_time_ingest",
    f"""WITH {CLASSED}
        SELECT event_id, user_id, epoch_us(date_trunc('millisecond', ts)) AS ts_us
        FROM classed WHERE error_type IS NULL""",
)
def event_time_ingest(spark, folder):
    """EXISTING mode: the declared epoch column becomes the event time of the view."""
    verdicts = ingest.classify(
        messages.raw_events(spark, folder), messages.events_schema(), event_time=EventTime("ts")
    )
    return ingest.accepted(verdicts).select("event_id", "user_id", F.unix_micros("ts").alias("ts_us"))


def _flow(spark, folder, sql, watermark=None):
    """Events as messages through the source layer into a view, then one query."""
    source = Source(
        table_name="events_raw",
        files=Files(path=folder),
        schema=Schema(messages.EVENTS_SCHEMA),
        watermark=watermark or Watermark(),
    )
    taken = intake(messages.raw_events(spark, folder), source)
    register(source, taken.view)
    return run_sql(spark, Transformation(sql_content=sql))


@query(
    "sql_filter",
    f"""WITH {CLASSED}
        SELECT event_id, user_id, event_type, value FROM classed
        WHERE error_type IS NULL AND value > 100""",
)
def sql_filter(spark, folder):
    return _flow(spark, folder, "SELECT event_id, user_id, event_type, value FROM events_raw WHERE value > 100")


@query(
    "proctime_column",
    f"""WITH {CLASSED}
        SELECT event_type, count(*) AS records, count(*) AS stamped FROM classed
        WHERE error_type IS NULL GROUP BY event_type""",
)
def proctime_column(spark, folder):
    return _flow(
        spark,
        folder,
        "SELECT event_type, count(*) AS records, count(processed_time) AS stamped FROM events_raw GROUP BY event_type",
        Watermark(strategy="BOUNDED", mode="PROCESS_TIME"),
    )


@query(
    "multi_source_join",
    """SELECT c_mktsegment, o_orderstatus, count(*) AS orders,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_totalprice > 1000
       GROUP BY 1, 2""",
)
def multi_source_join(spark, folder):
    """Two sources of one job: order messages, and customer rows under an alias."""
    orders = Source(table_name="orders_raw", files=Files(folder), schema=Schema(messages.ORDERS_SCHEMA))
    customers = Source(table_name="customers", alias="c", files=Files(folder, "parquet"))
    register(orders, intake(messages.raw_orders(spark, folder), orders).view)
    register(customers, intake(table(spark, folder, "customer"), customers).view)
    return run_sql(
        spark,
        Transformation(
            sql_content="""SELECT c.c_mktsegment, o.o_orderstatus, count(*) AS orders,
                   CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
            FROM orders_raw o JOIN c ON o.o_custkey = c.c_custkey
            WHERE o.o_totalprice > 1000
            GROUP BY c.c_mktsegment, o.o_orderstatus"""
        ),
    )


@query(
    "ser_json",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS status, o_totalprice AS price,
              strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS placed, 5 AS members
       FROM orders""",
)
def ser_json(spark, folder):
    """JSON messages, read back member by member; NULL members must still be there."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice",
        "o_orderdate",
        "o_orderpriority",
    )
    text = rows.select(serialize.json_value(rows).alias("value"))
    members = text.select(F.from_json("value", "map<string,string>").alias("m"))
    return members.select(
        F.col("m.o_orderkey").cast("bigint").alias("k"),
        F.col("m.o_orderstatus").alias("status"),
        F.col("m.o_totalprice").cast("double").alias("price"),
        F.col("m.o_orderdate").alias("placed"),
        F.size("m").alias("members"),
    )


@query(
    "ser_json_nested",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || coalesce('.' || nullif(rtrim(strftime(ts, '%f'), '0'), ''), '') AS local,
              epoch_us(ts) AS instant, event_id % 9 = 0 AS absent
       FROM events""",
)
def ser_json_nested(spark, folder):
    """Moments inside structs, arrays and maps keep their microseconds; absent structs stay NULL."""
    at = F.col("ts").cast("timestamp_ntz")
    rows = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_id") % 9 != 0, F.struct(at.alias("at"))).alias("s"),
        F.array(at).alias("l"),
        F.create_map(F.lit("k"), F.struct(at.cast("timestamp").alias("at"))).alias("m"),
    )
    shape = "event_id bigint, s struct<at:string>, l array<string>, m map<string,struct<at:string>>"
    read = rows.select(F.from_json(serialize.json_value(rows), shape).alias("r")).select("r.*")
    return read.select(
        "event_id",
        F.get("l", F.lit(0)).alias("local"),
        F.unix_micros(F.col("m")["k"]["at"].cast("timestamp")).alias("instant"),
        F.col("s").isNull().alias("absent"),
    )


_KEYWORDS = """{"type": "object", "properties": {"event_id": {"type": "integer", "multipleOf": 3}, "tags": {"type": "array",
  "contains": {"type": "integer", "minimum": 5}, "minContains": 1, "maxContains": 2},
  "step": {"type": "number", "multipleOf": 0.05}, "kind": {"type": "string"}},
  "patternProperties": {"^n_": {"type": "integer"}}, "propertyNames": {"maxLength": 8},
  "dependentSchemas": {"kind": {"required": ["step"]}}}"""


@query(
    "ingest_json_keywords",
    """SELECT event_id, CASE
           WHEN event_id % 3 <> 0 THEN 'multiple' WHEN event_id % 10 < 5 OR event_id % 10 = 9 THEN 'contains'
           WHEN event_id % 4 = 1 AND event_id % 13 <> 1 THEN 'step' WHEN event_id % 7 = 1 THEN 'pattern' WHEN event_id % 11 = 1 THEN 'name'
           WHEN event_id % 13 = 1 THEN 'dependent' END AS fault
       FROM events""",
)
def ingest_json_keywords(spark, folder):
    """Keywords on members, names and array elements; each message breaks at most one rule first."""
    number = F.col("event_id")
    digit = (number % 10).cast("string")
    # The last digit, a five where it is nine, and another five.
    tags = F.concat(F.lit("["), digit, F.when(number % 10 == 9, F.lit(",5,6")).otherwise(F.lit(",1")), F.lit("]"))
    step = F.when(number % 4 == 1, F.lit("1.0e-12")).when(number % 4 == 2, F.lit("1e35")).otherwise(F.lit("0.15"))
    text = F.concat(
        F.lit('{"event_id":'), number.cast("string"), F.lit(',"tags":'), tags,
        F.when(number % 13 == 1, F.lit("")).otherwise(F.concat(F.lit(',"step":'), step)),
        F.when(number % 7 == 1, F.lit(',"n_x":"text"')).otherwise(F.lit(',"n_x":7')),
        F.when(number % 11 == 1, F.lit(',"far_too_long":1')).otherwise(F.lit("")),
        F.lit(',"kind":"a"}'),
    )
    raw = table(spark, folder, "events").select("event_id", text.alias("value"))
    verdicts = ingest.classify(raw, declared(_KEYWORDS, "JSON"))
    message = F.col("error_message")
    fault = (
        F.when(message.contains("multiple of 3"), "multiple")
        .when(message.contains("matching array"), "contains")
        .when(message.contains("multiple of 0.05"), "step")
        .when(message.contains("property like"), "pattern")
        .when(message.contains("property name"), "name")
        .when(message.contains("step is required") | message.contains("$.step: required"), "dependent")
    )
    return verdicts.select(F.col("raw.event_id").alias("event_id"), fault.alias("fault"))


@query(
    "ser_string",
    """SELECT '+I[' || n_nationkey || ', ' || n_name || ', '
              || CASE WHEN n_regionkey = 0 THEN 'null' ELSE CAST(n_regionkey AS VARCHAR) END || ', '
              || c_custkey || ', ' || c_mktsegment || ']' AS value
       FROM nation JOIN customer ON c_nationkey = n_nationkey""",
)
def ser_string(spark, folder):
    joined = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    rows = joined.select(
        "n_nationkey",
        "n_name",
        F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")).alias("n_regionkey"),
        "c_custkey",
        "c_mktsegment",
    )
    return rows.select(serialize.string_value(rows).alias("value"))


@query(
    "format_json_roundtrip",
    """SELECT event_id, event_type, value, epoch_us(ts) AS ts_us FROM events""",
)
def format_json_roundtrip(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp"))
    text = rows.select(serialize.json_value(rows).alias("value"))
    back = text.select(
        F.from_json("value", "event_id bigint, event_type string, value double, ts timestamp").alias("r")
    )
    return back.select("r.event_id", "r.event_type", "r.value", F.unix_micros("r.ts").alias("ts_us"))


@query(
    "align_avro",
    """SELECT epoch_ms(o_orderdate) AS placed_ms, CAST(o_orderkey AS BIGINT) AS o_orderkey,
              CAST(NULL AS VARCHAR) AS note, 'web' AS channel, o_totalprice
       FROM orders""",
)
def align_avro(spark, folder):
    """By name and in the schema's order; temporals to epoch milliseconds, gaps from defaults."""
    import json

    from ..sources.schema import avro_schema

    schema = avro_schema(
        json.dumps(
            {
                "type": "record",
                "name": "order",
                "fields": [
                    {"name": "placed_ms", "type": "long"},
                    {"name": "o_orderkey", "type": "long"},
                    {"name": "note", "type": ["null", "string"]},
                    {"name": "channel", "type": "string", "default": "web"},
                    {"name": "o_totalprice", "type": "double"},
                ],
            }
        )
    )
    rows = table(spark, folder, "orders").select(
        "o_totalprice", "o_custkey", "o_orderkey", F.col("o_orderdate").alias("placed_ms")
    )
    return serialize.align_avro(rows, schema)
