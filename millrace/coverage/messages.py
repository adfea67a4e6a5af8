"""Raw messages derived from the typed tables, with a known share of broken ones.

The text of a message is damaged by arithmetic on its key, first rule wins, so that the
class of every record follows from the typed table alone:

* events: ``event_id`` divisible by 29, the text is cut to 10 characters; by 23, the
  required ``user_id`` is absent; by 19, ``value`` is sent as a string; by 17,
  ``event_type`` is not in the enum; by 13, the optional ``props`` is absent.
* orders: ``o_orderkey`` divisible by 11, the nullable status is null.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schema import Declared, avro_schema, json_schema
from .registry import table

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

EVENTS_SCHEMA = json.dumps(
    {
        "$schema": "https://json-schema.org/draft/2019-09/schema",
        "type": "object",
        "properties": {
            "event_id": {"type": "integer", "format": "int64"},
            "user_id": {"type": "integer", "format": "int64"},
            "event_type": {"type": "string", "enum": list(EVENT_TYPES)},
            "value": {"type": "number"},
            "ts": {"type": "integer", "format": "int64"},
            "props": {"type": "string"},
        },
        "required": ["event_id", "user_id", "event_type", "value", "ts"],
    }
)

ORDERS_SCHEMA = json.dumps(
    {
        "type": "object",
        "properties": {
            "o_orderkey": {"type": "integer", "format": "int64"},
            "o_custkey": {"type": "integer", "format": "int64"},
            "o_orderstatus": {"type": "string", "minLength": 1, "maxLength": 1},
            "o_totalprice": {"type": "number", "minimum": 0},
            "o_orderdate": {"type": "string"},
        },
        "required": ["o_orderkey", "o_custkey", "o_totalprice"],
    }
)

ORDERS_AVRO = json.dumps(
    {
        "type": "record",
        "name": "order",
        "fields": [
            {"name": "o_orderkey", "type": "long"},
            {"name": "o_custkey", "type": "long"},
            {"name": "o_orderstatus", "type": ["null", "string"]},
            {"name": "o_totalprice", "type": "double"},
        ],
    }
)


def events_schema() -> Declared:
    return json_schema(EVENTS_SCHEMA)


def orders_schema() -> Declared:
    return json_schema(ORDERS_SCHEMA)


def orders_avro() -> Declared:
    return avro_schema(ORDERS_AVRO)


def event_text() -> Column:
    """The message of a typed event, damaged where its key says so."""

    def text(value: str) -> str:
        return f"""to_json(named_struct(
            'event_id', event_id,
            'user_id', CASE WHEN event_id % 29 = 0 OR event_id % 23 <> 0 THEN user_id END,
            'event_type', CASE WHEN event_id % 17 <> 0 OR event_id % 19 = 0 OR event_id % 23 = 0 OR event_id % 29 = 0
                               THEN event_type ELSE 'bogus' END,
            'value', {value},
            'ts', unix_millis(CAST(ts AS TIMESTAMP)),
            'props', CASE WHEN event_id % 13 <> 0 OR event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0
                            OR event_id % 29 = 0 THEN props END))"""

    return F.expr(
        f"""CASE WHEN event_id % 29 = 0 THEN substring({text("value")}, 1, 10)
                 WHEN event_id % 19 = 0 AND event_id % 23 <> 0 THEN {text("CAST(value AS STRING)")}
                 ELSE {text("value")} END"""
    )


def event_messages(events: DataFrame) -> DataFrame:
    """``value STRING`` from typed events, batch or streaming."""
    return events.select(event_text().alias("value"))


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    return event_messages(table(spark, folder, "events"))


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select(
        F.to_json(
            F.struct(
                "o_orderkey",
                "o_custkey",
                "o_orderstatus",
                "o_totalprice",
                F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
            )
        ).alias("value")
    )


def raw_orders_avro(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 11 != 0, F.struct(F.col("o_orderstatus").alias("string")))
    return table(spark, folder, "orders").select(
        F.to_json(
            F.struct("o_orderkey", "o_custkey", status.alias("o_orderstatus"), "o_totalprice"),
            {"ignoreNullFields": "false"},
        ).alias("value")
    )


# The class of each event in plain SQL, for the twins of the ingest queries.
CLASSED = """
classed AS (
  SELECT *,
    CASE WHEN event_id % 29 = 0 THEN 'MALFORMED'
         WHEN event_id % 23 = 0 OR event_id % 19 = 0 OR event_id % 17 = 0 THEN 'SCHEMA_VALIDATION'
    END AS error_type,
    CASE WHEN event_id % 29 = 0 THEN 'not JSON'
         WHEN event_id % 23 = 0 THEN '$.user_id: required'
         WHEN event_id % 19 = 0 THEN '$.value: expected type number'
         WHEN event_id % 17 = 0 THEN '$.event_type: value not in enum'
    END AS error_message
  FROM events)"""
