import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import serialize
from millrace.functions.validation import SchemaError
from millrace.sources.schema import avro_schema


def record(*fields):
    return avro_schema(json.dumps({"type": "record", "name": "r", "fields": list(fields)}))


@pytest.mark.parametrize(
    "moment, instant, local, shown",
    [
        ("2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "2024-01-02T03:04:05"),
        ("2024-01-02 03:04:05.5", "2024-01-02T03:04:05.500Z", "2024-01-02T03:04:05.5", "2024-01-02T03:04:05.500"),
        ("2024-01-02 03:04:05.010203", "2024-01-02T03:04:05.010203Z", "2024-01-02T03:04:05.010203", "2024-01-02T03:04:05.010203"),
        ("2024-01-02 03:04:05.0100", "2024-01-02T03:04:05.010Z", "2024-01-02T03:04:05.01", "2024-01-02T03:04:05.010"),
        ("2024-01-02 03:00:00", "2024-01-02T03:00:00Z", "2024-01-02T03:00:00", "2024-01-02T03:00"),
    ],
)
def test_temporal_text(spark, moment, instant, local, shown):
    rows = spark.sql(f"SELECT TIMESTAMP '{moment}' AS i, TIMESTAMP_NTZ '{moment}' AS l, DATE '2024-01-02' AS d")
    assert json.loads(rows.select(serialize.json_value(rows)).first()[0]) == {"i": instant, "l": local, "d": "2024-01-02"}
    ntz = rows.select("l")
    assert ntz.select(serialize.string_value(ntz)).first()[0] == f"+I[{shown}]"


def test_json_keeps_nulls_order_and_nesting(spark):
    rows = spark.sql(
        "SELECT 1 AS z, CAST(NULL AS STRING) AS a, array(1, 2) AS l, named_struct('q', true) AS s, 1.50 AS d, 'é\"' AS t"
    )
    text = rows.select(serialize.json_value(rows)).first()[0]
    assert text == '{"z":1,"a":null,"l":[1,2],"s":{"q":true},"d":1.50,"t":"é\\""}'


def test_string_form(spark):
    rows = spark.sql("SELECT 7 AS a, 'x, y' AS b, CAST(NULL AS INT) AS c, 1.5D AS d, true AS e")
    assert rows.select(serialize.string_value(rows)).first()[0] == "+I[7, x, y, null, 1.5, true]"


def test_align_by_name_with_widening_and_epoch_millis(spark):
    rows = spark.sql("SELECT TIMESTAMP '1970-01-01 00:00:01.5' AS at, 7 AS n, 'x' AS unused")
    schema = record(
        {"name": "n", "type": "long"},
        {"name": "at", "type": ["null", "long"]},
        {"name": "gone", "type": ["null", "string"]},
        {"name": "dflt", "type": "int", "default": 3},
    )
    aligned = serialize.align_avro(rows, schema)
    assert aligned.columns == ["n", "at", "gone", "dflt"]
    assert tuple(aligned.first()) == (7, 1500, None, 3)
    assert dict(aligned.dtypes)["n"] == "bigint"


@pytest.mark.parametrize(
    "field",
    [{"name": "missing", "type": "int"}, {"name": "wide", "type": "int"}, {"name": "text", "type": "double"}],
)
def test_align_errors(spark, field):
    rows = spark.sql("SELECT CAST(1 AS BIGINT) AS wide, 'x' AS text")
    with pytest.raises(SchemaError):
        serialize.align_avro(rows, record(field))


def test_format_choice():
    assert serialize.message_format("json", None) == "JSON"
    assert serialize.message_format("AVRO", "{}") == "AVRO"
    assert serialize.message_format("AVRO", None) == serialize.message_format("AVRO", "") == "STRING"
    assert serialize.message_format(None, None) == serialize.message_format("whatever", "{}") == "STRING"


def test_json_round_trip_keeps_microseconds(spark):
    rows = spark.range(3).select("id", (F.timestamp_micros(F.col("id") * 1_234_567)).alias("at"))
    text = rows.select(serialize.json_value(rows).alias("value"))
    back = text.select(F.from_json("value", "id bigint, at timestamp").alias("r")).select("r.*")
    assert sorted(back.collect()) == sorted(rows.collect())


def test_nested_moments_keep_their_precision(spark):
    rows = spark.sql(
        "SELECT named_struct('a', TIMESTAMP_NTZ '2024-05-06 07:08:09.000012', 'b', array(TIMESTAMP '2024-05-06 07:08:09.12')) AS s, "
        "map('k', DATE '2024-05-06') AS m, CAST(NULL AS STRUCT<t: TIMESTAMP>) AS gone"
    )
    wanted = {"s": {"a": "2024-05-06T07:08:09.000012", "b": ["2024-05-06T07:08:09.120Z"]}, "m": {"k": "2024-05-06"}, "gone": None}
    assert json.loads(rows.select(serialize.json_value(rows)).first()[0]) == wanted


def test_nested_alignment_by_name(spark):
    rows = spark.sql(
        "SELECT named_struct('y', 'text', 'x', 5, 'extra', 1) AS r, array(named_struct('x', 1)) AS l, map('k', 7) AS m"
    )
    inner = {"type": "record", "name": "i", "fields": [{"name": "x", "type": "long"}, {"name": "y", "type": ["null", "string"]}]}
    listed = {"type": "record", "name": "j", "fields": [{"name": "x", "type": "long"}, {"name": "d", "type": "int", "default": 4}]}
    schema = record(
        {"name": "m", "type": {"type": "map", "values": "long"}},
        {"name": "r", "type": ["null", inner]},
        {"name": "l", "type": {"type": "array", "items": listed}},
    )
    aligned = serialize.align_avro(rows, schema)
    assert aligned.first().asDict(True) == {"m": {"k": 7}, "r": {"x": 5, "y": "text"}, "l": [{"x": 1, "d": 4}]}
    assert dict(aligned.dtypes)["m"] == "map<string,bigint>"
    narrow = {"type": "record", "name": "n", "fields": [{"name": "y", "type": "int"}]}
    for bad in ({"name": "r", "type": narrow}, {"name": "l", "type": narrow}, {"name": "m", "type": {"type": "array", "items": "int"}}):
        with pytest.raises(SchemaError):
            serialize.align_avro(rows, record(bad))
