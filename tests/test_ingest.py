import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.validation import SchemaError
from millrace.sources import ingest
from millrace.sources.schema import avro_schema, json_schema
from millrace.streaming.event_time import EventTime

STRICT = {
    "type": "object",
    "properties": {"id": {"type": "integer"}, "name": {"type": "string"}},
    "required": ["id", "name"],
}


def verdict(df, schema):
    """error_type per message, in input order of distinct texts."""
    rows = ingest.classify(df, json_schema(json.dumps(schema))).select("raw.value", "error_type", "row").collect()
    return {r["value"]: (r["error_type"], tuple(r["row"])) for r in rows}


def one(texts, text, part, required=False):
    schema = {"type": "object", "properties": {"x": part}, **({"required": ["x"]} if required else {})}
    return verdict(texts(text), schema)[text][0]


def test_valid_missing_malformed_and_absent(texts):
    strict = verdict(texts('{"name":"Zoë","id":-40}', '{"id":17}', "{id: 3}"), STRICT)
    assert strict['{"name":"Zoë","id":-40}'] == (None, (-40, "Zoë"))
    assert strict['{"id":17}'][0] == ingest.SCHEMA_VALIDATION
    assert strict["{id: 3}"][0] == ingest.MALFORMED
    relaxed = {k: v for k, v in STRICT.items() if k != "required"}
    assert verdict(texts('{"id":5}'), relaxed)['{"id":5}'] == (None, (5, None))


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", ingest.MALFORMED),
        ("[1]", ingest.SCHEMA_VALIDATION),
        ("5", ingest.SCHEMA_VALIDATION),
        ('{"id":1.0}', None),
        ('{"id":1.5}', ingest.SCHEMA_VALIDATION),
        ('{"id":"x"}', ingest.SCHEMA_VALIDATION),
        ('{"id":null}', ingest.SCHEMA_VALIDATION),
        ('{"id":3000000000}', ingest.TYPE_CONVERSION),
        ('{"id":1} trailing', None),
        ('{"id":1,"id":2}', None),
        ('\t{"id":1}', None),
        ('{"id":1,"name":"žluť"}', None),
    ],
)
def test_edges(texts, text, expected):
    schema = {"type": "object", "properties": {"id": {"type": "integer"}, "name": {"type": "string"}}}
    assert verdict(texts(text), schema)[text][0] == expected


def test_values_of_edges(texts):
    schema = {"properties": {"id": {"type": "integer"}, "any": {}}}
    got = verdict(
        texts('{"id":1,"id":2}', '{"any":{"a":[1,2]}}', '{"any":true}', '{"any":1.50}', '{"any":null}'), schema
    )
    assert got['{"id":1,"id":2}'][1] == (2, None)
    assert got['{"any":{"a":[1,2]}}'][1] == (None, '{"a":[1,2]}')
    assert got['{"any":true}'][1] == (None, "true")
    assert got['{"any":1.50}'][1] == (None, "1.5")
    assert got['{"any":null}'][1] == (None, None)


def test_int64_keeps_large_integers(texts):
    schema = {"properties": {"id": {"type": "integer", "format": "int64"}}}
    assert verdict(texts('{"id":3000000000}'), schema)['{"id":3000000000}'] == (None, (3000000000,))


@pytest.mark.parametrize(
    "part, good, bad",
    [
        ({"enum": ["a", 1, None]}, ['"a"', "1", "1.0", "null"], ['"b"', "2", "true"]),
        ({"const": 2.5}, ["2.5"], ["2", '"2.5"']),
        ({"minimum": 2, "maximum": 3}, ["2", "3.0", '"9"'], ["1.9", "3.1"]),
        ({"exclusiveMinimum": 2, "exclusiveMaximum": 3}, ["2.5"], ["2", "3"]),
        ({"multipleOf": 0.01}, ["4.35", "1", "1e35", "0", "-7.10"], ["4.355", "1e-12", "0.000000000000000001"]),
        ({"multipleOf": 3}, ["9", "3e35", "300000000000000000000000000003", "-6", "0.0"], ["1e35", "1e-12", "10", "3.000000000001"]),
        ({"multipleOf": 7e4}, ["140000", "7e300"], ["7", "1e300"]),
        ({"const": 0}, ["0", "0.0", "0e5"], ["0.000000000001", "1e-12"]),
        ({"enum": [10**30, 5]}, ["1000000000000000000000000000000", "5.00", "5e0"], ["1000000000000000000000000000001", "1e29"]),
        ({"contains": {"const": 1}, "minContains": 2}, ["[1,1]", "[1,2,1]"], ["[1]", "[]"]),
        ({"contains": {"const": 1}, "maxContains": 1}, ["[1]", "[1,2]"], ["[1,1]", "[2]"]),
        ({"contains": {"const": 1}, "minContains": 0, "maxContains": 1}, ["[]", "[1]"], ["[1,1]"]),
        ({"patternProperties": {"^n": {"type": "integer"}}}, ['{"n":1,"m":"x"}', "{}"], ['{"nn":"x"}']),
        ({"patternProperties": {"^n": {}}, "additionalProperties": False}, ['{"n":1}'], ['{"m":1}']),
        ({"propertyNames": {"maxLength": 2, "pattern": "^a"}}, ['{"a":1,"ab":2}', "7"], ['{"abc":1}', '{"b":1}']),
        ({"dependentSchemas": {"a": {"required": ["b"]}}}, ['{"b":1}', '{"a":1,"b":2}', "{}"], ['{"a":1}']),
        ({"minLength": 2, "maxLength": 3}, ['"ab"', '"žšč"', "7"], ['"a"', '"abcd"']),
        ({"pattern": "^a.c$"}, ['"abc"', "5"], ['"abd"']),
        ({"type": ["string", "null"]}, ['"s"', "null"], ["1"]),
        ({"type": "array", "items": {"type": "integer"}}, ["[]", "[1,2]"], ['[1,"x"]', "{}"]),
        (
            {"items": {"type": "array", "items": {"properties": {"a": {"type": "integer"}}, "required": ["a"]}}},
            ["[]", '[[{"a":1},{"a":2}],[]]', "5"],
            ["[1]", '[[{"a":1},{"a":"x"}]]', "[[{}]]"],
        ),
        ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, ["[1]", "[1,2]", "{}"], ["[]", "[1,1]", "[1,2,3]"]),
        ({"contains": {"type": "string"}}, ['[1,"a"]', "5"], ["[1]", "[]"]),
        (
            {"properties": {"a": {"type": "integer"}}, "required": ["a"], "additionalProperties": False},
            ['{"a":1}', "5"],
            ["{}", '{"a":"x"}', '{"a":1,"b":1}'],
        ),
        ({"additionalProperties": {"type": "integer"}}, ['{"q":1}'], ['{"q":"x"}']),
        ({"minProperties": 1, "maxProperties": 1}, ['{"a":1}'], ["{}", '{"a":1,"b":2}']),
        ({"dependentRequired": {"a": ["b"]}}, ['{"a":1,"b":1}', '{"b":1}'], ['{"a":1}']),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ['"s"', "6"], ["4"]),
        ({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, ["3", "5.5"], ["6"]),
        ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, ["1.5"], ["3", "0"]),
        ({"not": {"type": "string"}}, ["1"], ['"s"']),
        (
            {"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 0}},
            ['"ab"', "1"],
            ['"a"', "-1"],
        ),
    ],
)
def test_keywords(texts, part, good, bad):
    schema = {"type": "object", "properties": {"x": part}}
    messages = {v: f'{{"x":{v}}}' for v in good + bad}
    got = verdict(texts(*messages.values(), "{}"), schema)
    assert got["{}"][0] is None, "an absent optional member is valid"
    assert {v: got[m][0] for v, m in messages.items()} == {
        **{v: None for v in good},
        **{v: ingest.SCHEMA_VALIDATION for v in bad},
    }


def test_root_keywords_and_references(texts):
    schema = {
        "type": "object",
        "$defs": {"key": {"type": "integer", "minimum": 1}},
        "properties": {"a": {"$ref": "#/$defs/key"}, "b": {"$ref": "#/$defs/key"}},
        "additionalProperties": False,
        "minProperties": 1,
    }
    got = verdict(texts('{"a":1}', '{"b":0}', '{"c":1}', "{}"), schema)
    assert [got[k][0] for k in ('{"a":1}', '{"b":0}', '{"c":1}', "{}")] == [None] + [ingest.SCHEMA_VALIDATION] * 3


@pytest.mark.parametrize(
    "schema",
    [
        {"properties": {"x": {"unevaluatedItems": False}}},
        {"properties": {"x": {"type": "date"}}},
        {"properties": {"x": {"$ref": "http://elsewhere/schema"}}},
        {"properties": {"x": {"$ref": "#/$defs/none"}}},
        {"$defs": {"n": {"properties": {"n": {"$ref": "#/$defs/n"}}}}, "properties": {"x": {"$ref": "#/$defs/n"}}},
        {"type": "array", "properties": {"x": {}}},
        {"properties": {"x": {"enum": [{"a": 1}]}}},
    ],
)
def test_what_cannot_be_checked_fails_when_the_plan_is_built(texts, schema):
    with pytest.raises(SchemaError):
        ingest.classify(texts("{}"), json_schema(json.dumps(schema)))


AVRO = {
    "type": "record",
    "name": "r",
    "namespace": "n",
    "fields": [
        {"name": "k", "type": "int"},
        {"name": "f", "type": "float"},
        {"name": "u", "type": ["null", "string", "long"]},
        {"name": "e", "type": {"type": "enum", "name": "e", "symbols": ["A", "B"]}},
        {"name": "l", "type": {"type": "array", "items": "int"}},
        {"name": "m", "type": {"type": "map", "values": "string"}},
        {
            "name": "s",
            "type": ["null", {"type": "record", "name": "inner", "namespace": "n", "fields": [{"name": "q", "type": "boolean"}]}],
        },
    ],
}


def avro_message(**changes):
    base = {
        "k": 1,
        "f": 0.5,
        "u": {"string": "x"},
        "e": "A",
        "l": [1],
        "m": {"a": "b"},
        "s": {"n.inner": {"q": True}},
    }
    return json.dumps({k: v for k, v in {**base, **changes}.items() if v != "absent"})


def test_avro_json(texts):
    cases = {
        avro_message(): (None, (1, 0.5, "x", "A", "[1]", '{"a":"b"}', '{"q":true}')),
        avro_message(u=None, s=None): (None, (1, 0.5, None, "A", "[1]", '{"a":"b"}', None)),
        avro_message(u={"long": 7}): (None, (1, 0.5, "7", "A", "[1]", '{"a":"b"}', '{"q":true}')),
        avro_message(u="x"): (ingest.MALFORMED, None),
        avro_message(u={"int": 1}): (ingest.MALFORMED, None),
        avro_message(k="absent"): (ingest.MALFORMED, None),
        avro_message(k=2**40): (ingest.TYPE_CONVERSION, None),
        avro_message(e="C"): (ingest.MALFORMED, None),
        avro_message(l=["x"]): (ingest.MALFORMED, None),
        avro_message(m={"a": 1}): (ingest.MALFORMED, None),
        avro_message(s={"n.inner": {}}): (ingest.MALFORMED, None),
        "oops": (ingest.MALFORMED, None),
        "[1]": (ingest.MALFORMED, None),
    }
    rows = ingest.classify(texts(*cases), avro_schema(json.dumps(AVRO))).select("raw.value", "error_type", "row").collect()
    for row in rows:
        kind, values = cases[row["value"]]
        assert row["error_type"] == kind, row["value"]
        if values is not None:
            assert tuple(row["row"]) == values


def test_read_is_accepted_plus_rejected(spark, texts):
    verdicts = ingest.classify(texts('{"id":1,"name":"a"}', "x", '{"id":2}'), json_schema(json.dumps(STRICT)))
    counts = verdicts.agg(*ingest.intake_metrics()).first()
    assert counts["read"] == ingest.accepted(verdicts).count() + ingest.rejected(verdicts).count() == 3
    assert counts["rejected"] == 2


def test_dead_letter_keeps_the_whole_payload_and_metadata(spark):
    long = "x" * 100_000
    raw = spark.createDataFrame([(long, "orders", 7)], "value string, topic string, offset bigint")
    verdicts = ingest.classify(raw, json_schema(json.dumps(STRICT)))
    assert verdicts.select("raw.offset").first()[0] == 7
    letter = json.loads(ingest.dead_letters(verdicts, "orders", "job").first()["value"])
    assert list(letter) == ["originalPayload", "errorType", "errorMessage", "sourcetopic", "jobName", "timestamp"]
    assert letter["originalPayload"] == long
    assert (letter["errorType"], letter["sourcetopic"], letter["jobName"]) == ("MALFORMED", "orders", "job")


def test_event_time_column(texts):
    schema = json_schema('{"properties":{"at":{"type":"string"},"n":{"type":"integer"}}}')
    raw = texts('{"at":"02/01/2024 10:00","n":1}', '{"at":"soon","n":2}', '{"n":3}')
    verdicts = ingest.classify(raw, schema, event_time=EventTime("at", "dd/MM/yyyy HH:mm"))
    rows = {r["row"]["n"]: r for r in verdicts.withColumn("us", F.unix_micros("row.at")).collect()}
    assert rows[1]["us"] == 1704189600_000000 and rows[1]["error_type"] is None
    assert rows[2]["error_type"] == rows[3]["error_type"] == ingest.TYPE_CONVERSION
    with pytest.raises(SchemaError):
        ingest.classify(raw, schema, event_time=EventTime("nowhere"))


def test_declared_names_may_match_transport_columns(spark):
    raw = spark.createDataFrame([('{"value":"v","topic":"t"}', "orders")], "value string, topic string")
    schema = json_schema('{"properties":{"value":{"type":"string"},"topic":{"type":"string"}}}')
    assert tuple(ingest.accepted(ingest.classify(raw, schema)).first()) == ("v", "t")


def test_awkward_names(texts):
    schema = {"properties": {n: {"type": "integer"} for n in ("user-id", "a.b", "it's", "ünï", "select")}}
    text = json.dumps({n: i for i, n in enumerate(schema["properties"])}, ensure_ascii=False)
    assert verdict(texts(text), schema)[text] == (None, (0, 1, 2, 3, 4))
    with pytest.raises(SchemaError):
        verdict(texts("{}"), {"properties": {"both ' and \"": {}}})


def test_raw_table_without_schema(texts):
    table = ingest.raw_table(texts("anything", None))
    assert table.columns == ["f0"] and {r[0] for r in table.collect()} == {"anything", None}
