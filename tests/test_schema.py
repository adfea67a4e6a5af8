import json

import pytest

from millrace.functions.validation import SchemaError
from millrace.sources.schema import avro_schema, declared, json_schema


def _json(name, part):
    return json_schema(json.dumps({"properties": {name: part}})).fields[0].type


def _avro(kind):
    text = json.dumps({"type": "record", "name": "r", "fields": [{"name": "x", "type": kind}]})
    return avro_schema(text).fields[0].type


@pytest.mark.parametrize(
    "part, ddl",
    [
        ({"type": "string"}, "string"),
        ({"type": "integer"}, "int"),
        ({"type": "integer", "format": "int64"}, "bigint"),
        ({"type": "number"}, "double"),
        ({"type": "boolean"}, "boolean"),
        ({"type": "array"}, "string"),
        ({"type": ["integer", "null"]}, "string"),
        ({}, "string"),
    ],
)
def test_json_types(part, ddl):
    assert _json("x", part) == ddl


@pytest.mark.parametrize(
    "kind, ddl",
    [
        ("int", "int"),
        ("long", "bigint"),
        ("float", "double"),
        ("double", "double"),
        ("boolean", "boolean"),
        ("string", "string"),
        ("bytes", "string"),
        (["null", "string"], "string"),
        (["null", "long"], "bigint"),
        (["int", "null"], "int"),
        ({"type": "enum", "name": "e", "symbols": ["A"]}, "string"),
        ({"type": "long", "logicalType": "timestamp-millis"}, "bigint"),
        ({"type": "array", "items": "int"}, "string"),
    ],
)
def test_avro_types(kind, ddl):
    assert _avro(kind) == ddl


@pytest.mark.parametrize("text", ["not-json", "[]", "{}", '{"properties": {}}', '{"properties": 1}'])
def test_bad_json_schema(text):
    with pytest.raises(SchemaError):
        json_schema(text)


@pytest.mark.parametrize("text", ["{", "{}", '{"type":"record","name":"r"}', '{"type":"string"}'])
def test_bad_avro_schema(text):
    with pytest.raises(SchemaError):
        avro_schema(text)


def test_field_order_is_declaration_order():
    schema = json_schema('{"properties": {"z": {}, "a": {}, "m": {}}}')
    assert [f.name for f in schema.fields] == ["z", "a", "m"]
    assert schema.struct().simpleString() == "struct<z:string,a:string,m:string>"


def test_the_format_picks_the_dialect():
    avro = '{"type":"record","name":"r","fields":[{"name":"a","type":"int"}]}'
    assert declared(avro, "avro").dialect == "AVRO"
    assert declared('{"properties":{"a":{}}}', "STRING").dialect == "JSON"
    with pytest.raises(SchemaError):
        declared(avro, "JSON")
