"""Declared schemas (JSON Schema or Avro record text) as ordered, typed columns."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import types as T

from ..functions.validation import SchemaError

# Declared type -> Spark column type. Everything else is a string.
JSON_TYPES = {
    "integer": "int",
    "number": "double",
    "boolean": "boolean",
    "string": "string",
}
AVRO_TYPES = {
    "int": "int",
    "long": "bigint",
    "double": "double",
    "float": "double",
    "boolean": "boolean",
}


SPARK_TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str  # Spark DDL name
    schema: object  # the declaration this column came from


@dataclass(frozen=True)
class Declared:
    """A parsed schema: its dialect, its document and its top-level columns."""

    dialect: str  # JSON or AVRO
    document: dict
    fields: tuple[Field, ...]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, SPARK_TYPES[f.type]) for f in self.fields])


def _load(text: str, what: str) -> dict:
    try:
        document = json.loads(text)
    except (TypeError, ValueError) as error:
        raise SchemaError(f"{what} is not JSON: {error}") from error
    if not isinstance(document, dict):
        raise SchemaError(f"{what} is not a JSON object")
    return document


def json_schema(text: str) -> Declared:
    document = _load(text, "JSON Schema")
    properties = document.get("properties")
    if not isinstance(properties, dict) or not properties:
        raise SchemaError("a JSON Schema must declare properties, for they are the columns")
    fields = []
    for name, part in properties.items():
        kind = part.get("type") if isinstance(part, dict) else None
        ddl = JSON_TYPES.get(kind.lower(), "string") if isinstance(kind, str) else "string"
        if ddl == "int" and part.get("format") == "int64":
            ddl = "bigint"
        fields.append(Field(name, ddl, part))
    return Declared("JSON", document, tuple(fields))


def avro_branches(schema: object) -> list:
    return schema if isinstance(schema, list) else [schema]


def avro_kind(schema: object) -> str:
    """Type name of an Avro schema node: primitive, complex or a name reference."""
    if isinstance(schema, list):
        return "union"
    if isinstance(schema, dict):
        inner = schema.get("type")
        return avro_kind(inner) if isinstance(inner, (dict, list)) else inner
    return schema


def avro_schema(text: str) -> Declared:
    document = _load(text, "Avro Schema")
    if document.get("type") != "record" or not isinstance(document.get("fields"), list):
        raise SchemaError("an Avro schema must be a record with fields")
    fields = []
    for part in document["fields"]:
        if not isinstance(part, dict) or "name" not in part or "type" not in part:
            raise SchemaError("every Avro field needs a name and a type")
        kinds = [avro_kind(b) for b in avro_branches(part["type"])]
        first = next((k for k in kinds if k != "null"), "null")
        fields.append(Field(part["name"], AVRO_TYPES.get(first, "string"), part["type"]))
    return Declared("AVRO", document, tuple(fields))


def declared(text: str, fmt: str | None) -> Declared:
    """The message format, not the schema's own type label, picks the dialect."""
    return avro_schema(text) if (fmt or "").upper() == "AVRO" else json_schema(text)
