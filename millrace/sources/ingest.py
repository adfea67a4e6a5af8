"""Raw messages to typed rows, with every record either accepted or rejected.

``classify`` parses each message once and yields four columns:

* ``raw``           the message and its transport metadata, untouched
* ``row``           struct of the declared columns
* ``error_type``    NULL for accepted rows, else one of ``ERROR_TYPES``
* ``error_message`` the first reason

``accepted``, ``rejected`` and the counters are then plain filters on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validation import Compiler, Node, SchemaError, _any, _sure, field_of, first_message
from ..streaming.event_time import EventTime, to_timestamp
from .schema import Declared, avro_kind

# The reject classes carried by a dead-letter record.
MALFORMED = "MALFORMED"
SCHEMA_VALIDATION = "SCHEMA_VALIDATION"
TYPE_CONVERSION = "TYPE_CONVERSION"
SERIALIZATION = "SERIALIZATION"
ERROR_TYPES = (SCHEMA_VALIDATION, TYPE_CONVERSION, MALFORMED, SERIALIZATION)

_INT_RANGE = (-(2**31), 2**31 - 1)


def raw_table(df: DataFrame, value: str = "value") -> DataFrame:
    """No declared schema: one string column, nothing is checked."""
    return df.select(F.col(value).cast("string").alias("f0"))


def _stored_as(ddl: str) -> str:
    """The type a member is fetched as: INT goes through BIGINT to see values out of range."""
    return "bigint" if ddl == "int" else ddl


def _fits(value: Column, ddl: str) -> Column:
    return F.when(value.between(*_INT_RANGE), value.cast("int")) if ddl == "int" else value


# -- Avro in its JSON encoding ------------------------------------------------------


# Avro types of one JSON type, and that type.
AVRO_SIMPLE = {
    "null": "null",
    "boolean": "boolean",
    "int": "integer",
    "long": "integer",
    "float": "number",
    "double": "number",
    "string": "string",
    "bytes": "string",
    "fixed": "string",
}


def _avro_name(schema: object) -> str:
    if isinstance(schema, dict) and schema.get("type") in ("record", "enum", "fixed"):
        name, space = schema["name"], schema.get("namespace")
        return f"{space}.{name}" if space and "." not in name else name
    return avro_kind(schema)


def _sole_member(branch: object, node: Node) -> Column:
    """True when the value is an object whose one member is named as the union branch."""
    name = _avro_name(branch)
    if avro_kind(branch) in AVRO_SIMPLE and name.isidentifier():
        # The type's text tells, without reading the members: OBJECT<name: TYPE>.
        return node.type.startswith(f"OBJECT<{name}: ") & ~node.type.contains(", ")
    keys = F.map_keys(node.get("map<string,variant>"))
    return (F.size(keys) == 1) & F.array_contains(keys, name)


def _avro_bad(schema: object, node: Node) -> Column:
    """True when the value cannot be decoded as ``schema``; absence is an error."""
    kind = avro_kind(schema)
    if kind == "union":
        named = [b for b in schema if avro_kind(b) != "null"]
        fits = [_sure(_sole_member(b, node)) & ~_avro_bad(b, node.child(_avro_name(b))) for b in named]
        if len(named) < len(schema):
            fits.append(_sure(node.is_a("null")))
        return ~_any(fits)
    if isinstance(schema, dict) and isinstance(schema.get("type"), (dict, list)):
        return _avro_bad(schema["type"], node)
    if kind == "record":
        parts = [_avro_bad(f["type"], node.child(f["name"])) for f in schema["fields"]]
        return ~_sure(node.is_a("object")) | _any(parts)
    if kind == "array":
        bad = F.exists(node.get("array<variant>"), lambda e: _avro_bad(schema["items"], Node.of(e)))
        return ~_sure(node.is_a("array")) | _sure(bad)
    if kind == "map":
        values = F.map_values(node.get("map<string,variant>"))
        bad = F.exists(values, lambda e: _avro_bad(schema["values"], Node.of(e)))
        return ~_sure(node.is_a("object")) | _sure(bad)
    if kind == "enum":
        return ~_sure(node.is_a("string") & node.get("string").isin(list(schema["symbols"])))
    if kind not in AVRO_SIMPLE:
        raise SchemaError(f"unsupported Avro type {kind!r}")
    return ~_sure(node.is_a(AVRO_SIMPLE[kind]))


def _avro_value(schema: object, node: Node) -> Node:
    """The value to store: the one branch a union carries, else the node itself."""
    if avro_kind(schema) != "union":
        return node
    branches = [field_of(node.value, _avro_name(b)) for b in schema if avro_kind(b) != "null"]
    return Node.of(F.coalesce(*branches)) if branches else node


# -- the classifier -----------------------------------------------------------------


def classify(
    df: DataFrame,
    schema: Declared,
    value: str = "value",
    event_time: EventTime | None = None,
) -> DataFrame:
    fields = schema.fields
    # One projection per step: Catalyst keeps a step apart when the next uses a costly
    # column more than once, so the text is parsed once and each member fetched once.
    # Conversions are a step of their own as well, so that checks reuse them.
    parsed = df.select(
        F.struct(*[F.col(c) for c in df.columns]).alias("raw"),
        F.col(value).cast("string").alias("_text"),
        F.try_parse_json(F.col(value).cast("string")).alias("_doc"),
    )
    members = parsed.select(
        "*", *[field_of(F.col("_doc"), f.name).alias(f"_v{i}") for i, f in enumerate(fields)]
    )
    typed = members.select(
        "*", *[F.schema_of_variant(f"_v{i}").alias(f"_t{i}") for i in range(len(fields))]
    )
    avro = schema.dialect == "AVRO"
    plain = {f.name: Node(F.col(f"_v{i}"), F.col(f"_t{i}")) for i, f in enumerate(fields)}
    stored = {f.name: _avro_value(f.schema, plain[f.name]) if avro else plain[f.name] for f in fields}
    typed = typed.select(
        "*", *[stored[f.name].get(_stored_as(f.type)).alias(f"_c{i}") for i, f in enumerate(fields)]
    )
    nodes = {
        f.name: Node(plain[f.name].value, plain[f.name].type, None if avro else (_stored_as(f.type), F.col(f"_c{i}")))
        for i, f in enumerate(fields)
    }

    # A parsed text is an object exactly when its first visible character is a brace.
    is_object = F.ltrim(F.col("_text"), F.lit(" \t\r\n")).startswith("{")
    malformed = [(F.col("_doc").isNull(), "not JSON")]
    invalid = []
    if avro:
        malformed.append((~is_object, "not a record"))
        malformed += [(_avro_bad(f.schema, nodes[f.name]), f"$.{f.name}: not decodable") for f in fields]
    else:
        invalid = [(~is_object, "$: expected type object"), *_json_checks(schema, nodes)]

    values = {f.name: _fits(F.col(f"_c{i}"), f.type) for i, f in enumerate(fields)}
    lost = [
        (
            _sure(stored[f.name].present & (stored[f.name].type != "VOID") & values[f.name].isNull()),
            f"$.{f.name}: cannot be stored as {f.type}",
        )
        for f in fields
        if f.type != "string"
    ]
    if event_time is not None:
        if event_time.column not in values:
            raise SchemaError(f"event time column {event_time.column!r} is not declared")
        ddl = next(f.type for f in fields if f.name == event_time.column)
        values[event_time.column] = to_timestamp(values[event_time.column], ddl, event_time.pattern)
        lost.append((values[event_time.column].isNull(), f"$.{event_time.column}: no event time"))

    judged = typed.select(
        "raw",
        F.struct(*[values[f.name].alias(f.name) for f in fields]).alias("row"),
        first_message(malformed).alias("_malformed"),
        first_message(invalid).alias("_invalid"),
        first_message(lost).alias("_lost"),
    ).select(
        "raw",
        "row",
        F.when(F.col("_malformed").isNotNull(), MALFORMED)
        .when(F.col("_invalid").isNotNull(), SCHEMA_VALIDATION)
        .when(F.col("_lost").isNotNull(), TYPE_CONVERSION)
        .alias("error_type"),
        F.coalesce("_malformed", "_invalid", "_lost").alias("error_message"),
    )
    # Filters on error_type must not be pushed below the parse: Catalyst would copy the
    # whole expression tree into the filter and parse the text again for every check
    # (measured 6x slower). A one-element generator stops that and stays in codegen. The
    # message itself stays outside, so that it is dropped where only rows are wanted.
    return judged.select("raw", F.inline(F.array(F.struct("row", "error_type", "error_message"))))


def _json_checks(schema: Declared, nodes: dict[str, Node]) -> list[tuple[Column, str]]:
    """Checks of the root schema, reading top-level members from their own columns."""
    compiler = Compiler(schema.document)
    root = Node(F.col("_doc"), F.lit("OBJECT"))
    out: list[tuple[Column, str]] = []
    for name in schema.document.get("required", []):
        absent = nodes[name].value.isNull() if name in nodes else field_of(root.value, name).isNull()
        out.append((absent, f"$.{name}: required"))
    for name, part in schema.document["properties"].items():
        out += compiler.checks(part, nodes[name], f"$.{name}")
    rest = {k: v for k, v in schema.document.items() if k not in ("properties", "required", "type")}
    if "additionalProperties" in rest:
        extra = compiler._kw_additionalProperties(rest.pop("additionalProperties"), root, "$", (), schema.document)
        out += [(_sure(bad), f"$: {message}") for bad, message in extra]
    kinds = schema.document.get("type", "object")
    if "object" not in ([kinds] if isinstance(kinds, str) else kinds):
        raise SchemaError("the root of a declared schema must be an object")
    return out + compiler.checks(rest, root)


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("error_type").isNull()).select("row.*")


def rejected(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("error_type").isNotNull()).select("raw", "error_type", "error_message")


def dead_letters(
    classified: DataFrame, topic: str, job_name: str, value: str = "value", at: Column | None = None
) -> DataFrame:
    """Rejected rows as JSON envelopes in a single ``value`` column."""
    moment = F.date_format(
        F.to_utc_timestamp(at if at is not None else F.current_timestamp(), F.current_timezone()),
        "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    )
    return rejected(classified).select(
        F.to_json(
            F.struct(
                F.col(f"raw.{value}").cast("string").alias("originalPayload"),
                F.col("error_type").alias("errorType"),
                F.col("error_message").alias("errorMessage"),
                F.lit(topic).alias("sourcetopic"),
                F.lit(job_name).alias("jobName"),
                moment.alias("timestamp"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("value")
    )


def intake_metrics() -> list[Column]:
    """Aggregates that count the source boundary: all rows, and the rejected ones."""
    return [
        F.count(F.lit(1)).alias("read"),
        F.count_if(F.col("error_type").isNotNull()).alias("rejected"),
    ]


def conformance(classified: DataFrame, schema: Declared) -> DataFrame:
    """Rows by outcome, and for each declared field how often it is NULL, in one aggregate."""
    per_outcome = classified.groupBy(
        F.coalesce("error_type", F.lit("ACCEPTED")).alias("outcome")
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("row").getField(f.name).isNull()).alias(f.name) for f in schema.fields],
    )
    pairs = F.array(
        *[F.struct(F.lit(f.name).alias("field"), F.col(f.name).alias("nulls")) for f in schema.fields]
    )
    return per_outcome.select("outcome", "rows", F.inline(pairs))
