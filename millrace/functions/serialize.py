"""Result rows to message values: JSON, the row's text form, or an Avro record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schema import Declared, avro_branches, avro_kind
from .validation import SchemaError

def _fraction_to(text: Column, digits: Column) -> Column:
    """``text`` of a moment with zeros after its fraction, up to ``digits`` of them."""
    dot = F.instr(text, ".")
    return F.when(dot == 0, text).otherwise(F.rpad(text, dot + digits, "0"))


def _fraction(text: Column) -> Column:
    """The number of digits in the fraction of a moment's text."""
    dot = F.instr(text, ".")
    return F.when(dot == 0, 0).otherwise(F.length(text) - dot)


def _in_threes(text: Column) -> Column:
    return _fraction_to(text, F.when(_fraction(text) <= 3, 3).otherwise(6))


def _local(column: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` and the fraction without the zeros at its end, as a cast gives it."""
    return F.replace(column.cast("string"), F.lit(" "), F.lit("T"))


def _iso(column: Column, kind: T.DataType) -> Column:
    """ISO-8601 text of a temporal column, at its full precision: local times with as many
    fraction digits as needed, instants in UTC with none, three or six."""
    if isinstance(kind, T.TimestampNTZType):
        return _local(column)
    if isinstance(kind, T.TimestampType):
        return F.concat(_in_threes(_local(F.to_utc_timestamp(column, F.current_timezone()))), F.lit("Z"))
    return column.cast("string")


def _holds_temporal(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_temporal(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_temporal(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_temporal(kind.valueType) or _holds_temporal(kind.keyType)
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _shown(column: Column, kind: T.DataType) -> Column:
    """The column with every temporal in it, however deep, as ISO-8601 text."""
    if not _holds_temporal(kind):
        return column
    if isinstance(kind, T.StructType):
        members = [_shown(column.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*members))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _shown(x, kind.elementType))
    if isinstance(kind, T.MapType):
        values = F.transform_values(column, lambda _, v: _shown(v, kind.valueType))
        if not _holds_temporal(kind.keyType):
            return values
        return F.transform_keys(values, lambda k, _: _shown(k, kind.keyType))
    return _iso(column, kind)


def json_value(df: DataFrame) -> Column:
    """An object with every column in order, NULLs included, temporals as ISO-8601 text."""
    members = [_shown(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return F.to_json(F.struct(*members), {"ignoreNullFields": "false"})


def _row_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return _iso(column, kind)
    if isinstance(kind, T.TimestampNTZType):
        # Seconds are left out when zero, else the fraction comes in groups of three.
        text = _in_threes(_local(column))
        return F.when(text.endswith(":00"), F.left(text, F.length(text) - 3)).otherwise(text)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(_shown(column, kind))
    return column.cast("string")


def string_value(df: DataFrame) -> Column:
    """The row's text form, ``+I[v1, v2]``, NULL shown as ``null``."""
    shown = [F.coalesce(_row_text(F.col(f"`{f.name}`"), f.dataType), F.lit("null")) for f in df.schema.fields]
    return F.concat(F.lit("+I["), F.concat_ws(", ", *shown), F.lit("]"))


# Avro type -> Spark type a value must fit without loss.
_AVRO_TARGET = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "enum": T.StringType(),
    "bytes": T.BinaryType(),
    "fixed": T.BinaryType(),
}
_WIDER = {
    "int": ("tinyint", "smallint", "int"),
    "long": ("tinyint", "smallint", "int", "bigint"),
    "float": ("float",),
    "double": ("tinyint", "smallint", "int", "float", "double"),
    "boolean": ("boolean",),
    "bytes": ("binary",),
    "fixed": ("binary",),
}


def _branch(declared: object) -> tuple[object, list[str]]:
    """(the first branch that is not null, the kinds of all branches) of an Avro type."""
    branches = avro_branches(declared)
    kinds = [avro_kind(b) for b in branches]
    chosen = next((b for b, k in zip(branches, kinds) if k != "null"), "null")
    return chosen, kinds


def _avro_type(declared: object) -> T.DataType:
    """The Spark type of an Avro type, for values that are absent."""
    chosen, _ = _branch(declared)
    kind = avro_kind(chosen)
    if kind == "record":
        return T.StructType([T.StructField(f["name"], _avro_type(f["type"])) for f in chosen["fields"]])
    if kind == "array":
        return T.ArrayType(_avro_type(chosen["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), _avro_type(chosen["values"]))
    return _AVRO_TARGET.get(kind, T.StringType())


def _members(fields: list[dict], present: dict[str, tuple[Column, T.DataType]], where: str) -> list[Column]:
    """The columns of a record, matched by name and in its order."""
    out = []
    for part in fields:
        name, declared = part["name"], part["type"]
        if name in present:
            out.append(_aligned(*present[name], declared, f"{where}{name}").alias(name))
            continue
        default = part.get("default")
        if default is None and "null" not in _branch(declared)[1]:
            raise SchemaError(f"result has no column {where + name!r} and the Avro field has no default")
        out.append(F.lit(default).cast(_avro_type(declared)).alias(name))
    return out


def _aligned(column: Column, have: T.DataType, declared: object, name: str) -> Column:
    """A value as its Avro type wants it; raises where it would not fit without loss."""
    chosen, _ = _branch(declared)
    kind = avro_kind(chosen)
    wrong = SchemaError(f"column {name!r} ({have.simpleString()}) does not fit Avro {kind}")
    if kind == "record":
        if not isinstance(have, T.StructType):
            raise wrong
        inner = {f.name: (column.getField(f.name), f.dataType) for f in have.fields}
        return F.when(column.isNotNull(), F.struct(*_members(chosen["fields"], inner, f"{name}.")))
    if kind == "array":
        if not isinstance(have, T.ArrayType):
            raise wrong
        return F.transform(column, lambda x: _aligned(x, have.elementType, chosen["items"], f"{name}[]"))
    if kind == "map":
        if not isinstance(have, T.MapType) or not isinstance(have.keyType, T.StringType):
            raise wrong
        return F.transform_values(column, lambda _, v: _aligned(v, have.valueType, chosen["values"], f"{name}.*"))
    if kind not in _AVRO_TARGET:
        raise SchemaError(f"unsupported Avro type {kind!r} for {name!r}")
    if kind == "long" and isinstance(have, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_millis(column.cast("timestamp"))
    if kind in _WIDER and have.simpleString() not in _WIDER[kind]:
        raise wrong
    return column.cast(_AVRO_TARGET[kind])


def align_avro(df: DataFrame, schema: Declared) -> DataFrame:
    """The columns an Avro record needs, matched by name and in its order, at every depth.

    Temporals become epoch milliseconds, numbers may widen but not narrow, and a field
    that is neither a column, nor nullable, nor defaulted is an error.
    """
    present = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    return df.select(*_members(schema.document["fields"], present, ""))


def avro_value(df: DataFrame, schema: Declared) -> Column:
    """Binary Avro of the aligned row; needs Spark's Avro module on the class path."""
    import json

    from pyspark.sql.avro.functions import to_avro

    return to_avro(F.struct(*[F.col(f"`{c}`") for c in df.columns]), json.dumps(schema.document))


def message_format(fmt: str | None, schema_text: str | None) -> str:
    """JSON, AVRO or STRING; Avro without a schema falls back to STRING."""
    fmt = (fmt or "STRING").upper()
    if fmt == "AVRO":
        return "AVRO" if schema_text else "STRING"
    return "JSON" if fmt == "JSON" else "STRING"
