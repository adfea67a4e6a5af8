"""The job specification: sources, one SQL query, one target, and what goes around them.

A specification is loaded from a JSON-shaped dict, in camelCase or snake_case, or from
the flat submit form, and dumps back without loss.
"""

from __future__ import annotations

import dataclasses
import os
import re
import types
import typing
from dataclasses import dataclass, field

from ..streaming.event_time import DEFAULT_OUT_OF_ORDERNESS_MS

# Fixed values.
REDACTED = "***REDACTED***"
SECRETS = ("password", "truststore_password", "jaas_config")
DEFAULT_RESULT_TABLE = "result_table"
DEFAULT_CHECKPOINT_INTERVAL_MS = 60_000
TARGET_TYPES = ("KAFKA", "JDBC", "ICEBERG", "FILE")


class SpecError(ValueError):
    """A job specification is incomplete or malformed."""


@dataclass(frozen=True)
class Auth:
    type: str = "NONE"  # NONE, SASL_SSL, SASL_PLAINTEXT
    mechanism: str | None = None  # PLAIN, SCRAM-SHA-256
    username: str | None = None
    password: str | None = None
    protocol: str | None = None
    jaas_config: str | None = None
    truststore_location: str | None = None
    truststore_password: str | None = None


@dataclass(frozen=True)
class Kafka:
    topic: str | None = None
    bootstrap_servers: str | None = None
    group_id: str | None = None
    starting_offset: str | None = None  # EARLIEST, LATEST, GROUP_OFFSETS, TIMESTAMP
    starting_offset_timestamp: int | None = None
    startup_mode: str | None = None  # earliest-offset, latest-offset, group-offsets, timestamp
    format: str | None = None  # STRING, JSON, AVRO
    authentication: Auth | None = None
    properties: dict[str, str] = field(default_factory=dict)  # of the Kafka client
    options: dict[str, str] = field(default_factory=dict)  # of Spark's reader or writer


@dataclass(frozen=True)
class Schema:
    definition: str | None = None
    type: str | None = None  # a label; the message format picks the dialect
    registry_url: str | None = None
    subject: str | None = None

    @property
    def has_definition(self) -> bool:
        return bool(self.definition)

    @property
    def uses_registry(self) -> bool:
        return (self.type or "").upper() == "REGISTRY" and bool(self.registry_url)


@dataclass(frozen=True)
class Watermark:
    strategy: str = "NONE"  # NONE, BOUNDED
    mode: str | None = None  # PROCESS_TIME, EXISTING
    timestamp_column: str | None = None
    max_out_of_orderness: int = DEFAULT_OUT_OF_ORDERNESS_MS
    timestamp_format: str | None = None

    def is_mode(self, mode: str) -> bool:
        return (self.strategy or "").upper() == "BOUNDED" and (self.mode or "").upper() == mode


@dataclass(frozen=True)
class Files:
    path: str
    format: str = "text"  # text and json: one message per line; parquet, orc: typed rows
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Source:
    table_name: str | None = None
    alias: str | None = None
    kafka: Kafka | None = None
    files: Files | None = None
    schema: Schema | None = None
    watermark: Watermark = field(default_factory=Watermark)

    @property
    def format(self) -> str | None:
        return self.kafka.format if self.kafka else None

    @property
    def topic(self) -> str:
        """What audit stages and dead letters call this source."""
        return (self.kafka and self.kafka.topic) or self.table_name


@dataclass(frozen=True)
class Transformation:
    type: str | None = None  # INLINE, FILE
    sql_content: str | None = None
    sql_file_path: str | None = None
    result_table_name: str = DEFAULT_RESULT_TABLE


@dataclass(frozen=True)
class Target:
    type: str = "KAFKA"
    kafka: Kafka | None = None
    schema: Schema | None = None
    path: str | None = None  # FILE
    file_format: str = "parquet"  # FILE: parquet, orc, json, csv, or text for serialized messages
    connection: str | None = None  # JDBC url
    table: str | None = None  # JDBC table or catalog table
    username: str | None = None
    password: str | None = None
    mode: str = "append"
    partition_by: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)  # of Spark's writer
    batch_columns: bool = False  # JDBC, FILE: rows lie under run_id and batch_id, and a repeated batch replaces itself

    @property
    def topic(self) -> str:
        return (self.kafka and self.kafka.topic) or self.table or self.path or "unknown"


@dataclass(frozen=True)
class Engine:
    parallelism: int | None = None
    checkpoint_dir: str | None = None
    checkpoint_interval: int = DEFAULT_CHECKPOINT_INTERVAL_MS
    max_concurrent_checkpoints: int | None = None


@dataclass(frozen=True)
class Dlq:
    enabled: bool = False
    topic: str | None = None
    bootstrap_servers: str | None = None
    path: str | None = None  # a folder instead of a topic


@dataclass(frozen=True)
class Audit:
    enabled: bool = True
    sink_type: str | None = "LOG"  # LOG, KAFKA, JDBC, FILE
    connection: str | None = None
    destination: str = "audit-events"
    username: str | None = None
    password: str | None = None
    kafka_auth: Auth | None = None
    tags: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Reconciliation:
    enabled: bool = True
    sink_type: str | None = "LOG"
    connection: str | None = None
    destination: str = "reconciliation-reports"
    username: str | None = None
    password: str | None = None
    kafka_auth: Auth | None = None
    window: str = "1h"
    tolerance_percent: float = 0.0
    business_key_fields: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Job:
    job_name: str
    sources: list[Source]
    transformation: Transformation
    target: Target
    engine: Engine = field(default_factory=Engine)
    dlq: Dlq = field(default_factory=Dlq)
    audit: Audit | None = None
    reconciliation: Reconciliation | None = None


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.title() for part in rest)


def _build(kind, value, where: str):
    """``value`` as the annotated type: nested specification, list of them, or itself."""
    if value is None:
        return None
    origin = typing.get_origin(kind)
    if origin in (typing.Union, types.UnionType):
        return _build(next(a for a in typing.get_args(kind) if a is not type(None)), value, where)
    if origin is list:
        return [_build(typing.get_args(kind)[0], v, f"{where}[{i}]") for i, v in enumerate(value)]
    if kind is Schema and isinstance(value, str):
        return Schema(definition=value)
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise SpecError(f"{where}: an object is needed")
        hints = typing.get_type_hints(kind)
        given = {_snake(k): v for k, v in value.items()}
        unknown = sorted(set(given) - set(hints))
        if unknown:
            raise SpecError(f"{where}: unknown field {unknown[0]!r}")
        built = {k: _build(hints[k], v, f"{where}.{k}") for k, v in given.items() if v is not None}
        try:
            return kind(**built)
        except TypeError as error:
            raise SpecError(f"{where}: {error}") from error
    if kind in (int, float) and not isinstance(value, bool):
        return kind(value)
    return value


def _named(job: Job) -> Job:
    """Defaults that depend on position, and the rules every job must meet."""
    if not job.sources:
        raise SpecError("a job needs a source")
    if job.target.type.upper() not in TARGET_TYPES:
        raise SpecError(f"target type {job.target.type!r} is not one of {', '.join(TARGET_TYPES)}")
    sources = [
        s if s.table_name else dataclasses.replace(s, table_name=f"source_table_{i}")
        for i, s in enumerate(job.sources)
    ]
    views = [v for s in sources for v in {s.table_name, s.alias} - {None, ""}]
    repeated = {v for v in views if views.count(v) > 1}
    if repeated:
        raise SpecError(f"view name used twice: {sorted(repeated)[0]}")
    for source in sources:
        if (source.kafka is None) == (source.files is None):
            raise SpecError(f"source {source.table_name}: give either kafka or files")
    return dataclasses.replace(job, sources=sources)


def load(data: dict) -> Job:
    return _named(_build(Job, data, "job"))


def dump(job: Job, redact: bool = True) -> dict:
    """A camelCase dict that ``load`` reads back; secrets are replaced unless told otherwise."""

    def out(value, name=""):
        if dataclasses.is_dataclass(value):
            return {
                _camel(f.name): out(getattr(value, f.name), f.name)
                for f in dataclasses.fields(value)
                if getattr(value, f.name) is not None
            }
        if isinstance(value, list):
            return [out(v) for v in value]
        if isinstance(value, dict):
            return dict(value)
        return REDACTED if redact and name in SECRETS and value is not None else value

    return out(job)


# Fields of the flat submit form and where each belongs.
_FORM_AUTH = {
    "AuthType": "type",
    "Username": "username",
    "Password": "password",
    "Mechanism": "mechanism",
    "TruststoreLocation": "truststoreLocation",
    "TruststorePassword": "truststorePassword",
    "JaasConfig": "jaasConfig",
}
_FORM_KAFKA = {
    "Topic": "topic",
    "BootstrapServers": "bootstrapServers",
    "GroupId": "groupId",
    "StartupMode": "startupMode",
    "StartingOffset": "startingOffset",
    "StartingOffsetTimestamp": "startingOffsetTimestamp",
    "Format": "format",
}
_FORM_SCHEMA = {
    "Schema": "definition",
    "SchemaType": "type",
    "SchemaRegistryUrl": "registryUrl",
    "SchemaSubject": "subject",
}


def _section(form: dict, prefix: str, layout: dict[str, str]) -> dict:
    picked = {to: form.get(prefix + name) for name, to in layout.items()}
    return {k: v for k, v in picked.items() if v not in (None, "")}


def _form_side(form: dict, prefix: str) -> dict:
    kafka = _section(form, prefix, _FORM_KAFKA)
    auth = _section(form, prefix, _FORM_AUTH)
    if auth.get("type", "NONE") != "NONE":
        kafka["authentication"] = auth
    schema = _section(form, prefix, _FORM_SCHEMA)
    return {"kafka": kafka, **({"schema": schema} if schema else {})}


# Units of a window label and their milliseconds; what fits none is in whole seconds.
WINDOW_UNITS = (("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1_000))


def interval_label(interval_ms: int) -> str:
    """Window label of a checkpoint interval; ``reconcile.window_label`` is its column form."""
    if interval_ms <= 0:
        return "n/a"
    return next(f"{interval_ms // ms}{unit}" for unit, ms in WINDOW_UNITS if interval_ms % ms == 0 or unit == "s")


def from_form(form: dict, audit: dict | None = None, reconciliation: dict | None = None) -> Job:
    """A job from the flat submit form; audit settings come from the caller, as they are shared."""
    sources = []
    for part in form.get("sources") or []:
        side = _form_side(part, "source")
        side["tableName"] = part.get("sourceTableName") or None
        side["alias"] = part.get("sourceAlias") or None
        if part.get("enableWatermark"):
            side["watermark"] = {
                "strategy": "BOUNDED",
                "mode": part.get("watermarkMode"),
                "timestampColumn": part.get("watermarkColumn"),
                "maxOutOfOrderness": part.get("watermarkMaxOutOfOrderness"),
            }
        sources.append(side)
    interval = form.get("checkpointInterval") or DEFAULT_CHECKPOINT_INTERVAL_MS
    return load(
        {
            "jobName": form.get("jobName"),
            "sources": sources,
            "transformation": {
                "type": form.get("transformationType"),
                "sqlContent": form.get("sqlQuery"),
                "sqlFilePath": form.get("sqlFilePath"),
                "resultTableName": form.get("resultTableName") or None,
            },
            "target": {"type": form.get("targetType") or None, **_form_side(form, "target")},
            "engine": {
                "parallelism": form.get("parallelism"),
                "checkpointDir": form.get("checkpointDir") or None,
                "checkpointInterval": interval,
            },
            "audit": audit,
            "reconciliation": reconciliation and {**reconciliation, "window": interval_label(interval)},
        }
    )


def from_environment(value: str | None) -> str | None:
    """``${NAME}`` references replaced at use, so that secrets stay out of stored specifications."""
    if value is None:
        return None

    def lookup(match: re.Match) -> str:
        if match[1] not in os.environ:
            raise SpecError(f"environment variable {match[1]} is not set")
        return os.environ[match[1]]

    return re.sub(r"\$\{(\w+)\}", lookup, value)
