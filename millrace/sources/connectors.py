"""Where messages come from and go to: Kafka, files, JDBC tables, catalog tables."""

from __future__ import annotations

import logging
import re
from dataclasses import replace

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import serialize
from ..plans.spec import Auth, Files, Kafka, Source, SpecError, Target, from_environment
from ..streaming import commit_log
from .schema import avro_schema

log = logging.getLogger(__name__)

# SASL protocols, and the login module of each mechanism.
SASL_TYPES = ("SASL_SSL", "SASL_PLAINTEXT")
_SCRAM = "org.apache.kafka.common.security.scram.ScramLoginModule"
LOGIN_MODULES = {
    "PLAIN": "org.apache.kafka.common.security.plain.PlainLoginModule",
    "SCRAM-SHA-256": _SCRAM,
    "SCRAM-SHA-512": _SCRAM,
}

# Start positions by either of their two spellings.
START_POSITIONS = {
    "earliest-offset": "earliest",
    "latest-offset": "latest",
    "group-offsets": "group",
    "timestamp": "timestamp",
    "EARLIEST": "earliest",
    "LATEST": "latest",
    "GROUP_OFFSETS": "group",
    "TIMESTAMP": "timestamp",
}

# Producer settings of the audit sink.
AUDIT_PRODUCER = {
    "kafka.acks": "1",
    "kafka.retries": "3",
    "kafka.linger.ms": "50",
    "kafka.compression.type": "lz4",
}


def _login(auth: Auth) -> str:
    """The entry a client logs in with: the one given, or one of the mechanism's module."""
    if given := from_environment(auth.jaas_config):
        return given
    module = LOGIN_MODULES.get((auth.mechanism or "PLAIN").upper())
    if module is None:
        raise SpecError(f"mechanism {auth.mechanism!r} is none of {', '.join(LOGIN_MODULES)}: give jaasConfig")
    words = [module, "required"]
    for name in ("username", "password"):
        value = from_environment(getattr(auth, name))
        if value is None:
            raise SpecError(f"SASL needs a {name}, or jaasConfig")
        escaped = value.replace("\\", "\\\\").replace('"', '\\"')
        words.append(f'{name}="{escaped}"')
    return " ".join(words) + ";"


def security_options(auth: Auth | None) -> dict[str, str]:
    """Client settings of a SASL connection; without a truststore the JVM's own applies."""
    protocol = (auth.type or "").upper() if auth else ""
    if protocol not in SASL_TYPES:
        return {}
    settings = {
        "security.protocol": protocol,
        "sasl.mechanism": (auth.mechanism or "PLAIN").upper(),
        "sasl.jaas.config": _login(auth),
    }
    if protocol == "SASL_SSL" and auth.truststore_location:
        settings["ssl.truststore.location"] = auth.truststore_location
        settings["ssl.truststore.password"] = from_environment(auth.truststore_password)
    return {f"kafka.{name}": value for name, value in settings.items() if value is not None}


def common_options(kafka: Kafka) -> dict[str, str]:
    if not kafka.bootstrap_servers or not kafka.topic:
        raise SpecError("a Kafka topic and its bootstrap servers are needed")
    passed = {f"kafka.{k}": str(v) for k, v in kafka.properties.items()}
    return {
        **passed,
        "kafka.bootstrap.servers": kafka.bootstrap_servers,
        **security_options(kafka.authentication),
        **{k: str(v) for k, v in kafka.options.items()},
    }


def start_options(kafka: Kafka, streaming: bool) -> dict[str, str]:
    """Where a first start begins; a restarted stream goes on from its checkpoint.

    Group offsets are that checkpoint: on a first start there are none, so it is earliest.
    """
    if kafka.startup_mode is not None:
        position = START_POSITIONS.get(kafka.startup_mode.lower(), "earliest")
    else:
        position = START_POSITIONS.get((kafka.starting_offset or "").upper(), "earliest")
    if position == "timestamp":
        if kafka.starting_offset_timestamp is None:
            log.warning("start by timestamp without a timestamp: starting from the earliest offset")
            return {"startingOffsets": "earliest"}
        return {
            "startingTimestamp": str(kafka.starting_offset_timestamp),
            "startingOffsetsByTimestampStrategy": "latest",
        }
    if position == "latest" and streaming:
        return {"startingOffsets": "latest"}
    if position == "latest":
        raise SpecError("a bounded read cannot start at the latest offset")
    return {"startingOffsets": "earliest"}


def read_options(kafka: Kafka, streaming: bool, parallelism: int | None = None) -> dict[str, str]:
    options = {"subscribe": kafka.topic, **common_options(kafka), **start_options(kafka, streaming)}
    if kafka.group_id:
        options["kafka.group.id"] = kafka.group_id
    if parallelism and parallelism > 1 and "minPartitions" not in options:
        # More tasks than topic partitions, so that one long partition is read by several.
        options["minPartitions"] = str(parallelism)
    return options


def _read_files(spark: SparkSession, files: Files, streaming: bool) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).options(**files.options)
    if files.format in ("text", "json"):
        return reader.text(files.path)
    if streaming:
        reader = reader.schema(spark.read.options(**files.options).format(files.format).load(files.path).schema)
    return reader.format(files.format).load(files.path)


def read(spark: SparkSession, source: Source, streaming: bool, parallelism: int | None = None) -> DataFrame:
    """Raw rows: ``value`` with transport metadata, or the typed rows of a columnar file."""
    if source.files is not None:
        return _read_files(spark, source.files, streaming)
    reader = spark.readStream if streaming else spark.read
    try:
        frame = reader.format("kafka").options(**read_options(source.kafka, streaming, parallelism)).load()
    except Exception as error:
        if "Failed to find data source" in str(error) or "DATA_SOURCE_NOT_FOUND" in str(error):
            raise SpecError("Kafka needs the spark-sql-kafka-0-10 package on the class path") from error
        raise
    return frame.select(
        F.col("value").cast("string").alias("value"), "topic", "partition", "offset", "timestamp"
    )


# -- targets ------------------------------------------------------------------------


def _message_column(df: DataFrame, target: Target) -> tuple[DataFrame, object]:
    text = target.schema.definition if target.schema else None
    wanted = target.kafka.format if target.kafka else "JSON"
    fmt = serialize.message_format(wanted, text)
    if fmt == "JSON":
        return df, serialize.json_value(df)
    if fmt == "AVRO":
        schema = avro_schema(text)
        aligned = serialize.align_avro(df, schema)
        return aligned, serialize.avro_value(aligned, schema)
    if (wanted or "").upper() == "AVRO":
        log.warning("AVRO target without a schema: writing the row's text form")
    return df, serialize.string_value(df)


def messages(df: DataFrame, target: Target) -> DataFrame:
    """Result rows as one ``value`` column in the target's message format."""
    frame, value = _message_column(df, target)
    return frame.select(value.alias("value"))


def jdbc_options(target: Target) -> dict[str, str]:
    if not target.connection or not target.table:
        raise SpecError("a JDBC target needs a connection and a table")
    options = {"url": target.connection, "dbtable": target.table}
    if target.username is not None:
        options["user"] = from_environment(target.username)
    if target.password is not None:
        options["password"] = from_environment(target.password)
    return options


def outgoing(df: DataFrame, target: Target) -> DataFrame:
    """The rows as the target stores them: messages for Kafka and text files, else columns."""
    kind = target.type.upper()
    if kind == "KAFKA" or (kind == "FILE" and target.file_format == "text"):
        return messages(df, target)
    return df


def _where(writer, target: Target):
    """Format and options shared by a batch and a stream writer."""
    kind = target.type.upper()
    writer = writer.options(**target.options)
    if kind == "KAFKA":
        return writer.format("kafka").options(topic=target.kafka.topic, **common_options(target.kafka))
    if kind == "FILE":
        if not target.path:
            raise SpecError("a FILE target needs a path")
        writer = writer.format(target.file_format)
        if target.file_format in ("json", "csv"):
            # Columns that are NULL stay in the record.
            writer = writer.option("ignoreNullFields", "false")
        if target.partition_by:
            writer = writer.partitionBy(*target.partition_by)
        return writer.option("path", target.path)
    if kind == "JDBC":
        return writer.format("jdbc").options(**jdbc_options(target))
    raise SpecError(f"target type {kind} is written through its catalog table")


def write_outgoing(rows: DataFrame, target: Target) -> None:
    """Writes bounded rows that already have the form the target stores."""
    if target.type.upper() == "ICEBERG":
        if not target.table:
            raise SpecError("an ICEBERG target needs a catalog table")
        rows.writeTo(target.table).append()
        return
    writer: DataFrameWriter = _where(rows.write, target)
    if target.type.upper() != "KAFKA":
        writer = writer.mode(target.mode)
    writer.save()


def write(df: DataFrame, target: Target) -> None:
    """Writes one bounded result."""
    write_outgoing(outgoing(df, target), target)


def _stored(spark: SparkSession, target: Target, paths: list[str]) -> DataFrame:
    """Rows of files as a FILE target stores them, with as few columns as can be counted."""
    if target.file_format in ("text", "json"):
        return spark.read.text(paths)
    if target.file_format == "csv":
        return spark.read.schema("first string").csv(paths, multiLine=True)
    # The number of rows is in the footers: no column is read.
    return spark.read.format(target.file_format).load(paths)


def files_of(spark: SparkSession, target: Target) -> set[str]:
    """The files that a FILE target holds."""
    if not target.path:
        raise SpecError("a FILE target needs a path")
    return set(_stored(spark, target, [target.path]).inputFiles()) if _has_rows(spark, target) else set()


def _has_rows(spark: SparkSession, target: Target) -> bool:
    return any(not n.startswith(("_", ".")) for n in commit_log.names(spark, target.path))


def rows_in(spark: SparkSession, target: Target, files: list[str]) -> int:
    """Rows in some files of a FILE target, as ``files_of`` names them."""
    return _stored(spark, target, [commit_log.decoded(spark, f) for f in files]).count() if files else 0


def rows_by_file(spark: SparkSession, target: Target, files: list[str], name: str) -> DataFrame:
    """(file, ``name``): rows in each of ``files``, without folders; of those that are still there."""
    there = [f for f in files if commit_log.exists(spark, f)]
    if not there:
        return spark.createDataFrame([], f"file string, `{name}` bigint")
    return _stored(spark, target, there).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias(name))


def held(spark: SparkSession, target: Target, run_id: str | None = None, batch_id: int | None = None) -> int:
    """Rows that the target holds now, asked of the target itself; of a target that notes run and
    batch, those of the run, or of one of its batches."""
    kind = target.type.upper()
    if kind == "FILE":
        if run_id is not None and target.batch_columns:
            target = replace(target, path=batch_folder(target, run_id, batch_id))
        return _stored(spark, target, [target.path]).count() if _has_rows(spark, target) else 0
    if kind == "JDBC":
        rows = spark.read.format("jdbc").options(**jdbc_options(target)).load()
        if run_id and target.batch_columns:
            rows = rows.where(F.col("run_id") == run_id)
            rows = rows if batch_id is None else rows.where(F.col("batch_id") == batch_id)
        return rows.count()
    if kind == "ICEBERG":
        return spark.table(target.table).count()
    raise SpecError(f"a {kind} target does not tell what it holds")


def batch_folder(target: Target, run_id: str, batch_id: int | None = None) -> str:
    """Where a FILE target with batch columns has a run's rows: in folders that its readers see as columns."""
    run = f"{target.path}/run_id={run_id}"
    return run if batch_id is None else f"{run}/batch_id={batch_id}"


def batch_columns(rows: DataFrame, run_id: str, batch_id: int) -> DataFrame:
    return rows.withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(batch_id).cast("bigint")})


def forget_batch(target: Target) -> str:
    """The statement that takes a batch out of a table before it is written again."""
    if not re.fullmatch(r"[\w.\"`\[\]]+", target.table or ""):
        raise SpecError(f"{target.table!r} is no table name")
    return f"DELETE FROM {target.table} WHERE run_id = ? AND batch_id = ?"


def _execute(spark: SparkSession, target: Target, statement: str, *values) -> None:
    """One statement over the driver's JDBC connection."""
    options = jdbc_options(target)
    properties = spark._jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in options:
            properties.setProperty(name, options[name])
    connection = spark._jvm.java.sql.DriverManager.getConnection(options["url"], properties)
    try:
        prepared = connection.prepareStatement(statement)
        for place, value in enumerate(values, 1):
            prepared.setObject(place, value)
        prepared.executeUpdate()
    finally:
        connection.close()


def message_stream(rows: DataFrame, target: Target, run_id: str | None = None) -> DataStreamWriter:
    """A stream writer for rows that already have the form the target stores.

    A table with ``batch_columns`` notes run and batch of every row, and a batch that is
    repeated replaces itself there. Any other table takes a repeated batch again.
    """
    kind = target.type.upper()
    if kind == "ICEBERG":
        return rows.writeStream.format("iceberg").option("path", target.table)
    if kind == "JDBC":
        return rows.writeStream.foreachBatch(lambda batch, number: write_batch(batch, target, run_id, number))
    return _where(rows.writeStream, target)


def write_batch(rows: DataFrame, target: Target, run_id: str | None, batch_id: int, write=None) -> None:
    """A micro-batch into a target; ``write`` puts the rows there."""
    write = write or write_outgoing
    if target.batch_columns:
        if run_id is None:
            raise SpecError("a target with batch columns is written by a run")
        if target.type.upper() == "FILE":
            write(rows, replace(target, path=batch_folder(target, run_id, batch_id), mode="overwrite", batch_columns=False))
            return
        _execute(rows.sparkSession, target, forget_batch(target), run_id, batch_id)
        rows = batch_columns(rows, run_id, batch_id)
    write(rows, target)


def stream_writer(df: DataFrame, target: Target, run_id: str | None = None) -> DataStreamWriter:
    return message_stream(outgoing(df, target), target, run_id)
