"""Where audit events and reconciliation reports go. A failing sink never stops a job."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.connectors import AUDIT_PRODUCER, security_options
from .spec import Audit, Reconciliation, from_environment

log = logging.getLogger(__name__)

SINK_TYPES = ("LOG", "KAFKA", "JDBC", "FILE")


def sink_type(config: Audit | Reconciliation | None) -> str:
    """The sink a configuration leads to; unknown types and missing connections mean LOG."""
    kind = ((config.sink_type if config else None) or "LOG").upper()
    if kind not in SINK_TYPES:
        return "LOG"
    if kind in ("KAFKA", "JDBC") and not config.connection:
        log.warning("%s sink without a connection: using LOG", kind)
        return "LOG"
    return kind


def jdbc_options(config: Audit | Reconciliation) -> dict[str, str]:
    options = {"url": config.connection, "dbtable": config.destination}
    if config.username is not None:
        options["user"] = from_environment(config.username)
    if config.password is not None:
        options["password"] = from_environment(config.password)
    return options


def kafka_options(config: Audit | Reconciliation) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": config.connection,
        "topic": config.destination,
        **AUDIT_PRODUCER,
        **security_options(config.kafka_auth),
    }


def keyed_messages(rows: DataFrame) -> DataFrame:
    """Rows as JSON messages keyed by run."""
    return rows.select(
        F.col("run_id").alias("key"),
        F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"),
    )


def emit(rows: DataFrame, config: Audit | Reconciliation | None) -> bool:
    """Appends a few rows to the sink; True when it took them."""
    kind = sink_type(config)
    try:
        if kind == "KAFKA":
            keyed_messages(rows).write.format("kafka").options(**kafka_options(config)).save()
        elif kind == "JDBC":
            rows.write.format("jdbc").options(**jdbc_options(config)).mode("append").save()
        elif kind == "FILE":
            # A handful of rows per batch: one file, not one per core.
            rows.coalesce(1).write.mode("append").parquet(config.destination)
        else:
            for line in keyed_messages(rows).toLocalIterator():
                _log_line(line["value"])
        return True
    except Exception as error:  # noqa: BLE001 - by contract a sink failure is only logged
        log.warning("%s sink failed: %s", kind, error)
        return False


def _log_line(text: str) -> None:
    record = json.loads(text)
    if "reconciled" not in record:
        log.info("audit event: %s", text)
    elif record["reconciled"]:
        log.info("counts agree: %s", text)
    else:
        log.warning("counts differ (%s): %s", record["discrepancies"], text)
