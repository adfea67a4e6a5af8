"""Session settings and the shared scratch folder.

Everything that has to survive a lost executor (range splits, stream checkpoints) is
written under ``spark.checkpoint.dir``, which a cluster names. Only a local master may
fall back to a folder of its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Repeated keys in a message: the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A generated method above 8000 bytes is never compiled by the JVM; wide schemas then
    # run faster as separate operators than as one interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Session windows of a stream merge in each task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Operator state off the heap, with incremental checkpoints.
    "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else every write of a state row reads it first, to count rows that nothing here asks for.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # One store for each partition of a stream join instead of four.
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Applies the SQL settings the library relies on; sizing stays with the cluster.

    They stay for the session, whose own time zone, codecs and state store they replace: a
    caller who needs others there gives the library a session of its own (``spark.newSession()``).
    """
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    base = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set(CHECKPOINT_DIR, base)
    return base


def fresh_path(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark)}/millrace/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage."""
    path = fresh_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
