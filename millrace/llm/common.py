"""What the operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..session import fresh_path, prepare

#: Rows of one Arrow batch: texts are long, and a worker holds a batch at a time.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_PER_BATCH = "512"


def ready(spark: SparkSession) -> SparkSession:
    spark.conf.set(ARROW_ROWS, TEXTS_PER_BATCH)
    return prepare(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def free_prefix(*tables: DataFrame) -> str:
    """A prefix that no column of ``tables`` has, for columns that an operator adds meanwhile."""
    prefix, taken = "_", [c.lower() for t in tables for c in t.columns]
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def by_size(texts: Iterable, chars: int) -> Iterator[list]:
    """Runs of (row, text) pairs of about ``chars`` characters in all."""
    run, size = [], 0
    for row, text in texts:
        run.append((row, text))
        size += len(text)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


class Scratch:
    """Tables in the shared folder that last as long as the steps that read them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, purpose: str) -> DataFrame:
        """Writes ``df`` and reads it back; then nothing needs the shuffles behind it any more."""
        path = fresh_path(self.spark, purpose)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        self.free()
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that ``keep`` gave, if it is one."""
        _, path = self.paths.pop(id(df), (None, None))
        if path is not None:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def close(self) -> None:
        for df, _ in list(self.paths.values()):
            self.drop(df)
        self.free()

    def free(self) -> None:
        """Has Spark delete the shuffle files of frames that are gone: it does when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
