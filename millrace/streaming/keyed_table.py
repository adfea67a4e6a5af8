"""Keep-last and top-n per key of a stream, as a table that any number of readers see whole.

A stream in append mode cannot take back a row. Here every batch leaves a delta: its own first rows of each
key, in a folder of the batch, so a repeated batch replaces itself. The table is its base and the deltas after it,
folded once more; folding is associative, so the order of batches does not matter. From time to time base and
deltas become a new base, which counts from the moment its number is written; then the old ones go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.groups import ordering
from . import commit_log

#: Deltas after which they become a base.
COMPACT_AFTER = 8


class KeyedTable:
    """The first ``n`` rows of every key by ``order`` (a leading minus means descending).

    ``keys`` may be NULL, which is a key like any other. Rows that ``order`` does not tell apart are taken by the
    hash of their values, so a fold gives the same rows whenever it is made. A key with any number of rows costs
    a task ``n`` rows.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema, keys: list[str], order: list[str], n: int = 1, compact_after: int = COMPACT_AFTER
    ):
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.order, self.n, self.compact_after = keys, order, n, compact_after

    def first(self, rows: DataFrame) -> DataFrame:
        along = Window.partitionBy(*self.keys).orderBy(*ordering(self.order), F.xxhash64(*rows.columns))
        placed = rows.withColumn("_place", F.row_number().over(along))
        return placed.where(F.col("_place") <= self.n).drop("_place")

    def base(self) -> int:
        """The number of the batch up to which the base reaches, or -1."""
        return max((int(n) for n in commit_log.names(self.spark, f"{self.path}/current") if n.isdigit()), default=-1)

    def _deltas(self, after: int) -> list[int]:
        """Batches whose deltas are complete."""
        found = [int(n) for n in commit_log.names(self.spark, f"{self.path}/deltas") if n.isdigit() and int(n) > after]
        return sorted(n for n in found if commit_log.exists(self.spark, f"{self.path}/deltas/{n}/_SUCCESS"))

    def _stored(self, base: int, deltas: list[int]) -> DataFrame:
        folders = [f"{self.path}/base/{base}"] if base >= 0 else []
        folders += [f"{self.path}/deltas/{n}" for n in deltas]
        reader = self.spark.read.schema(self.schema)
        return self.first(reader.parquet(*folders)) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as it is now."""
        base = self.base()
        return self._stored(base, self._deltas(base))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Takes a batch of the stream in; a batch that the base has is in already."""
        base = self.base()
        if number <= base:
            return
        self.first(batch.select(*self.schema.names)).write.mode("overwrite").parquet(f"{self.path}/deltas/{number}")
        deltas = self._deltas(base)
        if len(deltas) >= self.compact_after:
            self._compact(base, deltas)

    def _compact(self, base: int, deltas: list[int]) -> None:
        """One base of all that is there. A crash before its number is written leaves the old one in force."""
        new = deltas[-1]
        self._stored(base, deltas).write.mode("overwrite").parquet(f"{self.path}/base/{new}")
        commit_log.write_text(self.spark, f"{self.path}/current/{new}", "")
        for old in [f"deltas/{n}" for n in deltas] + ([f"base/{base}", f"current/{base}"] if base >= 0 else []):
            commit_log.delete(self.spark, f"{self.path}/{old}")

    def follow(self, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts the query that keeps the table up to date."""
        writer = rows.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
