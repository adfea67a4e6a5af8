"""Token-id files: documents in ascending key order, their ids Simple-8b coded.

A folder holds one table of records. A record is a run of whole documents of one part: its
coded words, the place of every block among them, the escapes, and where each document ends.
Parts are ranges of keys, numbered in order, and a record knows how many ids of its part come before
it; what all earlier parts hold is added when the files are read, from a total per part.
Records are binary columns of Parquet files, so that Spark commits them, whatever executor is
lost, and any store that Spark writes to can hold them. Records are read and decoded independently.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import ready
from .wordpair import ID_BYTES, word_tokenizer

#: Ids from which a record is closed; a longer document is a record of its own length.
RECORD_IDS = 1 << 17
END_ID = 2

_WORD, _PLACE = "<u8", "<u4"


def _record_kind(key_type: str) -> str:
    return (
        f"part int, first bigint, n_ids bigint, words binary, offsets binary, escapes binary, "
        f"keys array<{key_type}>, ends array<bigint>"
    )


class _Record:
    """Documents of a part until they are coded."""

    def __init__(self) -> None:
        self.keys: list = []
        self.ids: list[bytes] = []

    def size(self) -> int:
        return sum(map(len, self.ids)) // ID_BYTES

    def row(self, part: int, first: int) -> tuple:
        ends = list(accumulate(len(i) // ID_BYTES for i in self.ids))
        coded = simple8b.encode(np.frombuffer(b"".join(self.ids), "<u4"))
        return (
            part, first, coded.size, coded.words.astype(_WORD).tobytes(), coded.offsets.astype(_PLACE).tobytes(),
            coded.escapes.astype(_WORD).tobytes(), self.keys, ends,
        )


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text",
    end_id: int = END_ID, record_ids: int = RECORD_IDS,
) -> None:
    """Writes the ids of every whole text, ended by ``end_id``, to the folder ``path``.

    Documents come in ascending order of ``key``, nulls first; those of one key in the order of their
    texts' hashes. A null text is empty, so it is the end id alone. Repeated rows are documents like
    any other and may be dealt to several parts. Other columns are not read. An empty table gives a
    folder without records. One shuffle carries the texts.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    order = [F.col("_key").asc_nulls_first(), F.xxhash64("_text"), "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order)
    ordered = dealt.sortWithinPartitions(*order).select("_key", "_text")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_tokenizer(vocabulary), int(end_id).to_bytes(ID_BYTES, "little")
        part, first, record, held, schema = TaskContext.get().partitionId(), 0, _Record(), 0, None
        for batch in batches:
            schema = schema or _schema(batch.schema.field(0).type)
            for name, coded_text in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1).to_pylist())):
                ids = coded_text + end
                record.keys.append(name)
                record.ids.append(ids)
                held += len(ids) // ID_BYTES
                if held >= record_ids:
                    yield _batch([record.row(part, first)], schema)
                    first, held, record = first + held, 0, _Record()
        if record.keys:
            yield _batch([record.row(part, first)], schema)

    ordered.mapInArrow(coded, _record_kind(kind)).write.option("compression", "none").parquet(path)


def _schema(key_type: pa.DataType) -> pa.Schema:
    whole, raw = pa.int64(), pa.binary()
    return pa.schema([
        ("part", pa.int32()), ("first", whole), ("n_ids", whole), ("words", raw), ("offsets", raw), ("escapes", raw),
        ("keys", pa.list_(key_type)), ("ends", pa.list_(whole)),
    ])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _records(spark: SparkSession, path: str, key_type: str) -> DataFrame:
    """The records, with the number of ids in all earlier parts as ``base``.

    The driver sees a total per part, of which there are as many as the writer had tasks.
    """
    records = spark.read.schema(_record_kind(key_type)).parquet(path)
    totals = sorted(map(tuple, records.groupBy("part").agg(F.sum("n_ids")).collect()))
    before = accumulate((n for _, n in totals[:-1]), initial=0)
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "part int, base bigint")
    return records.join(F.broadcast(bases), "part")


def _numbers(words: bytes, offsets: bytes, escapes: bytes, size: int) -> np.ndarray:
    coded = simple8b.Coded(
        size, np.frombuffer(words, _WORD), np.frombuffer(offsets, _PLACE).astype(np.int64), np.frombuffer(escapes, _WORD)
    )
    return simple8b.decode(coded).astype("<u4")


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id", key_type: str = "bigint") -> DataFrame:
    """(``key``, start, ids): every document's place among all ids, and its ids, without any text."""
    return _documents(spark, path, key, key_type, "ids array<bigint>", lambda ids: ids.astype(np.int64), pa.list_(pa.int64()))


def token_digests(spark: SparkSession, path: str, key: str = "doc_id", key_type: str = "bigint") -> DataFrame:
    """(``key``, start, n_tokens, ids_crc32) of every document in the files."""
    return _documents(spark, path, key, key_type, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.tobytes()), pa.int64(), True)


def _documents(spark, path, key, key_type, column, value, value_type, sized=False) -> DataFrame:  # noqa: PLR0913
    size_name = ["n_tokens"] if sized else []
    names = [key, "start", *size_name, column.split()[0]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, first, size, words, offsets, escapes = (batch.column(c)[row].as_py() for c in range(6))
                keys, ends = batch.column(6)[row].values, batch.column(7)[row].as_py()
                ids, starts = _numbers(words, offsets, escapes, size), [0, *ends[:-1]]
                columns = [keys, pa.array([base + first + s for s in starts], pa.int64())]
                columns += [pa.array([b - a for a, b in zip(starts, ends)], pa.int64())] if sized else []
                columns.append(pa.array([value(ids[a:b]) for a, b in zip(starts, ends)], value_type))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = f"`{key}` {key_type}, start bigint, {'n_tokens bigint, ' if sized else ''}{column}"
    records = _records(ready(spark), path, key_type)
    return records.select("base", "first", "n_ids", "words", "offsets", "escapes", "keys", "ends").mapInArrow(read, kind)
