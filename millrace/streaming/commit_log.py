"""What a streaming query has committed, as its own logs tell: batches, their files, their times.

A file sink keeps one log entry per batch beside its files, a query one per batch under its
checkpoint. They are small and read by the driver, a batch at a time; no data file is opened.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession

SINK_LOG = "_spark_metadata"
_COMPACT = ".compact"


@dataclass(frozen=True)
class Committed:
    """A batch of a file sink; ``upto`` counts the files of all batches up to it."""

    batch: int
    files: tuple[str, ...]
    upto: int


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    path = _path(spark, folder)
    system = _system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []


def exists(spark: SparkSession, file: str) -> bool:
    path = _path(spark, file)
    return _system(spark, path).exists(path)


def delete(spark: SparkSession, file: str) -> bool:
    path = _path(spark, file)
    return _system(spark, path).delete(path, True)


def write_text(spark: SparkSession, file: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    folder, name = file.rsplit("/", 1)
    final, draft = _path(spark, file), _path(spark, f"{folder}/.{name}.draft")
    system = _system(spark, final)
    stream = system.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not system.rename(draft, final):
        raise OSError(f"cannot write {file}")


def read_text(spark: SparkSession, file: str) -> str:
    path = _path(spark, file)
    stream = _system(spark, path).open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _lines(spark: SparkSession, file: str) -> list[str]:
    """The lines of a log entry after its version."""
    return read_text(spark, file).split("\n")[1:]


def _records(spark: SparkSession, file: str) -> list[dict]:
    return [json.loads(line) for line in _lines(spark, file) if line.strip()]


def decoded(spark: SparkSession, url: str) -> str:
    """A path from a log, where it is written as a URL."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(url)).toString()


def sink_batches(spark: SparkSession, folder: str, after: int, upto: int) -> list[Committed]:
    """Batches of the file sink of ``folder`` that follow batch ``after``, which ended with file number ``upto``.

    Every tenth entry of the log repeats those before it. What is new in it are the files beyond
    ``upto``; should it stand for several batches whose own entries are gone, they count as its one.
    """
    log = f"{folder}/{SINK_LOG}"
    found = names(spark, log)
    plain = {int(n) for n in found if n.isdigit()}
    whole = sorted(int(n.removesuffix(_COMPACT)) for n in found if n.endswith(_COMPACT) and n.removesuffix(_COMPACT).isdigit())
    out = []
    while True:
        if after + 1 in plain:
            after += 1
            files = [r["path"] for r in _records(spark, f"{log}/{after}")]
        elif later := [n for n in whole if n > after]:
            after = later[0]
            files = [r["path"] for r in _records(spark, f"{log}/{after}{_COMPACT}")][upto:]
        else:
            return out
        upto += len(files)
        out.append(Committed(after, tuple(decoded(spark, f) for f in files), upto))


def committed_upto(spark: SparkSession, query: str) -> int:
    """The newest batch that the query under checkpoint ``query`` has committed, or -1."""
    return max((int(n) for n in names(spark, f"{query}/commits") if n.isdigit()), default=-1)


def batch_time(spark: SparkSession, query: str, batch: int) -> int | None:
    """When a batch was planned, in epoch milliseconds; None if the query no longer knows it."""
    file = f"{query}/offsets/{batch}"
    if not exists(spark, file):
        return None
    return int(json.loads(_lines(spark, file)[0])["batchTimestampMs"])


def source_files(spark: SparkSession, query: str, after: int, upto: int) -> list[str]:
    """Files that the query's file sources took in batches after ``after``, up to ``upto``."""
    out = []
    for source in names(spark, f"{query}/sources"):
        folder = f"{query}/sources/{source}"
        for name in names(spark, folder):
            number = name.removesuffix(_COMPACT)
            if number.isdigit() and int(number) > after:
                taken = _records(spark, f"{folder}/{name}")
                out += [r["path"] for r in taken if after < r.get("batchId", -1) <= upto]
    return [decoded(spark, f) for f in dict.fromkeys(out)]
