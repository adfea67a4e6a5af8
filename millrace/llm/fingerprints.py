"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is cut into short paragraphs at line ends and at places that the letters there
decide, so that an edit leaves the other paragraphs as they were. Each paragraph's digest goes
into one cell of each of three tables: a cell holds how many digests it took, their
exclusive-or and that of their checks. Cells of two versions subtract; what both hold
is gone, and peeling the cells that hold one digest recovers the differing ones. If peeling
stops early, both versions are sketched anew in larger tables until it does not.

Sketches of all texts of a batch are built, subtracted and peeled together, on flat arrays.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = 3
#: Cells of each table of a fingerprint, and by how much they grow on failure.
CELLS, GROWTH = 12, 4
#: Paragraphs end after about one word of four, decided by the letters before the blank.
CUT_BITS = 2
#: Attempts after which digests are compared directly; the last tables are far too large to fail.
ATTEMPTS = 14
#: Characters sketched together.
BATCH_CHARS = 1 << 21

_U = np.uint64
_GOLDEN, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _seeded(keys: np.ndarray, seed: int) -> np.ndarray:
    return _mixed(keys + _U(int(_GOLDEN) * (seed + 1) % 2**64))


def paragraphs(text: str) -> list[bytes]:
    """The text's paragraphs, in order; blanks around them do not count."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if not data.size:
        return []
    padded = np.concatenate([np.zeros(3, np.uint32), data])
    before = padded[:-3] * 0x9E3B + padded[1:-2] * 0x85EB + padded[2:-1] * 0xC2B3
    falls = ((before * np.uint32(0x9E3779B1)) >> np.uint32(32 - CUT_BITS)) == 0
    ends = np.flatnonzero((data == 10) | (data == 32) & falls).tolist()
    cut = (raw[a:b].strip() for a, b in zip([0, *ends], [*ends, len(raw)]))
    return [p for p in cut if p]


class Digests:
    """Paragraph digests of many texts: ``keys``, and the text ``owner`` each belongs to."""

    def __init__(self, texts: list[str]):
        cut = [paragraphs(t) for t in texts]
        self.sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        self.owner = np.repeat(np.arange(len(cut)), self.sizes)
        digest = xxhash.xxh3_64_intdigest
        self.keys = np.fromiter((digest(p) for ps in cut for p in ps), _U, int(self.sizes.sum()))
        self._count_repeats()

    def _count_repeats(self) -> None:
        """The second, third ... of equal paragraphs become keys of their own."""
        order = np.lexsort((self.keys, self.owner))
        keys, owner = self.keys[order], self.owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        self.owner, self.keys = owner, _seeded(keys ^ _mixed((np.arange(len(keys)) - first).astype(_U)), 0)

    def sketch(self, cells: np.ndarray, seed: int) -> "Sketches":
        """Text i in ``TABLES`` tables of cells[i] cells each; texts with 0 cells are left out."""
        out = Sketches(cells)
        taken = cells[self.owner] > 0
        keys, owner = self.keys[taken], self.owner[taken]
        for place in out.places(keys, owner, seed):
            np.add.at(out.count, place, 1)
            np.bitwise_xor.at(out.key, place, keys)
            np.bitwise_xor.at(out.check, place, _seeded(keys, 99))
        return out


class Sketches:
    """Cells of many texts, one after the other."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells.astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.cells * TABLES)])
        total = int(self.start[-1])
        self.count, self.key, self.check = np.zeros(total, np.int64), np.zeros(total, _U), np.zeros(total, _U)

    def places(self, keys: np.ndarray, owner: np.ndarray, seed: int) -> Iterator[np.ndarray]:
        size = self.cells[owner]
        for table in range(TABLES):
            at = (_seeded(keys, 7 + seed * TABLES + table) % size.astype(_U)).astype(np.int64)
            yield self.start[owner] + table * size + at

    def minus(self, other: "Sketches") -> "Sketches":
        out = Sketches(self.cells)
        out.count = self.count - other.count
        out.key, out.check = self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(recovered, done): per text, the number of differing digests that peeling
        recovers, and whether it left nothing."""
        text = np.repeat(np.arange(len(self.cells)), self.cells * TABLES)
        found = np.zeros(len(self.cells), np.int64)
        look = np.flatnonzero(self.count | (self.key != 0))
        while look.size:
            pure = look[(np.abs(self.count[look]) == 1) & (_seeded(self.key[look], 99) == self.check[look])]
            if not pure.size:
                break
            # A digest may be alone in several of its cells: it is taken out once.
            tagged = np.unique(np.stack([text[pure].astype(_U), self.key[pure], self.count[pure].astype(_U)]), axis=1)
            owner, keys, sign = tagged[0].astype(np.int64), tagged[1], tagged[2].astype(np.int64)
            np.add.at(found, owner, 1)
            touched = []
            for place in self.places(keys, owner, seed):
                np.add.at(self.count, place, -sign)
                np.bitwise_xor.at(self.key, place, keys)
                np.bitwise_xor.at(self.check, place, _seeded(keys, 99))
                touched.append(place)
            look = np.unique(np.concatenate(touched))
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        return found, np.bincount(text[left], minlength=len(self.cells)) == 0

    def shown(self) -> list[str]:
        """Each text's cells as text: counts, keys and checks."""
        out = []
        for a, b in zip(self.start[:-1], self.start[1:]):
            parts = (self.count[a:b].astype("<u4"), self.key[a:b].astype("<u8"), self.check[a:b].astype("<u8"))
            out.append(base64.b64encode(b"".join(p.tobytes() for p in parts)).decode())
        return out


def differing(a: Digests, b: Digests, cells: int = CELLS) -> np.ndarray:
    """Per pair of texts, how many paragraph digests one holds and the other does not."""
    sizes, found = np.full(len(a.sizes), cells), np.zeros(len(a.sizes), np.int64)
    for attempt in range(ATTEMPTS):
        if not sizes.any():
            return found
        recovered, done = a.sketch(sizes, attempt).minus(b.sketch(sizes, attempt)).peel(attempt)
        done &= sizes > 0
        found[done] = recovered[done]
        # Beyond four cells per digest, growing further would not help: only the seed changes.
        most = np.maximum(2 * (a.sizes + b.sizes), cells)
        sizes = np.where(done | (sizes == 0), 0, np.minimum(sizes * GROWTH, most))
    for at in np.flatnonzero(sizes):
        found[at] = np.setxor1d(a.keys[a.owner == at], b.keys[b.owner == at]).size
    return found


def likeness(a: Digests, b: Digests) -> np.ndarray:
    """1 less the differing share of both texts' paragraphs; two texts without any are alike."""
    total = a.sizes + b.sizes
    return np.where(total == 0, 1.0, 1.0 - differing(a, b) / np.maximum(total, 1))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


RESULT = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(keys: list, pairs: list[tuple[str, str]], schema: pa.Schema) -> pa.RecordBatch:
    own, new = [p[0] for p in pairs], [edited(*p) for p in pairs]
    a, b, c = Digests(own), Digests(new), Digests([p[1] for p in pairs])
    base = np.full(len(pairs), CELLS)
    columns = [
        keys,
        [len(t) for t in own],
        [hashlib.sha256(t.encode()).hexdigest() for t in new],
        a.sketch(base, 0).shown(),
        b.sketch(base, 0).shown(),
        likeness(a, b),
        likeness(a, c),
    ]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def with_next(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Rows dealt into ranges of ``key``, each range in order and ended by a guest: the
    first row of the next range, or of the first range after the last.

    Ranges are cut at quantiles of the keys; there are as many as shuffle partitions. The
    driver sees a key per range. One shuffle carries the texts.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    shares = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("_key", shares, min(100 * parts, 1_000_000))).first()[0] if shares else None
    borders = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(borders, keys.to_numpy(np.int64, na_value=0), side="right")
        return pd.Series(np.where(keys.isna(), 0, at), dtype="int32")

    ranged = rows.withColumn("_range", range_of("_key"))
    heads = ranged.groupBy("_range").agg(F.min(F.struct(F.col("_key").isNotNull(), "_key")).alias("_head")).orderBy("_range").collect()
    if not heads:
        return ranged.withColumn("_guest", F.lit(False)), parts
    order = [h["_range"] for h in heads]
    before = dict(zip(order, [order[-1], *order[:-1]]))
    first = spark.createDataFrame(
        [(h["_range"], before[h["_range"]], h["_head"]["_key"]) for h in heads], "_range int, _to int, _key bigint"
    )
    guests = ranged.join(
        F.broadcast(first), (ranged["_range"] == first["_range"]) & ranged["_key"].eqNullSafe(first["_key"])
    ).groupBy("_to").agg(F.min("_text").alias("_text"))
    guests = guests.select(F.lit(None).cast("bigint").alias("_key"), "_text", F.col("_to").alias("_range"), F.lit(True).alias("_guest"))
    return ranged.withColumn("_guest", F.lit(False)).unionByName(guests), parts


def fingerprint_versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text is the text with its last quarter (of code points) replaced by as much
    of the beginning of the next document, in ascending order of ``key``, nulls first, then of the
    text; the first follows the last. A null text is empty. Repeated rows each have a result and
    follow one another. Two texts without paragraphs have likeness 1. Other columns are not read. An
    empty table gives an empty result. ``key`` is a whole number.
    """
    rows, parts = with_next(docs, key, text)
    # A task per range: by hash, several ranges could meet in one.
    dealt = rows.repartitionById(parts, "_range").sortWithinPartitions(
        "_range", "_guest", F.col("_key").asc_nulls_first(), "_text"
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        schema = pa.schema(list(zip(names, kinds)))
        keys, pairs, size, held = [], [], 0, None
        for batch in batches:
            for name, value, guest in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if held is not None:
                    keys.append(held[0])
                    pairs.append((held[1], value))
                    size += len(held[1]) + len(value)
                held = None if guest else (name, value)
                if size > BATCH_CHARS:
                    yield _compare(keys, pairs, schema)
                    keys, pairs, size = [], [], 0
        if pairs:
            yield _compare(keys, pairs, schema)

    return dealt.select("_key", "_text", "_range", "_guest").mapInArrow(compared, f"`{key}` bigint, {RESULT}")
