"""SimHash near-duplicates, found by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most
three bits, one half differs in at most one. Each half is therefore indexed 33 times: as it
is, and with each of its bits left out. Two fingerprints meet in an equality join where
the same half agrees: as it is, or without a bit in which they do differ, so that a pair
does not meet again under every bit. What meets is then verified over all 64 bits.

Only distinct fingerprints are indexed. A variant shared by very many of them is not joined
all against all: its members are dealt into blocks, and every pair of blocks gives the
links that connect what is connected, which are fewer than its members.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_prefix
from .graph import components

SHINGLE_WORDS = 3
MOST_BITS = 3
SEED = 42
#: Shingles hashed and counted at a time, so that a huge text needs bounded memory.
SHINGLES_AT_ONCE = 1 << 16
#: Distinct fingerprints under one variant, beyond which they are linked block by block.
HOT_VARIANT = 256
BLOCK = 2048
EXACT = 32  # the "bit" of a half that is indexed as it is


def words(text: str) -> list[bytes]:
    """Words of the lower-cased text. On bytes, both steps know ASCII only: A-Z, and
    the white space 0x20 and 0x09-0x0D."""
    return text.encode().lower().split()


def _hashes(tokens: list[bytes], size: int) -> Iterable[np.ndarray]:
    """XXH64 of every shingle, repeats included, block by block."""
    digest, shingles = xxhash.xxh64_intdigest, max(len(tokens) - size, 0) + 1
    for at in range(0, shingles if tokens else 0, SHINGLES_AT_ONCE):
        upto = min(at + SHINGLES_AT_ONCE, shingles)
        found = (digest(b" ".join(tokens[i : i + size]), SEED) for i in range(at, upto))
        yield np.fromiter(found, np.uint64, upto - at)


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """Bit b is 1 if it is set in over half of the shingle hashes; without words, 0."""
    ones, total = np.zeros(64, np.int64), 0
    for block in _hashes(words(text or ""), size):
        bits = np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(block)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, fingerprint): the 64 bits as BIGINT, a row per row."""
    kind = docs.schema[key].dataType.simpleString()

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=[key, "fingerprint"]
            )

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(
        computed, f"`{key}` {kind}, fingerprint bigint"
    )


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def variants(prints: DataFrame) -> DataFrame:
    """(variant, side, fingerprint), 66 rows per fingerprint of ``prints``.

    ``variant`` holds the half, the bit left out and the rest of the half; ``side`` is
    that bit's value, or 2 for a half as it is.
    """

    def entry(half: int, bit: int) -> Column:
        shifted = F.shiftrightunsigned("fingerprint", 32) if half == 0 else F.col("fingerprint")
        value = shifted.bitwiseAND(F.lit(0xFFFFFFFF if bit == EXACT else 0xFFFFFFFF ^ (1 << bit)))
        where = F.lit((half * 64 + bit) << 32)
        side = F.lit(2) if bit == EXACT else F.shiftrightunsigned(shifted, bit).bitwiseAND(F.lit(1)).cast("int")
        return F.struct(where.bitwiseOR(value).alias("variant"), side.alias("side"))

    entries = [entry(half, bit) for half in (0, 1) for bit in range(33)]
    return prints.select("fingerprint", F.inline(F.array(*entries))).select("variant", "side", "fingerprint")


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(prints: DataFrame, hot_variant: int = HOT_VARIANT, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within three bits. Under a variant of more than
    ``hot_variant`` members only as many as connect what is connected; none is lost."""
    met = variants(prints).withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("variant")))
    cold = met.where(F.col("members") <= hot_variant)
    left = cold.where("side <> 1").select("variant", "side", F.col("fingerprint").alias("a"))
    right = cold.where("side <> 0").select("variant", F.col("fingerprint").alias("b"))
    close = (_differ("a", "b") <= MOST_BITS) & ((F.col("side") == 0) | (F.col("a") < F.col("b")))
    paired = left.join(right, "variant").where(close).select("a", "b")
    hot = met.where(F.col("members") > hot_variant)
    return paired.unionByName(_block_links(hot, block))


def _block_links(hot: DataFrame, block: int) -> DataFrame:
    blocks = F.ceil(F.col("members") / block)
    own = F.pmod(F.xxhash64("fingerprint"), blocks)
    dealt = hot.select("variant", "fingerprint", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    pair = dealt.select(
        "variant", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fingerprint"
    )

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(spanning(group["fingerprint"].to_numpy(np.int64)), columns=["a", "b"])

    return pair.groupBy("variant", "low", "high").applyInPandas(forest, "a bigint, b bigint")


def spanning(prints: np.ndarray) -> np.ndarray:
    """Links that connect all of ``prints`` that links within three bits connect."""
    rest, found = np.unique(prints), []
    while rest.size:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and rest.size:
            at = frontier.pop()
            # Of a signed number, numpy would count the bits of its absolute value.
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= MOST_BITS
            found += [(at, other) for other in rest[near]]
            frontier += list(rest[near])
            rest = rest[~near]
    return np.array(found, np.int64).reshape(-1, 2)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", hot_variant: int = HOT_VARIANT, block: int = BLOCK
) -> DataFrame:
    """(``key``, fingerprint in hex, component_id), a row per row of ``docs``.

    Documents are linked at three or fewer differing bits; component_id is the smallest
    ``key`` reachable. A null, empty or blank text has the fingerprint zero, which is linked like
    any other. Repeated rows have one component. A null ``key`` takes part and is
    smallest to nobody. Other columns are not read. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, key, text), "fingerprints")
    first = prints.groupBy("fingerprint").agg(F.min(key).alias("_first"))
    roots = components(links(prints.select("fingerprint").distinct(), hot_variant, block))
    rooted = first.join(roots, first["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "_first", F.coalesce("root", "fingerprint").alias("_root")
    )
    smallest = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    classes = rooted.join(smallest, "_root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select(key, as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")
