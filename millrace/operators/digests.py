"""Record reconciliation of tables too large to compare: digests first, rows only where they differ.

Rows fall into leaves by a hash of their business key, leaves into branches. The digest of a set of
rows is their number and two sums of row hashes: it does not depend on order, sees repeated rows, and
the digest of a branch is the sum of its leaves'. A snapshot keeps rows by branch, in the order of their
leaves, with the digests beside them. Two snapshots are compared from the top: branches, then the
leaves of differing branches, then the rows of differing leaves. What agrees is never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reconcile

BRANCHES, LEAVES = 64, 64
#: Tasks that share the rows of one branch when a snapshot is written.
SPREAD = 4

BRANCH, LEAF = "_branch", "_leaf"
_SUMS = ("_n", "_one", "_two")


def _marked(columns: list[str]) -> list[Column]:
    """Values with a mark of their own for NULL, which hashes pass over."""
    return [x for c in columns for x in (F.col(c).isNull(), F.col(c))]


def _hash(purpose: str, columns: list[str]) -> Column:
    return F.xxhash64(F.lit(purpose), *_marked(columns)).cast("decimal(38,0)")


def placed(df: DataFrame, keys: list[str], branches: int = BRANCHES, leaves: int = LEAVES) -> DataFrame:
    """Rows with their branch and leaf; leaves are numbered through all branches."""
    leaf = F.pmod(F.xxhash64(F.lit("leaf"), *_marked(keys)), F.lit(branches * leaves)).cast("int")
    return df.withColumn(LEAF, leaf).withColumn(BRANCH, F.expr(f"{LEAF} div {leaves}").cast("int"))


def digests(rows: DataFrame, by: list[str]) -> DataFrame:
    """One digest per group of placed rows; a task passes on one row per group. Columns count by name, in any order."""
    columns = sorted(c for c in rows.columns if c not in (BRANCH, LEAF))
    sums = [F.count(F.lit(1)).cast("decimal(38,0)"), F.sum(_hash("one", columns)), F.sum(_hash("two", columns))]
    return rows.groupBy(*by).agg(*[s.cast("decimal(38,0)").alias(n) for s, n in zip(sums, _SUMS)])


def write_snapshot(
    df: DataFrame, path: str, keys: list[str], branches: int = BRANCHES, leaves: int = LEAVES, spread: int = SPREAD
) -> None:
    """Writes rows, leaf digests and branch digests under ``path``.

    A hot key lies in one leaf, but its rows are written by several tasks. Digests are taken of the rows as they
    were written.
    """
    spark = df.sparkSession
    dealt = placed(df, keys, branches, leaves).repartition(
        F.col(BRANCH), F.pmod(F.monotonically_increasing_id(), F.lit(spread))
    )
    dealt.sortWithinPartitions(BRANCH, LEAF).write.partitionBy(BRANCH).parquet(f"{path}/rows")
    rows = _rows(spark, path, df.schema)
    digests(rows, [BRANCH, LEAF]).repartition(BRANCH).write.partitionBy(BRANCH).parquet(f"{path}/leaves")
    folded = _digests(spark, path, "leaves").groupBy(BRANCH).agg(*[F.sum(n).cast("decimal(38,0)").alias(n) for n in _SUMS])
    folded.coalesce(1).write.parquet(f"{path}/branches")


def _rows(spark: SparkSession, path: str, schema) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{kinds}, {LEAF} int, {BRANCH} int").parquet(f"{path}/rows")


def _digests(spark: SparkSession, path: str, level: str) -> DataFrame:
    place = f"{LEAF} int, {BRANCH} int" if level == "leaves" else f"{BRANCH} int"
    return spark.read.schema(", ".join([*[f"{n} decimal(38,0)" for n in _SUMS], place])).parquet(f"{path}/{level}")


def _differing(one: DataFrame, two: DataFrame, by: str) -> list[int]:
    """Groups whose digests differ, or that only one side has. There are never more than leaves in a snapshot."""
    stacked = one.select(by, *_SUMS).unionByName(two.select(by, *[(-F.col(n)).cast("decimal(38,0)").alias(n) for n in _SUMS]))
    left = stacked.groupBy(by).agg(*[F.sum(n).alias(n) for n in _SUMS])
    found = left.where(" OR ".join(f"{n} <> 0" for n in _SUMS)).select(by)
    return sorted(r[by] for r in found.toLocalIterator())


def differing_leaves(spark: SparkSession, source: str, target: str) -> tuple[list[int], list[int]]:
    """(branches, leaves) of two snapshots that do not agree."""
    pair = [_digests(spark, p, "branches") for p in (source, target)]
    branches = _differing(*pair, BRANCH)
    if not branches:
        return [], []
    below = [_digests(spark, p, "leaves").where(F.col(BRANCH).isin(branches)) for p in (source, target)]
    return branches, _differing(*below, LEAF)


def drill(spark: SparkSession, source: str, target: str, keys: list[str], schema) -> DataFrame:
    """What ``reconcile.records`` finds between the rows of two snapshots, reading differing leaves only.

    Both were written with the same ``keys``, branches and leaves. ``schema`` is that of the rows. Keys and values
    that are NULL compare as equal. Snapshots that agree give no rows, and none of theirs is read.
    """
    branches, leaves = differing_leaves(spark, source, target)
    sides = [
        _rows(spark, p, schema).where(F.col(BRANCH).isin(branches) & F.col(LEAF).isin(leaves)).drop(BRANCH, LEAF)
        for p in (source, target)
    ]
    return reconcile.records(*sides, keys)
