"""Groups too large for one task.

An analytic window puts each PARTITION BY group into a single task. Where one key may
hold a large share of the rows that task never ends, so the operators in this package
split such groups: rows of the hot keys are range-partitioned on (keys, order) into
parts of bounded size, each part is worked on alone, and what crosses a part border
(an offset, the last row, a session edge) is computed from one summary row per part.
Groups below the limit take the ordinary window, which is one shuffle.

The split is written to the shared folder before it is read more than once: range
bounds come from a sample, and a part number must not change when a task is rerun.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import materialize

HOT_GROUP_ROWS = "spark.millrace.hot.group.rows"
DEFAULT_HOT_GROUP_ROWS = 5_000_000
PART = "_part"


def hot_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_GROUP_ROWS, str(DEFAULT_HOT_GROUP_ROWS)))


def ordering(order: list[str]) -> list[Column]:
    """Sort columns from names, a leading minus meaning descending."""
    return [F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_first() for o in order]


def names(order: list[str]) -> list[str]:
    return [o.lstrip("-") for o in order]


def backwards(order: list[str]) -> list[str]:
    """The opposite order: its first row is the other's last."""
    return [o[1:] if o.startswith("-") else f"-{o}" for o in order]


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on same-named keys that also matches NULL with NULL; left keys are kept."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


@dataclass(frozen=True)
class Heat:
    """The hot groups of a table: their keys, and how many rows they hold together.

    Operators over the same rows and keys can share one. A caller who knows the hot keys
    passes them; ``Heat(keys)`` says that there are none. With a Heat at hand an operator
    only builds a plan; without one it counts the groups first.
    """

    keys: list[str]
    hot: DataFrame | None = None
    rows: int = 0

    @classmethod
    def found(cls, df: DataFrame, keys: list[str]) -> "Heat":
        """From one partially aggregated count. It is exact, so both halves are whole."""
        limit = hot_group_rows(df.sparkSession)
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
        if sizes.isEmpty():
            return cls(keys)
        sizes = materialize(sizes, "hot-keys")
        return cls(keys, sizes.select(*keys), sizes.agg(F.sum("_rows")).first()[0])


def by_heat(df: DataFrame, keys: list[str], heat: Heat | None = None) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of ordinary groups, rows of hot groups or None, number of hot rows)."""
    heat = heat or Heat.found(df, keys)
    if heat.keys != keys:
        raise ValueError(f"hot groups of {heat.keys} are not those of {keys}")
    if heat.hot is None:
        return df, None, 0
    return join_on(df, heat.hot, keys, "left_anti"), join_on(df, heat.hot, keys, "left_semi"), heat.rows


@dataclass(frozen=True)
class Split:
    """Hot rows cut into ordered parts: ``PART`` rises along (keys, order)."""

    df: DataFrame
    keys: list[str]
    order: list[str]

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], order: list[str], rows: int) -> "Split":
        parts = max(2, -(-rows // hot_group_rows(df.sparkSession)))
        cut = df.repartitionByRange(parts, *[F.col(k) for k in keys], *ordering(order))
        return cls(materialize(cut.withColumn(PART, F.spark_partition_id()), "split"), keys, order)

    @property
    def cells(self) -> list[str]:
        return [*self.keys, PART]

    def local(self) -> WindowSpec:
        """The window inside one part of one group."""
        return Window.partitionBy(*self.cells).orderBy(*ordering(self.order))

    def summary(self, aggs: list[Column], carried: dict[str, Column]) -> DataFrame:
        """One row per part: ``aggs`` of the part, ``carried`` over the parts before it.

        The windows behind ``carried`` see one row per part, never the data.
        """
        parts = self.df.groupBy(*self.cells).agg(*aggs)
        return parts.select(*self.cells, *[c.alias(n) for n, c in carried.items()])

    def before(self) -> WindowSpec:
        return self.along().rowsBetween(Window.unboundedPreceding, -1)

    def along(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(PART)

    def attach(self, rows: DataFrame, summary: DataFrame) -> DataFrame:
        return join_on(rows, summary, self.cells)
