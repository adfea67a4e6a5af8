"""MIN and MAX over sliding frames, whose work does not grow with the frame.

Extremes do not subtract, so a frame cannot be a difference of running values. Instead the axis is cut into
blocks as long as a frame: a frame that ends in a block is the head of that block up to its end, and the
tail of the block before from its begin. Both are running extremes, one forwards and one backwards,
so each row is met a fixed number of times. A block that holds very many rows is split as any hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import Heat, Split, by_heat, join_on
from .windows import _plain, _to_here, running

#: What a column is folded by, within a part and across parts (which both pass over NULL).
FOLDS = {"min": (F.min, F.least), "max": (F.max, F.greatest)}

#: name of the result -> ("min" or "max", the value)
Extremes = dict[str, tuple[str, Column]]


def running_extremes(
    df: DataFrame, keys: list[str], order: list[str], wanted: Extremes, heat: Heat | None = None
) -> DataFrame:
    """MIN / MAX of all rows so far; ``order`` must be unique within a group. NULLs are passed over, and
    where no row so far has a value the result is NULL. NaN is above all numbers, as in Spark's own."""
    cold, hot, rows = by_heat(df, keys, heat)
    folds = {n: FOLDS[kind][0](c) for n, (kind, c) in wanted.items()}
    out = cold.select("*", *[c.over(_to_here(_plain(keys, order))).alias(n) for n, c in folds.items()])
    if hot is None:
        return out
    split = Split.of(hot, keys, order, rows)
    base = split.summary(
        [c.alias(n) for n, c in folds.items()],
        {f"_before_{n}": FOLDS[kind][0](n).over(split.before()) for n, (kind, _) in wanted.items()},
    )
    local = split.df.select("*", *[c.over(_to_here(split.local())).alias(n) for n, c in folds.items()])
    both = {n: FOLDS[kind][1](F.col(n), F.col(f"_before_{n}")) for n, (kind, _) in wanted.items()}
    return out.unionByName(split.attach(local, base).select(*df.columns, *[c.alias(n) for n, c in both.items()]))


def range_extremes(df: DataFrame, keys: list[str], at: str, width: int, wanted: Extremes) -> DataFrame:
    """MIN / MAX over RANGE BETWEEN width PRECEDING AND CURRENT ROW of the integer column ``at``.

    Rows of one moment are each other's peers and fold to one before anything is ordered. As in SQL, a frame
    without a value gives NULL, and the rows whose ``at`` is NULL are each other's whole frame.
    """
    if width < 0:
        raise ValueError(f"a frame cannot be {width} wide")
    folds = [FOLDS[kind][0](c).alias(f"_x_{n}") for n, (kind, c) in wanted.items()]
    moments = df.groupBy(*keys, at).agg(*folds)
    timed = moments.where(F.col(at).isNotNull()).select(
        *keys, F.col(at).cast("bigint").alias("_at"), *[f"_x_{n}" for n in wanted]
    )
    framed = _framed(timed, keys, width, {n: kind for n, (kind, _) in wanted.items()})
    framed = framed.select(*keys, F.col("_at").cast(df.schema[at].dataType).alias(at), *wanted)
    untimed = moments.where(F.col(at).isNull()).select(*keys, at, *[F.col(f"_x_{n}").alias(n) for n in wanted])
    return join_on(df, framed.unionByName(untimed), [*keys, at]).select(*df.columns, *wanted)


def rows_extremes(
    df: DataFrame, keys: list[str], order: list[str], before: int, wanted: Extremes, heat: Heat | None = None
) -> DataFrame:
    """MIN / MAX over ROWS BETWEEN before PRECEDING AND CURRENT ROW; ``order`` must be unique within a group."""
    if before < 0:
        raise ValueError(f"a frame cannot begin {before} rows before")
    numbered = running(df, keys, order, {"_at": F.lit(1).cast("bigint")}, heat)
    held = numbered.select("*", *[c.alias(f"_x_{n}") for n, (_, c) in wanted.items()])
    return _framed(held, keys, before, {n: kind for n, (kind, _) in wanted.items()}).select(*df.columns, *wanted)


def _framed(rows: DataFrame, keys: list[str], width: int, kinds: dict[str, str]) -> DataFrame:
    """``rows``, one per key and ``_at``, with the extremes of ``_x_<name>`` over width preceding to here."""
    size = width + 1
    # The remainder first: integer division alone rounds towards zero.
    block = F.expr(f"(_at - pmod(_at, {size}L)) div {size}L")
    cells, dealt = [*keys, "_block"], rows.withColumn("_block", block)
    heat = Heat.found(dealt, cells)
    heads = running_extremes(dealt, cells, ["_at"], {f"_h_{n}": (kind, F.col(f"_x_{n}")) for n, kind in kinds.items()}, heat)
    # Every row is met once more, as a question to the block before: what is there from the frame's begin on?
    # At one place rows come before questions.
    value = F.struct("_block", F.col("_at").alias("_place"), F.lit(0).alias("_asks"))
    question = F.struct((F.col("_block") - 1).alias("_block"), (F.col("_at") - width).alias("_place"), F.lit(1).alias("_asks"))
    met = heads.withColumn("_met", F.explode(F.array(value, question))).drop("_block").select("*", "_met.*").drop("_met")
    own = {f"_t_{n}": (kind, F.when(F.col("_asks") == 0, F.col(f"_x_{n}"))) for n, kind in kinds.items()}
    tails = running_extremes(met, cells, ["-_place", "_asks"], own, _asked(heat)).where("_asks = 1")
    return tails.select(*rows.columns, *[FOLDS[kind][1](f"_h_{n}", f"_t_{n}").alias(n) for n, kind in kinds.items()])


def _asked(heat: Heat) -> Heat:
    """The hot blocks once every block is asked by the next: a hot one, and the one before it.

    Any other holds at most twice what an ordinary group does, and each of these at most a hot block's
    rows and questions and as many ordinary ones.
    """
    if heat.hot is None:
        return heat
    before = heat.hot.withColumn("_block", F.col("_block") - 1)
    return Heat(heat.keys, heat.hot.unionByName(before).distinct(), 4 * heat.rows)
