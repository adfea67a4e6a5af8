"""Exact top-k by inner product, with vector-approximation files.

Every dimension is cut into cells between its least and its greatest value; the approximation
of a vector is a byte per dimension, the number of its cell. The cells bound the vector's
score against a query from both sides. The scan reads approximations only, block
against block, and keeps what may be among the k best. Exact vectors are then read in the order of
their upper bounds: first about as many as a result needs, and then those whose
bound is not below the k-th score so far, after which the result is certain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

CELLS = 64
#: Queries and vectors that meet in one task: both sides are dealt into blocks of about this size.
QUERY_BLOCK, VECTOR_BLOCK = 512, 4096
#: Components are below this after scaling, so that differences of two fit a long.
MOST = 2.0**62
#: Products and sums below this are exact as doubles.
EXACT_DOUBLE = 2.0**52
#: Sums of products below this fit a long.
EXACT_LONG = 2.0**62
#: Doubles up to this become longs without passing their range.
LAST_DOUBLE = 2.0**63 - 1024
LEAST_LONG, GREATEST_LONG = -(2**63), 2**63 - 1


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite.
    A component of ``MOST`` or more after scaling raises."""
    doubles = vector.cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    beyond = F.raise_error(F.lit("a component is too large for a whole number")).cast("bigint")
    whole = F.transform(doubles, lambda x: F.when(F.abs(x) * scale < F.lit(MOST), F.floor(x * scale)).otherwise(beyond))
    return F.when(F.coalesce(finite, F.lit(False)), whole)


def _greatest(vector: Column) -> Column:
    """The largest absolute component, as a double."""
    return F.coalesce(F.array_max(F.transform(vector, F.abs)), F.lit(0)).cast("double")


def top_k(
    vectors: DataFrame,
    asked: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    query_block: int = QUERY_BLOCK,
    vector_block: int = VECTOR_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``asked`` selects, the ``k`` other rows
    of the highest integer inner product, ties to the smaller id; all if there are fewer.

    Rows with a null id, a null vector, or null or non-finite components take no part; empty
    vectors score 0. A component of ``MOST`` or more after scaling raises, and so does a score among the best that a
    long cannot hold; whatever fits is exact. Vectors are compared with those of as many dimensions. Of rows that
    share an id, the one with the smallest vector takes part. Other columns are not read. An empty
    table, or no query, gives an empty result. Of equal vectors only the k + 1 smallest ids can
    appear in a result, so a vector that very many rows share is searched once.
    """
    rows = vectors.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), whole_numbers(F.col(vector)).alias("v"), asked.alias("asked")
    )
    rows = rows.where("v is not null").groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))
    rows = materialize(rows, "vectors")
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    members = rows.select("id", "v", place.alias("place")).where(F.col("place") <= k + 1)
    classes = members.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = materialize(classes.select(F.element_at("ids", 1).alias("class"), "ids", "v", _greatest(F.col("v")).alias("v_most")), "classes")
    queries = rows.where("asked").select(F.col("id").alias("query_id"), F.col("v").alias("q"), _greatest(F.col("v")).alias("q_most"))

    found = materialize(_scan(classes, queries, k, query_block, vector_block), "candidates")
    scored = _read_in_order(found, classes, queries, k)
    each = scored.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def _grid(classes: DataFrame) -> DataFrame:
    """Per number of dimensions n: the least value of each, and the width of its cells."""
    each = classes.select(F.size("v").alias("n"), F.posexplode_outer("v").alias("d", "x"))
    ends = each.groupBy("n", "d").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    width = F.expr(f"(high - low) div {CELLS} + 1")
    # An empty vector has no dimension, and no cell.
    dimension = F.when(F.col("d").isNotNull(), F.struct("d", "low", width.alias("width")))
    listed = ends.groupBy("n").agg(F.sort_array(F.collect_list(dimension)).alias("g"))
    return listed.select("n", F.col("g.low").alias("low"), F.col("g.width").alias("width"))


def _numbers(count: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))


def _scan(classes: DataFrame, queries: DataFrame, k: int, query_block: int, vector_block: int) -> DataFrame:
    """(query_id, class, lower, upper): the classes that may hold one of a query's k best."""
    grid = materialize(_grid(classes), "grid")
    columns = max(1, -(-classes.count() // vector_block))
    lines = max(1, -(-queries.count() // query_block))
    cells = F.expr("transform(v, (x, d) -> cast((x - get(low, d)) div get(width, d) as tinyint))")
    alone = F.when(F.size("ids") == 1, F.col("class"))
    approximations = (
        classes.withColumn("n", F.size("v")).join(grid, "n")
        .select("n", "class", alone.alias("alone"), cells.alias("cells"), F.pmod(F.xxhash64("class"), F.lit(columns)).alias("column"))
        .withColumn("line", F.explode(_numbers(lines)))
    )
    asked = (
        queries.withColumn("n", F.size("q")).join(grid, "n")
        .withColumn("line", F.pmod(F.xxhash64("query_id"), F.lit(lines)))
        .withColumn("column", F.explode(_numbers(columns)))
    )

    def meet(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        return block_candidates(block, ask, k)

    cell = ["n", "column", "line"]
    return approximations.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(
        meet, "query_id bigint, class bigint, lower bigint, upper bigint"
    )


def _stacked(lists: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in lists])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in whole numbers; by way of doubles where those are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if most < EXACT_DOUBLE else a @ b


def _bounds(queries: np.ndarray, least: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between what a query's score with any vector of a cell lies: exact ends where longs hold them, else
    ends in doubles, moved apart by more than their rounding."""
    most = float(np.abs(queries).max(initial=0)) * (float(np.abs(least).max(initial=0)) + float(spread.max(initial=0)))
    dimensions = max(queries.shape[1], 1)
    if most * dimensions < EXACT_LONG:
        base = _product(queries, least.T)
        return (base + _product(np.minimum(queries, 0), spread[:, None]), base + _product(np.maximum(queries, 0), spread[:, None]))
    q, start, wide = (a.astype(np.float64) for a in (queries, least, spread[:, None]))
    base = q @ start.T
    slack = 1 + (np.abs(q) @ np.abs(start).T + np.abs(q) @ wide) * (dimensions + 8) * 2.0**-51
    lower, upper = base + np.minimum(q, 0) @ wide - slack, base + np.maximum(q, 0) @ wide + slack
    held = [np.clip(end, -LAST_DOUBLE, LAST_DOUBLE).astype(np.int64) for end in (np.floor(lower), np.ceil(upper))]
    # Beyond the doubles that a long takes, the end of the longs is the bound.
    return np.where(lower <= -LAST_DOUBLE, LEAST_LONG, held[0]), np.where(upper >= LAST_DOUBLE, GREATEST_LONG, held[1])


def block_candidates(block: pd.DataFrame, ask: pd.DataFrame, k: int) -> pd.DataFrame:
    """What of a block of approximations may be among the k best of each query."""
    names = ["query_id", "class", "lower", "upper"]
    if block.empty or ask.empty:
        return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
    low, width = (np.asarray(ask[c].iloc[0], np.int64) for c in ("low", "width"))
    least = low + _stacked(block["cells"]) * width
    lower, upper = _bounds(_stacked(ask["q"]), least, width - 1)
    ids, alone, classes = ask["query_id"].to_numpy(), block["alone"].fillna(-1).to_numpy(np.int64), block["class"].to_numpy()
    own = (ids[:, None] == alone[None, :]) & block["alone"].notna().to_numpy()[None, :]
    known = np.where(own, LEAST_LONG, lower)
    bar = np.partition(known, -k, axis=1)[:, -k] if known.shape[1] > k else np.full(len(ids), LEAST_LONG)
    query, at = np.nonzero((upper >= bar[:, None]) & ~own)
    return pd.DataFrame(dict(zip(names, (ids[query], classes[at], lower[query, at], upper[query, at]))))


def _first(rows: DataFrame, by: str, most: int) -> DataFrame:
    """Each query's ``most`` rows with the greatest ``by``. Every task cuts its own rows before they are shuffled."""
    along = Window.partitionBy("query_id").orderBy(F.desc(by), "class")
    return rows.withColumn("nth", F.row_number().over(along)).where(F.col("nth") <= most)


def _last_of(rows: DataFrame, by: str, k: int) -> DataFrame:
    """(query_id, ``by``): the k-th greatest, of queries with as many rows."""
    return _first(rows.select("query_id", "class", by), by, k).where(F.col("nth") == k).select("query_id", by)


def _read_in_order(found: DataFrame, classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, ids, score) of every class that can hold one of a query's k best."""
    turns = _first(found.select("query_id", "class", "upper"), "upper", 2 * k).select("query_id", "class")
    first = materialize(_exact(turns, classes, queries), "read")
    # Without a k-th score, all candidates have been read.
    bars = _last_of(found, "lower", k).join(_last_of(first, "score", k), "query_id")
    bars = bars.select("query_id", F.greatest("lower", "score").alias("bar"))
    open_ = found.join(bars, "query_id").where("upper >= bar").select("query_id", "class")
    rest = _exact(open_.join(first.select("query_id", "class"), ["query_id", "class"], "left_anti"), classes, queries)
    return first.unionByName(rest).select("query_id", "ids", "score")


def _exact(wanted: DataFrame, classes: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact scores: in longs where no sum can pass one, else in decimals; a score beyond a long raises."""

    def summed(kind: str, product) -> Column:
        return F.aggregate(F.zip_with("v", "q", product), F.lit(0).cast(kind), lambda total, x: (total + x).cast(kind))

    narrow = summed("bigint", lambda x, y: x * y)
    wide = summed("decimal(38,0)", lambda x, y: x.cast("decimal(19,0)") * y.cast("decimal(19,0)"))
    fits = wide.between(F.lit(LEAST_LONG), F.lit(GREATEST_LONG))
    beyond = F.raise_error(F.lit("a score is too large for a long")).cast("bigint")
    short = F.col("v_most") * F.col("q_most") * F.size("v") < F.lit(EXACT_LONG)
    score = F.when(short, narrow).when(fits, wide.cast("bigint")).otherwise(beyond)
    read = wanted.select("query_id", "class").join(classes, "class").join(queries, "query_id")
    return read.select("query_id", "class", "ids", score.alias("score"))
