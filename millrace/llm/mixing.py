"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Every source has a weight and may be repeated at most ``most_epochs`` times. Targets are
shares of ``budget`` times all words, by weight; a source whose share is above its cap is
clamped to it, and the excess goes to the others by weight until none is above. A
document is taken whole as often as its source's epochs allow, and a fraction of the source once
more: the documents whose seeded number is low, cut so that the words meet the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_prefix

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
#: Seeded numbers fall into so many bins per source; in the bin at the border of the
#: fraction, each document gives the same share of its words.
BINS = 4096

BLANKS = "\t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D."""
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.size(_words(text))).cast("bigint")


def _seeded(key: Column, purpose: str) -> Column:
    """A whole number below 2**32 that depends on the key and the seed alone."""
    shown = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}/{purpose}/"), shown)), 1, 8), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row per source.

    Sources in the order of their code points, null last, take ``weights`` in turn. In the
    order of cap by weight, the clamped sources come first: a source is clamped if its share
    of what the ones before it leave is above its cap.
    """
    total = F.sum("source_size").over(Window.partitionBy()).cast("double") * budget
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    placed = sizes.select(
        "source", "source_size", turn.alias("weight"), total.alias("total"),
        (F.col("source_size") * most_epochs).cast("double").alias("cap"),
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    placed = placed.select(
        "*", F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("spent"), F.sum("weight").over(after).alias("open")
    )
    placed = placed.withColumn("clamped", (F.col("total") - F.col("spent")) * F.col("weight") > F.col("cap") * F.col("open"))
    everyone = Window.partitionBy()
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(everyone), F.lit(0.0))
    shared = F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(everyone)
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * left / shared)
    return placed.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    most_epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """``docs`` and size, source_size, target, taken: the words of the row that the mix takes.

    ``taken`` div size is how often the whole text is taken, the rest how many of its words are
    taken once more. Null, empty and blank texts have size 0 and nothing taken. Rows of a null
    source are one source, the last. Repeated rows count each, and share their seeded number. A
    null key is a key like any other. Columns of ``docs`` named like a result are replaced by it.
    An empty table gives an empty result. All sums fold in each task before the shuffle; texts are
    not shuffled. Reruns agree, however the rows are partitioned.
    """
    given = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    own = free_prefix(docs)
    bin_ = F.floor(_seeded(F.col(key), "order") / (2**32 // BINS)).alias(f"{own}bin")
    sized = docs.select(*[F.col(c) for c in given], word_count(F.col(text)).alias("size"), bin_)
    bins = sized.groupBy(F.col(source).alias("source"), F.col(f"{own}bin").alias("bin")).agg(F.sum("size").alias("words"))
    bins = materialize(bins, "mix-bins")
    aims = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, most_epochs)
    plan = materialize(_cuts(bins, aims), "mix-plan")
    plan = plan.withColumnsRenamed({c: f"{own}{c}" for c in ("source", "whole", "cut", "share")})
    out = sized.join(plan, F.col(source).eqNullSafe(F.col(f"{own}source")), "left")
    here, cut = F.col(f"{own}bin"), F.col(f"{own}cut")
    rounded = F.floor(F.col("size") * F.col(f"{own}share") + _seeded(F.col(key), "round") / 2.0**32)
    extra = F.when(here < cut, F.col("size")).when(here == cut, F.least(F.col("size"), rounded)).otherwise(0)
    taken = (F.col("size") * F.col(f"{own}whole") + extra).cast("bigint")
    return out.select(*given, "size", "source_size", "target", taken.alias("taken"))


def _cuts(bins: DataFrame, aims: DataFrame) -> DataFrame:
    """Per source: whole repetitions, the bin at the border, and the share taken of that bin."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = aims.select(F.col("source").alias("of"), "source_size", "target", whole.cast("bigint").alias("whole"))
    aims = aims.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy("of").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = bins.join(aims, F.col("source").eqNullSafe(F.col("of"))).withColumn("upto", F.sum("words").over(upto))
    border = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bin", "upto", "words")))
    cut = filled.groupBy("of", "source_size", "target", "whole", "rest").agg(border.alias("border"))
    share = (F.col("rest") - (F.col("border.upto") - F.col("border.words"))) / F.col("border.words")
    return cut.select(
        F.col("of").alias("source"), "source_size", "target", "whole",
        F.coalesce(F.col("border.bin"), F.lit(BINS)).alias("cut"),
        F.coalesce(share, F.lit(0.0)).alias("share"),
    )


def repeated(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``mix`` written out: every text as often as it is taken whole, and once more
    cut to its first words, joined by blanks, if a part of it is left to take. Rows of
    which nothing is taken go."""
    whole, part = F.expr("cast(taken div size as int)"), F.expr("cast(taken % size as int)")
    copies = F.array_repeat(F.lit(None).cast("int"), whole)
    copies = F.when(part > 0, F.concat(copies, F.array(part))).otherwise(copies)
    left = f"{free_prefix(mixed)}words"
    out = mixed.where("taken > 0").withColumn(left, F.explode(copies))
    cut = F.array_join(F.slice(_words(F.col(text)), 1, F.col(left)), " ")
    shown = F.when(F.col(left).isNull(), F.col(text)).otherwise(cut).alias(text)
    return out.select(*[shown if c == text else F.col(c) for c in mixed.columns])
