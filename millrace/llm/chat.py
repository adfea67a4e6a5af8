"""Chat formatting of the longest state of each logged conversation. DataFrame functions only.

Chat logs often hold a conversation many times, as it grew. The rolling hash of a turn prefix
identifies what was said up to a turn; a conversation whose whole hash is a proper prefix of
another's is a snapshot of it and goes, by an anti-join. Of equal conversations one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.groups import Heat
from ..operators.windows import running

#: The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What begins a mark, with the backslashes that escape it already: one more goes before its bar.
BEGINS, ESCAPED = r"<(\\*)\|", r"<\\$1|"
#: Turns written into one row of text. A conversation of more turns takes several rows, so
#: that no row and no group grows with the longest conversation.
SEGMENT_TURNS = 256


def _filled(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BEGINS, ESCAPED)


def _hash(purpose: str) -> Column:
    """Of one turn at its place; a null differs from an empty text. As a decimal, so that sums are exact."""
    said = [F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in (F.col("_role"), F.col("_text"))]
    return F.xxhash64(F.lit(purpose), F.col("_place"), *said).cast("decimal(20,0)")


ORDER = ["_turn", "_role", "_text"]
SAME = ["_place", "_low", "_high"]


def prefixes(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows of ``turns`` with their place (from 1) and the hash of the conversation up to them.

    Each turn's hash depends on its place, so the hash of a prefix is the sum of its turns' and
    rolls along, in two halves. Running sums cut a very long conversation into parts.
    """
    rows = turns.select(
        F.col(conversation).alias("_conv"), F.col(turn).alias("_turn"),
        F.col(role).cast("string").alias("_role"), F.col(text).cast("string").alias("_text"),
    )
    heat = Heat.found(rows, ["_conv"])
    placed = running(rows, ["_conv"], ORDER, {"_place": F.lit(1).cast("bigint")}, heat)
    hashed = placed.withColumns({"_one": _hash("low"), "_two": _hash("high")})
    return running(hashed, ["_conv"], ORDER, {"_low": F.col("_one"), "_high": F.col("_two")}, heat).drop("_one", "_two")


def maximal(prefixed: DataFrame) -> DataFrame:
    """(_conv): the conversations that are no proper prefix of another, and of equal ones the smallest.

    A prefix goes on somewhere if more conversations have it than end with it. One that
    any number of conversations share folds before it is shuffled.
    """
    ends = prefixed.groupBy("_conv").agg(F.max_by(F.struct(*SAME), F.col("_place")).alias("_end"))
    whole = ends.groupBy(*[F.col(f"_end.{c}").alias(c) for c in SAME]).agg(
        F.min("_conv").alias("_conv"), F.count(F.lit(1)).alias("_ends")
    )
    held = prefixed.groupBy(*SAME).agg(F.count(F.lit(1)).alias("_all"))
    grown = held.join(whole, SAME).where(F.col("_all") > F.col("_ends")).select(*SAME)
    return whole.join(grown, SAME, "left_anti").select("_conv")


def chat_texts(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    segment_turns: int = SEGMENT_TURNS,
) -> DataFrame:
    """(``conversation``, segment, n_turns, text): the maximal conversations, rendered.

    A conversation of up to ``segment_turns`` turns is one row, segment 0; the texts of a longer
    one, in the order of their segments, make up its whole. Turns are ordered by turn, then role,
    then text, nulls first, so ties have one order and repeated rows are repeated turns. Null
    roles and texts are written as empty. What would read as a mark in a role or text is escaped: ``<|`` is written
    as ``<\\|``, and one backslash more is put where there are some between the two, so no turn can be forged and
    taking one backslash away restores every text. Rows of a null conversation are one
    conversation, the largest among equal ones. An empty table gives an empty result.
    """
    prefixed = prefixes(turns, conversation, turn, role, text)
    kept = maximal(prefixed).select(F.col("_conv").alias("_kept"))
    said = F.concat(F.lit(OPEN), _filled(F.col("_role")), F.lit("\n"), _filled(F.col("_text")), F.lit(f"{CLOSE}\n"))
    rows = prefixed.join(kept, F.col("_conv").eqNullSafe(F.col("_kept")), "left_semi").select(
        "_conv", F.floor((F.col("_place") - 1) / segment_turns).alias("segment"), "_place", said.alias("_said")
    )
    return (
        rows.groupBy("_conv", "segment")
        .agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("_place", "_said"))).alias("_turns"))
        .select(
            F.col("_conv").alias(conversation),
            "segment",
            "n_turns",
            F.array_join(F.col("_turns._said"), "").alias("text"),
        )
    )
