"""Fill-in-the-middle transformation by one counted-quantifier match. DataFrame functions only.

A text of n units is cut at two places a <= b. A pattern made for the row takes exactly a
units, then b - a, then the rest; its quantifiers are possessive, so the match runs once over
the text and never backs up, and its three groups are put in their new order by the same match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One code point; ``.`` in this mode takes line ends too.
CODE_POINT = "(?s:.)"
#: Units counted at a time, so that counting makes few and short-lived objects.
TOGETHER = 4096

PLAIN_PERCENT, SPM_PERCENT = 10, 20


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def _pattern(*parts: Column | str) -> Column:
    """A pattern for the whole text of a row."""
    return F.concat(F.lit("\\A"), *map(_text, parts), F.lit("\\z"))


def _times(unit: str, count: Column) -> Column:
    return F.concat(F.lit(f"(?:{unit}){{"), count.cast("string"), F.lit("}+"))


def unit_count(text: Column, unit: str = CODE_POINT) -> Column:
    """How many units a text holds, counted from left to right: full runs of ``TOGETHER``, then the rest."""
    runs = F.regexp_count(text, F.lit(f"(?:{unit}){{{TOGETHER}}}+"))
    rest = F.regexp_replace(text, _pattern(_times(unit, runs * TOGETHER), "((?s:.)*+)"), F.lit("$1"))
    return (runs * TOGETHER + F.regexp_count(F.when(runs > 0, rest).otherwise(text), F.lit(unit))).cast("bigint")


def draws(key: Column, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers of a row, from a hash of ``seed`` and its key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = CODE_POINT, seed: str = "1",
    plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """``docs`` with n (units), form, prefix_units, middle_units and output beside.

    ``form`` is plain (the text as it is), psm (prefix, suffix, middle) or spm (suffix, prefix,
    middle); prefix_units and middle_units are null where it is plain. Empty texts, texts that hold a
    mark, and ``plain_percent`` of the others stay plain. ``unit`` is a pattern that matches any text
    from its start to its end when repeated, and never needs to give back a character. A null text
    counts as empty, a null key draws as an empty one. Equal rows have equal results. Columns of
    ``docs`` with a result's name are replaced. An empty table gives an empty result.
    """
    own = free_prefix(docs)
    n, a, b, form, content = (f"{own}{x}" for x in ("n", "a", "b", "form", "text"))
    h = draws(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)
    rows = docs.withColumn(content, F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.withColumn(n, unit_count(F.col(content), unit))
    cuts = [h[i] % (F.col(n) + 1) for i in range(2)]
    marked = F.col(content).contains(PREFIX) | F.col(content).contains(SUFFIX) | F.col(content).contains(MIDDLE)
    plain = (F.col(content) == "") | marked | (h[2] % 100 >= 100 - plain_percent)
    rows = rows.withColumns({
        a: F.least(*cuts), b: F.greatest(*cuts),
        form: F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm"),
    })
    moved = {
        "psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2",
        "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2",
    }
    order = F.when(F.col(form) == "psm", moved["psm"]).otherwise(moved["spm"])
    cut = _pattern("(", _times(unit, F.col(a)), ")(", _times(unit, F.col(b) - F.col(a)), ")((?s:.)*+)")
    output = F.when(F.col(form) == "plain", F.col(content)).otherwise(F.regexp_replace(content, cut, order))
    whole = F.col(form) != "plain"
    results = {
        "n": F.col(n), "form": F.col(form), "prefix_units": F.when(whole, F.col(a)),
        "middle_units": F.when(whole, F.col(b) - F.col(a)), "output": output,
    }
    kept = [F.col(c) for c in docs.columns if c.lower() not in results]
    return rows.select(*kept, *[c.alias(name) for name, c in results.items()])


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of.

    The text holds no mark, and a mark can not begin inside another, so each is found where it was put.
    """
    part = "((?s:.)*?)"
    psm = F.regexp_replace(output, F.lit(f"\\A{PREFIX}{part}{SUFFIX}{part}{MIDDLE}((?s:.)*+)\\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"\\A{SUFFIX}{part}{PREFIX}{part}{MIDDLE}((?s:.)*+)\\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
