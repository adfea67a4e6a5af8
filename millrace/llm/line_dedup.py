"""Boilerplate lines by their frequency within a site. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_prefix

#: A line on more than this share of a site's pages is boilerplate,
RATIO = 0.1
#: unless it is on one page alone: on a small site every line would be frequent.
LEAST_PAGES = 2

#: For sources of documents, which are larger than web hosts: boilerplate is also a line on more than this share of
#: a source's different texts, if at least so many of them hold it.
SOURCE_RATIO, LEAST_TEXTS = 0.01, 10
#: By ``RATIO``, such a source's lines go from so many documents on.
LEAST_DOCUMENTS = 5
#: A line of more words than this is a passage. Of so many different texts or more, of whatever source, that hold
#: it, one keeps it. In two texts it stays: one of two near-copies without it would not be alike any more.
PASSAGE_WORDS, PASSAGE_TEXTS = 50, 3

#: What does not end up as text on a page, and what ends a line there.
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
TAG = r"<[^>]*>"
HOST = r"^[a-zA-Z]+://([^/?#]*)"


def page_text(html: Column) -> Column:
    """The text of a page, a line per element; entities stay as they are."""
    return F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), TAG, "\n")


def host(url: Column) -> Column:
    """The host of an address; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _same(line: Column) -> Column:
    """Lines are the same if they are equal but for blanks around them."""
    return F.unhex(F.md5(F.trim(line)))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def boilerplate(
    docs: DataFrame,
    site: str,
    text: str,
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    text_ratio: float | None = None,
    least_texts: int = LEAST_TEXTS,
) -> DataFrame:
    """(site, _lines): digests of the lines to drop, for sites that have any.

    With ``text_ratio``, also lines on more than this share of a site's different texts, and on
    ``least_texts`` of them at least: copies of a text do not make its lines frequent. A site has fewer of them than its mean lines per page divided by the ratio, so the
    array is small whatever the size of the site. Counting folds in every task before
    the shuffle: one row per site and line leaves it, however many pages hold the line.
    """
    here = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: F.trim(x) != ""), _same))
    one = F.lit(1).cast("bigint")
    if text_ratio is None:
        read = docs.select(F.col(site).alias("_site"), here.alias("_here"), one.alias("_copies"))
    else:
        read = docs.select(F.col(site).alias("_site"), _digest(F.col(text)).alias("_text"), here.alias("_here"))
        read = materialize(read.groupBy("_site", "_text", "_here").agg(F.count(one).alias("_copies")), "texts")
    holding = read.select("_site", "_copies", F.explode("_here").alias("_line"))
    holding = holding.groupBy("_site", "_line").agg(F.sum("_copies").alias("_pages"), F.count(one).alias("_texts"))
    pages = read.groupBy(F.col("_site").alias("_of")).agg(F.sum("_copies").alias("_total"), F.count(one).alias("_all"))
    often = (F.col("_pages") >= least_pages) & (F.col("_pages") > F.lit(ratio) * F.col("_total"))
    if text_ratio is not None:
        often |= (F.col("_texts") >= least_texts) & (F.col("_texts") > F.lit(text_ratio) * F.col("_all"))
    enough = F.col("_pages") >= (least_pages if text_ratio is None else min(least_pages, least_texts))
    frequent = holding.where(enough).join(pages, F.col("_site").eqNullSafe(F.col("_of")))
    dropped = frequent.where(often)
    return dropped.groupBy("_site").agg(F.collect_list("_line").alias("_lines"))


def drop_boilerplate(
    docs: DataFrame,
    site: str,
    text: str,
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    text_ratio: float | None = None,
    least_texts: int = LEAST_TEXTS,
) -> DataFrame:
    """``docs`` with the boilerplate lines of its site taken out of ``text``.

    Rows of a null ``site`` are one site. Null texts stay null; they and empty texts count as
    pages. Blank lines are never dropped. Repeated rows are pages like any other. Other columns
    pass unchanged. The lists of lines to drop are written first, so that the join can broadcast
    them if, and only if, their size is known to be small.
    """
    own = free_prefix(docs)
    lists = materialize(
        boilerplate(docs, site, text, ratio, least_pages, text_ratio, least_texts), "boilerplate"
    ).toDF(f"{own}site", f"{own}lines")
    joined = docs.join(lists, F.col(site).eqNullSafe(F.col(f"{own}site")), "left")
    return _without(joined, docs.columns, text, f"{own}lines")


def _without(joined: DataFrame, columns: list[str], text: str, lines: str) -> DataFrame:
    """``columns`` of ``joined``, their ``text`` without the lines whose digests are in ``lines``."""
    kept = F.array_join(F.filter(_lines(F.col(text)), lambda x: ~F.array_contains(F.col(lines), _same(x))), "\n")
    cleaned = F.when(F.col(lines).isNull(), F.col(text)).otherwise(kept).alias(text)
    return joined.select(*[F.col(c) for c in columns if c != text], cleaned).select(*columns)


def drop_passages(docs: DataFrame, text: str, words: int = PASSAGE_WORDS, texts: int = PASSAGE_TEXTS) -> DataFrame:
    """``docs`` without the lines of more than ``words`` words that ``texts`` different texts or more hold,
    except in one of them: the one of the smallest digest, with its copies.

    A repeat within a text goes or stays with it. Other columns pass unchanged. Null texts stay null.
    """
    own = free_prefix(docs)
    # A line of n words has at least n letters and n - 1 blanks.
    long = lambda x: (F.length(x) > 2 * words) & (F.size(F.split(F.trim(x), r"\s+")) > words)
    here = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), long), _same))
    holding = docs.select(_digest(F.col(text)).alias("_text"), F.explode(here).alias("_line"))
    often = holding.distinct().groupBy("_line").agg(F.count(F.lit(1)).alias("_texts"), F.min("_text").alias("_first"))
    often = materialize(often.where(F.col("_texts") >= texts).select("_line", "_first"), "passages")
    gone = holding.distinct().join(often, "_line").where("_text <> _first")
    gone = gone.groupBy(F.col("_text").alias(f"{own}text")).agg(F.collect_list("_line").alias(f"{own}lines"))
    gone = materialize(gone, "passages")
    return _without(docs.join(gone, _digest(F.col(text)) == F.col(f"{own}text"), "left"), docs.columns, text, f"{own}lines")
