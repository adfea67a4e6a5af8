"""Fill-in-the-middle against slices of Python strings."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import fill_middle
from millrace.llm.queries import QUERIES
from tests.conftest import SF

ODD = [
    "", "a", "ab", "💥", "a💥b\n\r\nc d\x85", "<P", "a<P>b", "<S>", "x<M>", "<<P", "S>M>", "$1 \\2 \\E\\Q (", "é" * 5000, "x\n" * 9000,
    "<", ">", "<S<P<M", "\x00a\x00", "a" * 4096, "b" * 4097, "￾\U0010ffff", "combining é",
]


def numbers(key):
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def brute(key, text, units=list):
    text = text or ""
    cut, (h1, h2, h3, h4) = units(text), numbers(key)
    n = len(cut)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (cut[:a], cut[a:b], cut[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def table(spark, rows):
    return spark.createDataFrame([(k, t, "x", 5) for k, t in rows], "doc_id bigint, text string, form string, _n int")


def test_cuts(spark):
    rows = [(100 * i + j, t) for i, t in enumerate(ODD) for j in range(12)] + [(None, "no key"), (1, None), (7, "twice"), (7, "twice")]
    made = fill_middle.fill_in_middle(table(spark, rows)).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert made.columns == ["doc_id", "text", "_n", "n", "form", "prefix_units", "middle_units", "output", "back"]
    found = made.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(table(spark, rows).where("false")).count() == 0


def test_one_long_text(spark):
    text = "long 💥 text\n" * 300_000
    (r,) = fill_middle.fill_in_middle(table(spark, [(3, text)])).collect()
    assert tuple(r)[3:] == brute(3, text)


def test_other_units(spark):
    words = r"(?:\S++\s*+|\s++)"
    rows = [(k, t) for k in range(40) for t in ("one two  three\nfour", "  led by blanks x", "word")]
    for r in fill_middle.fill_in_middle(table(spark, rows), unit=words).collect():
        assert tuple(r)[3:] == brute(r.doc_id, r.text, lambda t: re.findall(r"\S+\s*|\s+", t))


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 4097, 12288])
def test_counts(spark, size):
    row = spark.createDataFrame([("💥" * size,)], "text string").select(fill_middle.unit_count(F.col("text"))).first()
    assert row[0] == size


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    result = QUERIES["op12_fill_in_middle"](spark, SF)
    assert "Python" not in result._jdf.queryExecution().executedPlan().toString()
    found = {r[0]: tuple(r)[1:] for r in result.collect()}
    wanted = {k: brute(k, t) for k, t in texts.items()}
    assert found == {k: (*w[:4], sha(w[4]), sha(texts[k])) for k, w in wanted.items()}
