"""Short, punctuated and all-letter secrets after a word that announces them."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import secret_scan

WORDS = public_tokenizers.path("byte_bpe_50k.json")
LONG = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"


@pytest.mark.parametrize("text, values", [
    ('password = "abcd"', ["abcd"]),
    ("pwd: p@ss!#$%&*:1, next", ["p@ss!#$%&*:1"]),
    ("{'passwd': 'a b\\'c'}", ["a b\\'c"]),
    ('{"api_key": "x1"}; token "T-9"', ["x1", "T-9"]),
    ("PASSWORD=hunter2\nmore", ["hunter2"]),
    ('password = "correcthorsebattery"', ["correcthorsebattery"]),
    (f"token = \"{LONG}\" and {LONG}", [LONG, LONG]),
    (f"secret: a$b-{LONG}!", [f"a$b-{LONG}!"]),
    (f'secret: "see {LONG} there"', [f"see {LONG} there", LONG]),
    ("password: token: x", ["token:", "x"]),
    ('password = "" and the password is lost', []),
])
def test_candidates(text, values):
    assert [text[a:b] for a, b in secret_scan.candidates(text)] == values


def test_announced_secrets_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    planted = ["password = \"correcthorsebattery\"", "pwd = 'x7#k'", "passwd: S3cr!t*9:z", "secret = \"hunter2hunter2\""]
    rows = spark.createDataFrame([(-1 - i, f"some words before {t}\nand some after", "src1") for i, t in enumerate(planted)], docs.schema)
    all_ = docs.unionByName(rows)
    found = {r.doc_id: r for r in secret_scan.scan_secrets(all_, WORDS).where("doc_id < 0").collect()}
    assert [found[-1 - i].value for i in range(4)] == ["correcthorsebattery", "x7#k", "S3cr!t*9:z", "hunter2hunter2"]
    assert all(r.secret for r in found.values())
    labels = secret_scan.findings(rows, WORDS).select("doc_id", secret_scan.by_grammar().alias("label")).where(F.col("doc_id") == -1)
    assert labels.first().label is None


@pytest.mark.parametrize("unit", ["token=", "token=\xa0", "token='", 'token="x ', "password: token:", "token=,,,,,,", "secret=\\\"", "pwd "])
def test_long_runs_take_time_in_proportion(unit):
    """A megabyte of leads, of each kind: what is found is no longer than a few times the text."""
    text = unit * (1_000_000 // len(unit)) + "a"
    found = secret_scan.candidates(text)
    assert sum(b - a for a, b in found) <= 3 * len(text)
    assert all(text[a:b] for a, b in found)
    commas = "token=" + "," * 1_000_000 + "a"
    assert secret_scan.candidates(commas) == [(6, len(commas))]


@pytest.mark.parametrize("text, values", [
    ("secret=a1\xa0token=b2", ["a1", "b2"]),
    ("see ?token=abc&secret=def, there", ["abc&secret=def"]),
    ('secret: "one token=abc two"', ["one token=abc two", "abc"]),
    ("pwd=x'];", ["x"]),
    ("pwd=;;", [";"]),
])
def test_leads_within_values(text, values):
    assert [text[a:b] for a, b in secret_scan.candidates(text)] == values


def test_a_repeated_finding_takes_one_place(spark):
    rows = [([1.0, 2.0], 0)] * 3000 + [([float(i), 0.0], i % 2) for i in range(100)]
    labelled = spark.createDataFrame(rows, "features array<double>, label int")
    found = secret_scan.sampled(labelled, 60).collect()
    assert len(found) == len({(tuple(r.features), r.label) for r in found}) == 101
    assert max(r.weight for r in found) == 3000 and sum(r.weight for r in found if r.label == 1) == 50
    assert sum(r.label == 0 for r in secret_scan.sampled(labelled, 7).collect()) == 7
