"""The learned operators: held-out accuracy, and the corners."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import secret_scan, toxicity

SF = "/root/testdata/sf0.01"
WORDS = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    found = toxicity.score_toxicity(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    toxic, clean = ([r for r in held if r.toxic == y] for y in (1, 0))
    assert toxic and clean
    above = np.mean([[(a.score > b.score) + (a.score == b.score) / 2 for b in clean] for a in toxic])
    assert above > 0.93
    assert np.mean([r.predicted for r in clean]) < 0.01
    kept = {r.doc_id for r in toxicity.not_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in toxicity.score_toxicity(docs, model).collect() if r.predicted == 0}


def test_held_out_labels_are_not_learned(docs, labels):
    flipped = labels.withColumn("toxic", F.when(toxicity.learnable(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    one, two = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert one.features == two.features and np.allclose(one.weights, two.weights) and one.bias == pytest.approx(two.bias)


def test_non_negative_risk():
    rng = np.random.default_rng(1)
    positive = np.hstack([np.ones((200, 1)), rng.integers(0, 2, (200, 9))])
    unlabelled = np.hstack([(rng.random((2000, 1)) < 0.2), rng.integers(0, 2, (2000, 9))]).astype(float)
    weights, bias = toxicity.fit_weights(positive, unlabelled, 0.2)
    score = 1 / (1 + np.exp(-(unlabelled @ weights + bias)))
    assert ((score > 0.5) == (unlabelled[:, 0] == 1)).all()


def test_toxicity_corners(spark, docs, labels):
    rows = [(None, "idiot"), (1, None), (2, ""), (3, "!? 12"), (4, "word " * 90_000), (4, "word " * 90_000)]
    odd = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, score string")
    model = toxicity.train(docs, labels)
    found = toxicity.score_toxicity(odd, model).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    nothing = toxicity.train(docs, labels.where("false"))
    assert toxicity.score_toxicity(odd, nothing).where("predicted = 1").count() == 0
    empty = toxicity.train(docs.where("false"), labels)
    assert toxicity.score_toxicity(docs.where("false"), empty).count() == 0
    ragged = labels.unionByName(labels.limit(3)).unionByName(spark.sql("select cast(null as bigint) doc_id, 1 quality, 1 toxic union all select 1L, null, null"))
    assert toxicity.train(docs, ragged).features


def test_held_out_secrets(spark, docs):
    """Findings of documents that the forest did not see are told apart."""
    seen = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, secret_scan.by_grammar())
    all_ = secret_scan.findings(docs, WORDS).select("doc_id", "start", secret_scan.by_grammar().alias("truth"))
    found = secret_scan.scan_secrets(docs, WORDS, labels=seen).join(all_, ["doc_id", "start"])
    held = found.where("truth is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()
    assert sum(r.truth for r in held) > 3
    assert np.mean([r.secret == bool(r.truth) for r in held]) > 0.98


def test_secret_positions(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in secret_scan.scan_secrets(docs, WORDS).collect():
        assert texts[r.doc_id][r.start : r.start + r.length] == r.value
        assert r.secret == (r.probability >= 0.5)


def test_secret_corners(spark, docs):
    rows = [(1, None, None), (2, "", "x"), (None, 'é token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"', None), (3, "a" * 200_000, "s")]
    odd = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, value int")
    found = {str(r.doc_id): r for r in secret_scan.scan_secrets(docs.select("doc_id", "text", "source").union(odd.select("doc_id", "text", "source")), WORDS).collect()}
    assert found["None"].secret and found["None"].start == 11 and found["None"].length == 40
    alone = secret_scan.scan_secrets(odd, WORDS, labels=F.lit(1)).collect()
    assert len(alone) == 2 and all(r.secret and r.probability is None for r in alone)
    assert secret_scan.scan_secrets(odd.where("false"), WORDS).count() == 0
