"""The rows that the toxicity fit sees are bounded, whatever ids repeat."""

from pyspark.sql import functions as F

from millrace.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_repeated_ids_do_not_grow_the_sample(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").select("doc_id", c) for t, c in (("documents", "text"), ("labels", "toxic")))
    first = docs.where(toxicity.learnable(F.col("doc_id"))).orderBy("doc_id").first()
    copies = spark.range(500).select(F.lit(first.doc_id).alias("doc_id"), F.concat(F.lit("other "), "id").alias("text"))
    nulls = spark.createDataFrame([(first.doc_id, None)], "doc_id bigint, text string")
    hot = docs.unionByName(copies).unionByName(nulls)
    sample = toxicity._sample(hot, labels, "doc_id", "text", "toxic", 4_000, 8_000)
    ids = [r.id for r in sample.collect()]
    assert len(ids) == len(set(ids)) <= 1000 and first.doc_id in ids
    plain = toxicity._sample(docs, labels, "doc_id", "text", "toxic", 4_000, 8_000)
    assert sorted(r for r in plain.collect() if r.id != first.doc_id) == sorted(r for r in sample.collect() if r.id != first.doc_id)
    bounded = toxicity._sample(hot, labels, "doc_id", "text", "toxic", 10, 20)
    assert bounded.count() <= 30
