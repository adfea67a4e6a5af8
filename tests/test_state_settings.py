"""How the state of streams is kept."""

import datetime as dt
import os

from pyspark.sql import functions as F

from millrace.operators.joins import asof_within
from millrace.session import fresh_path
from millrace.streaming import event_time


def test_a_stream_join_has_one_store_for_each_partition(spark):
    """And its stores do not read a row before each write, only to count rows."""
    base, start = fresh_path(spark, "stores"), dt.datetime(2024, 1, 1)
    rows = [(i % 3, start + dt.timedelta(minutes=i), i) for i in range(30)]
    spark.createDataFrame(rows, "k int, at timestamp, id int").write.parquet(f"{base}/in")

    def side(name):
        stream = spark.readStream.schema("k int, at timestamp, id int").parquet(f"{base}/in")
        timed = event_time.with_watermark(stream, "at", 1000)
        return timed.select("k", F.col("at").alias(f"{name}_at"), F.col("id").alias(f"{name}_id"))

    found = asof_within(side("l"), side("r"), ["k"], "l_at", "r_at", ["r_id"], 600)
    started = found.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint")
    started.outputMode("append").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    state = f"{base}/checkpoint/state".removeprefix("file:")
    inside = [name for _, folders, _ in os.walk(state) for name in folders]
    assert inside and not [name for name in inside if "keyWithIndexToValue" in name or "keyToNumValues" in name]
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows") == "false"
    got = spark.read.parquet(f"{base}/out")
    assert got.count() and got.where("l_id <> r_id").count() == 0
