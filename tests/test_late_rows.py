"""Late rows are counted over all batches, however few progress records the session keeps."""

import pytest
from pyspark.sql import functions as F

from millrace.streaming import event_time
from millrace.streaming.progress import dropped_late
from tests.conftest import SF

RING = "spark.sql.streaming.numRecentProgressUpdates"


@pytest.fixture
def small_ring(spark):
    spark.conf.set(RING, "2")
    yield
    spark.conf.unset(RING)


def test_more_batches_than_records(spark, tmp_path, small_ring):
    source = tmp_path / "in"
    batches = [["01:00:00"], ["01:00:01"], *[[f"00:00:{i:02}", f"00:01:{i:02}", f"01:00:{i + 2:02}"] for i in range(6)]]
    for i, times in enumerate(batches):
        folder = source / f"{i}"
        folder.mkdir(parents=True)
        (folder / "part.txt").write_text("".join(f"2024-01-01 {t}\n" for t in times))
    stream = spark.readStream.option("maxFilesPerTrigger", "1").text(f"{source}/*").select(F.to_timestamp("value").alias("at"))
    once = event_time.with_watermark(stream, "at", 5000).dropDuplicatesWithinWatermark(["at"])
    query = (
        once.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert len(query.recentProgress) <= 2
    kept = spark.read.parquet(str(tmp_path / "out")).count()
    assert (kept, dropped_late(query)) == (8, 12)


def test_the_query_has_more_batches_than_records(spark, small_ring):
    import __spark_entry__ as contract

    wanted = contract.queries()["late_rows"](spark, SF).first()
    spark.conf.set(RING, "1")
    assert contract.queries()["late_rows"](spark, SF).first() == wanted and wanted.dropped > 0
