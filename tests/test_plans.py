"""What the plans must and must not contain."""

import os
import re

import pytest

from millrace.coverage import QUERIES
from tests.conftest import SF

RUNS_STREAMS = [n for n in QUERIES if n.startswith(("stream_", "job_", "late_"))]
INGEST = ["sql_filter", "ingest_json_valid", "ingest_json_rejected", "ingest_avro_json", "dlq_envelope", "stage_counts"]


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in RUNS_STREAMS])
def test_no_cross_joins_and_no_python_per_row(spark, name):
    text = plan(spark, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in text


@pytest.mark.parametrize("name", INGEST)
def test_a_message_is_parsed_once(spark, name):
    assert plan(spark, name).count("parseJson(") == 1


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "filter_compound")
    assert "PushedFilters: [" in text and "Or(" in text and "IsNotNull(props)" in text
    narrow = plan(spark, "agg_distinct")
    read = re.search(r"ReadSchema: struct<([^>]*)>", narrow)[1]
    assert {c.split(":")[0] for c in read.split(",")} == {"l_partkey", "l_suppkey", "l_returnflag"}


def test_top_n_is_cut_before_the_shuffle(spark):
    text = plan(spark, "topn_per_group")
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    assert "TakeOrderedAndProject" in plan(spark, "sort_limit")


def test_dedup_reads_and_keeps_only_what_it_needs(spark):
    text = plan(spark, "dedup_keep_last")
    assert text.count("WindowGroupLimit") == 2 and "props" not in text
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


def test_messages_are_written_without_patterns_and_read_once(spark):
    text = plan(spark, "ser_json")
    assert text.count("from_json(") == 1 and "regexp" not in text and "get_json_object" not in text


def test_unions_are_told_without_a_map(spark):
    assert "mapfromentries" not in plan(spark, "ingest_avro_json").lower() and "map_keys" not in plan(spark, "ingest_avro_json")


def test_unused_messages_are_not_carried(spark):
    """Only rejects need the text of a message; the view of accepted rows drops it."""
    text = plan(spark, "ingest_json_valid")
    assert "raw#" not in text.split("Generate", 1)[1].splitlines()[0]


@pytest.mark.parametrize("name", ["agg_basic", "tumble_count", "join_left", "join_right", "recon_records", "stage_counts"])
def test_aggregates_fold_before_the_shuffle(spark, name):
    below = plan(spark, name).split("Exchange hashpartitioning", 1)[1]
    assert "partial_" in below


def test_no_local_checkpoints_or_driver_side_data():
    """Nothing in the library pins data to an executor or pulls whole tables to the driver."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "millrace")
    for folder, folders, files in os.walk(root):
        folders[:] = [f for f in folders if f != "llm"]  # has bounded samples, and tests of its own
        for name in files:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name)).read()
                for word in ("localCheckpoint", ".collect()", "toPandas", "crossJoin", ".rdd", "broadcast("):
                    assert word not in text, f"{word} in {name}"
