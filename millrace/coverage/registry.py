"""Named coverage queries: a Spark plan over the given tables and, mostly, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.spec import Transformation
from ..plans.transform import run_sql
from ..session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a plan under ``name``; ``oracle`` is the same question in plain SQL."""

    def add(plan: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plan(prepare(spark), folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return plan

    return add


def sql_query(name: str, tables: str, text: str, oracle: str | None = None) -> None:
    """Registers user SQL over named views, run by the transformation layer as it stands."""

    def plan(spark: SparkSession, folder: str) -> DataFrame:
        for view in tables.split():
            table(spark, folder, view).createOrReplaceTempView(view)
        return run_sql(spark, Transformation(sql_content=text))

    query(name, oracle or text)(plan)
