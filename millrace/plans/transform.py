"""One SQL query over the named views of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .spec import Source, SpecError, Transformation


def _from_file(spark: SparkSession, path: str) -> str:
    # One whole small text, through Spark so that any file system works.
    return spark.read.text(path, wholetext=True).first()[0]


def resolve_sql(spark: SparkSession, transformation: Transformation) -> str:
    """The query text: FILE reads its path; INLINE, or nothing, prefers the content given."""
    kind = (transformation.type or "INLINE").upper()
    if kind not in ("INLINE", "FILE"):
        raise SpecError(f"transformation type {transformation.type!r} is neither INLINE nor FILE")
    if kind == "INLINE" and transformation.sql_content:
        return transformation.sql_content
    if transformation.sql_file_path:
        return _from_file(spark, transformation.sql_file_path)
    if kind == "FILE":
        raise SpecError("a FILE transformation needs sqlFilePath")
    raise SpecError("the job has no SQL: give sqlContent or sqlFilePath")


def register(source: Source, df: DataFrame) -> None:
    """A view under the source's table name, and a second one under its alias."""
    for name in (source.table_name, source.alias):
        if name:
            df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, transformation: Transformation) -> DataFrame:
    result = spark.sql(resolve_sql(spark, transformation))
    result.createOrReplaceTempView(transformation.result_table_name)
    return result
