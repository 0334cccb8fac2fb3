"""JSON-lines sources and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import schemas


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Write requests from JSON lines; blank lines are skipped."""
    return spark.read.schema(schemas.REQUEST).json(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records from JSON lines."""
    return spark.read.schema(schemas.PANEL).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)
