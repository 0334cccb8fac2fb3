"""Stored tables: one folder a table, one partition a batch, and a manifest that publishes whole batches.

Every table of a batch is written before the batch's manifest row; readers only see batches with a manifest
row. A batch that failed half way is never visible, and writing it again under the same name replaces what
it left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in {**TABLES, "manifest": "batch string"}.items():
            columns = schema if name == "manifest" else f"{schema}, batch string"
            spark.createDataFrame([], columns).write.mode("ignore").parquet(f"{self.path}/{name}")

    def batches(self) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{self.path}/manifest").distinct()

    def read(self, table: str) -> DataFrame:
        """Rows of published batches."""
        rows = self.spark.read.schema(f"{TABLES[table]}, batch string").parquet(f"{self.path}/{table}")
        return rows.join(self.batches(), "batch", "left_semi").drop("batch")

    def is_published(self, batch: str) -> bool:
        return not self.batches().where(F.col("batch") == batch).isEmpty()

    def publish(self, batch: str, tables: dict[str, DataFrame]) -> None:
        """Write all tables of a batch, then make it visible at once."""
        if "/" in batch or not batch:
            raise ValueError("a batch name is not empty and has no slash")
        for name, rows in tables.items():
            columns = [c.split()[0] for c in TABLES[name].split(", ")]
            rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    @classmethod
    def import_jdbc(cls, spark: SparkSession, url: str, table: str, connections: int = 8, **options: str) -> DataFrame:
        """A table of a relational store; ``connections`` bounds how many tasks read at once."""
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("numPartitions", connections)
        return reader.options(**options).load()


def vectors_from_json(rows: DataFrame, column: str = "vector") -> DataFrame:
    """Vectors kept as JSON text, as arrays of doubles."""
    return rows.withColumn(column, F.from_json(column, "array<double>"))
