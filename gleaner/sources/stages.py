"""Stage boundaries: a table in the folder that driver and executors share, computed once and read again.

Plans that use a stage's rows several times would compute them as often and grow with every use; a written
stage is a plain scan, and survives the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="gleaner-")
        sc.setCheckpointDir(folder)
    path = f"{sc.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
