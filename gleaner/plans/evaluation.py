"""Retrieval evaluation over a panel of records with questions and expected evidence."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from .engine import Engine


def matches(found_ids: Column, found_text: Column, evidence: Column, evidence_ids: Column) -> Column:
    """Whether an expected id was returned, or an expected text stands in the returned one."""
    none = F.array().cast("array<string>")
    by_id = F.arrays_overlap(found_ids, F.coalesce(evidence_ids, none))
    by_text = F.exists(F.coalesce(evidence, none), lambda e: (e != "") & F.contains(found_text, e))
    return F.coalesce(by_id, F.lit(False)) | F.coalesce(by_text, F.lit(False))


def panel_requests(panel: DataFrame) -> DataFrame:
    """Each record's memories as one request of user turns without times."""
    said = F.coalesce("messages", F.when(F.col("memory").isNotNull(), F.array("memory")))
    turns = F.transform(said, lambda m: F.struct(F.lit("user").alias("role"), m.alias("content"), F.lit(None).cast("bigint").alias("timestamp")))
    return panel.where(F.size(said) > 0).select(
        F.concat(F.lit("eval-"), F.col("record")).alias("request_id"),
        F.coalesce("user_id", "history_id", F.concat(F.lit("user-"), F.col("record"))).alias("user_id"),
        F.coalesce("session_id", F.concat(F.lit("session-"), F.col("record"))).alias("session_id"),
        turns.alias("messages"),
    )


def evaluate(engine: Engine, panel: DataFrame, top_k: int = 10) -> DataFrame:
    """One row: records, scored_questions, hits, hit_rate, batch_seconds. The whole panel is one batch."""
    panel = panel.withColumn("record", F.sha2(F.to_json(F.struct(*panel.columns)), 256))
    engine.add(panel_requests(panel), batch=f"panel-{uuid.uuid4().hex}")
    asked = panel.withColumn("query", F.coalesce("question", "query")).where("query IS NOT NULL")
    queries = asked.select(
        F.col("record").alias("query_id"),
        F.coalesce("user_id", "history_id", F.concat(F.lit("user-"), F.col("record"))).alias("user_id"),
        "query",
        F.lit(None).cast("array<string>").alias("options"),
        F.lit(top_k).alias("top_k"),
    )
    started = time.perf_counter()
    items = engine.search_batch(queries.dropDuplicates(["query_id"]))
    found = items.groupBy("query_id").agg(F.collect_list("id").alias("ids"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda s: s["content"]), " ").alias("told"))
    none = F.array().cast("array<string>")
    hit = matches(F.coalesce("ids", none), F.coalesce("told", F.lit("")), F.col("evidence"), F.col("evidence_ids"))
    judged = asked.join(found, asked.record == found.query_id, "left").select(hit.cast("int").alias("hit"))
    report = judged.agg(F.count("*").alias("scored_questions"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), metrics.mean(F.col("hit")).alias("hit_rate"))
    row, records = report.first(), panel.count()
    spent = time.perf_counter() - started
    return engine.spark.createDataFrame([(records, *row, spent)], "records bigint, scored_questions bigint, hits bigint, hit_rate double, batch_seconds double")
