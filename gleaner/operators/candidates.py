"""From ranked channels to candidates: fusion, admission, neighbours, suppression of what was corrected."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, temporal, text
from . import index
from .index import positions

FUSION_K = 60
SEEDS = 24


def fuse(*channels: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: (query_id, memory_id, score, rank, in_0, in_1, ...), ties by first appearance."""
    marked = [c.select("query_id", "memory_id", "rank", F.lit(i).alias("channel")) for i, c in enumerate(channels)]
    flags = [F.max((F.col("channel") == i).cast("int")).cast("boolean").alias(f"in_{i}") for i in range(len(channels))]
    met = reduce(DataFrame.unionByName, marked).groupBy("query_id", "memory_id").agg(
        F.round(F.sum(1 / (FUSION_K + F.col("rank"))), 12).alias("score"), F.min(F.col("channel").cast("long") * 1_000_000_000 + F.col("rank")).alias("_seen"), *flags
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_seen")
    return met.withColumn("rank", F.row_number().over(order).cast("long")).drop("_seen")


def admit(fused: DataFrame, queries: DataFrame, memories: DataFrame) -> DataFrame:
    """Candidates of lexical (0), vector (1) and date (2) channels that may stay.

    Where terms matched anything, a row that only its vector brought must share a term with the query: only
    such rows meet their text, or its terms where ``memories`` has them as ``whole``.
    """
    any_term = F.max("in_0").over(Window.partitionBy("query_id"))
    rows = fused.withColumn("_sure", ~any_term | F.col("in_0") | F.col("in_2"))
    whole = F.col("whole") if "whole" in memories.columns else text.whole_terms(F.col("content"), F.col("search_text"))
    unsure = rows.where(~F.col("_sure")).join(queries.select("query_id", "terms"), "query_id").join(memories.select("memory_id", whole.alias("_whole")), "memory_id")
    kept = rows.where("_sure").select(*fused.columns).unionByName(unsure.where(text.overlapping(F.col("terms"), F.col("_whole"))).select(*fused.columns))
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("_r", F.row_number().over(order).cast("long")).select(*[c for c in fused.columns if c != "rank"], F.col("_r").alias("rank"))


def neighbours(seeds: DataFrame, memories: DataFrame, radius: int = 1, by_chunk: bool = True) -> DataFrame:
    """(query_id, memory_id, distance, seed_rank, inserted) around ``seeds`` (query_id, user_id, memory_id, rank).

    Positions are counted in the sessions of the seeds only. A row near several seeds keeps its least
    (distance, seed_rank); ``inserted`` is its place in order of first mention.
    """
    own = memories.join(seeds.select("memory_id").distinct(), "memory_id", "left_semi").select("user_id", "session_id").distinct()
    placed = positions(memories.join(own, ["user_id", "session_id"], "left_semi"), by_chunk)
    at = seeds.select("query_id", "user_id", "memory_id", (F.col("rank") - 1).alias("seed_rank")).join(placed, ["user_id", "memory_id"])
    at = at.select("query_id", "user_id", "session_id", "seed_rank", F.col("position").alias("_p"), F.explode(F.sequence(F.col("position") - radius, F.col("position") + radius)).alias("position"))
    near = at.join(placed, ["user_id", "session_id", "position"]).withColumn("distance", F.abs(F.col("position") - F.col("_p")))
    best = F.min(F.struct("distance", "seed_rank"))
    met = near.groupBy("query_id", "memory_id").agg(best.alias("b"), F.min(F.struct("seed_rank", "position")).alias("_i"))
    order = Window.partitionBy("query_id").orderBy("_i", "memory_id")
    return met.select("query_id", "memory_id", "b.distance", "b.seed_rank", F.row_number().over(order).cast("long").alias("inserted"))


def expand(candidates: DataFrame, queries: DataFrame, memories: DataFrame, seeds: int = SEEDS, radius: int = 1) -> DataFrame:
    """(query_id, memory_id, rank) with the neighbours of the first ``seeds`` candidates after all candidates."""
    first = candidates.where(F.col("rank") <= seeds).join(queries.select("query_id", "user_id"), "query_id")
    near = neighbours(first, memories, radius).join(candidates.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    count = candidates.groupBy("query_id").agg(F.max("rank").alias("_n"))
    order = Window.partitionBy("query_id").orderBy("inserted")
    added = near.join(count, "query_id").select("query_id", "memory_id", (F.col("_n") + F.row_number().over(order)).cast("long").alias("rank"))
    return candidates.select("query_id", "memory_id", "rank").unionByName(added)


def suppress(candidates: DataFrame, asked: DataFrame, markers: Sequence[str] = lexicon.UPDATE_MARKERS, share: float = 0.6, aside: float = 0.4) -> DataFrame:
    """``candidates`` without rows that a later correction of the same query supersedes.

    ``candidates`` holds query_id, memory_id, content, request_id, ordinal, row_id, occurred_at, created_at;
    ``asked`` (query_id, asked_terms) the terms of the question (null: not known). Where ``candidates`` has
    the columns of index.told(), they are used instead of the text (and of ``markers``). A row with a statement of
    its own that the question asks about is kept. One pass: a superseded correction still counts. Pairs are
    corrections by candidates of one query, both bounded by the channels' limits.
    """
    rows = candidates if "claims" in candidates.columns else candidates.join(
        index.told(candidates.select("memory_id", "content", F.lit("").alias("search_text")).dropDuplicates(["memory_id"]), markers), "memory_id"
    )
    rows = rows.select("query_id", "memory_id", "request_id", "ordinal", "row_id", "occurred_at", "created_at", F.col("brief").alias("terms"), "claims", "updates")
    newer = rows.where(F.col("updates") & (F.size("terms") > 0)).drop("claims", "updates")
    newer = newer.select("query_id", *(F.col(c).alias(f"n_{c}") for c in newer.columns if c != "query_id"))
    older = rows.where(F.size("terms") > 0).join(asked.select("query_id", "asked_terms"), "query_id")
    fields = ("occurred_at", "created_at", "request_id", "ordinal", "row_id")
    later = temporal.is_later({c: F.col(f"n_{c}") for c in fields}, {c: F.col(c) for c in fields})
    alike = F.size(F.array_intersect("n_terms", "terms")) / F.size("n_terms") >= share
    own = F.filter("claims", lambda c: (F.size(c) >= 2) & (F.size(F.array_intersect(c, F.col("n_terms"))) / F.size(c) < aside))
    protected = (F.size(own) > 0) & (F.col("asked_terms").isNull() | F.exists(own, lambda c: F.arrays_overlap(c, F.col("asked_terms"))))
    pairs = newer.join(older, "query_id").where((F.col("n_memory_id") != F.col("memory_id")) & later & alike)
    gone = pairs.where(~F.coalesce(protected, F.lit(False))).select("query_id", "memory_id").distinct()
    return candidates.join(gone, ["query_id", "memory_id"], "left_anti")
