"""Scores and selection: the weighted rule, reranker merge, session diversity, windows, packing, output."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, temporal, text
from . import index
from .candidates import neighbours

WEIGHTS = {"terms": 0.40, "place": 0.16, "expansion": 0.12, "options": 0.10, "phrase": 0.06}
TIME_WEIGHT, UPDATE_BONUS, DAY_BONUS = 0.16, 0.05, 0.25
RERANK_POOL = 500


def time_score(occurred_at: Column, first: Column, last: Column, intent: Column, updated: Column, day: Column) -> Column:
    """What a row's time adds: its place between the first and the last, an update, the asked day."""
    ratio = (occurred_at - first) / F.when(last > first, last - first)
    place = F.when(intent == "latest", TIME_WEIGHT * ratio).when(intent == "earliest", TIME_WEIGHT * (1 - ratio))
    in_day = (occurred_at >= day["start"]) & (occurred_at < day["end"])
    return F.coalesce(place, F.lit(0.0)) + F.when((intent == "latest") & updated, UPDATE_BONUS).otherwise(0.0) + F.when(in_day, DAY_BONUS).otherwise(0.0)


def rule_rank(candidates: DataFrame, queries: DataFrame, markers=lexicon.UPDATE_MARKERS) -> DataFrame:
    """``candidates`` with the weighted score and their new rank.

    ``candidates`` (query_id, memory_id, rank, content, search_text, occurred_at), ``queries`` (query_id,
    bounded, terms, expansion, option_terms, intent, day). Ties go to the later row, then to the better
    candidate. Where ``candidates`` has ``held`` and ``updates`` of index.told(), no text is read for terms.
    """
    own = "held" in candidates.columns and "updates" in candidates.columns
    if not own:
        once = index.told(candidates.select("memory_id", "content", "search_text").dropDuplicates(["memory_id"]), markers)
        candidates = candidates.join(once.select("memory_id", "held", "updates"), "memory_id")
    rows = candidates.join(queries.select("query_id", "bounded", "terms", "expansion", "option_terms", "intent", "day"), "query_id")
    whole, order = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("_index", F.row_number().over(order) - 1).withColumn("_first", F.min("occurred_at").over(whole)).withColumn("_last", F.max("occurred_at").over(whole))
    held = F.col("held")
    score = (
        WEIGHTS["terms"] * text.covered(F.col("terms"), held)
        + WEIGHTS["place"] / (1 + F.col("_index"))
        + WEIGHTS["expansion"] * text.covered(F.array_except("expansion", "terms"), held)
        + WEIGHTS["options"] * text.covered(F.col("option_terms"), held)
        + WEIGHTS["phrase"] * text.phrase_bonus(F.col("bounded"), F.col("content"))
        + time_score(F.col("occurred_at"), F.col("_first"), F.col("_last"), F.col("intent"), F.col("updates"), F.col("day"))
    )
    rows = rows.withColumn("score", F.round(score, 12))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.coalesce("occurred_at", F.lit(0))), "rank")
    return rows.withColumn("rank", F.row_number().over(best).cast("long")).select(*[c for c in candidates.columns if own or c not in ("held", "updates")], "score")


def rerank(ranked: DataFrame, scored: DataFrame, pool: int = RERANK_POOL) -> DataFrame:
    """``ranked`` reordered by ``scored`` (query_id, memory_id, rerank_score) where that is complete and finite.

    Only the first ``pool`` rows of a query are scored by a model; rows behind them follow with score 0. A
    query with a missing or infinite score keeps its rule order and scores; ``reranked`` tells.
    """
    rows = ranked.join(scored.select("query_id", "memory_id", "rerank_score"), ["query_id", "memory_id"], "left")
    sound = F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score") & (F.abs("rerank_score") < float("inf"))
    whole = Window.partitionBy("query_id")
    rows = rows.withColumn("_in", F.col("rank") <= pool).withColumn("_ok", F.min(F.when(F.col("_in"), sound).otherwise(True)).over(whole))
    score = F.when(~F.col("_ok"), F.col("score")).when(F.col("_in"), F.col("rerank_score")).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("_ok") & F.col("_in"), 0).when(F.col("_ok"), 1).otherwise(0), F.when(F.col("_ok") & F.col("_in"), -F.col("rerank_score")), "rank")
    return rows.withColumn("_r", F.row_number().over(order).cast("long")).select(*[c for c in ranked.columns if c not in ("rank", "score")], score.alias("score"), F.col("_r").alias("rank"), F.col("_ok").alias("reranked"))


def diversify(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """The first ``limit`` rows of each query; for a summary over many sessions, distinct sessions first.

    ``ranked`` (query_id, memory_id, session_id, score, rank), ``queries`` (query_id, query, limit, intent).
    A session's first row counts if its score is near that at the limit; the rest fills up by rank. Ranks
    and scores stay as they are.
    """
    rows = ranked.join(queries.select("query_id", "query", "limit", "intent"), "query_id")
    whole = Window.partitionBy("query_id")
    spread = text.is_global_summary(F.col("query")) & (F.col("intent") == "none") & (text.temporal_intent(F.col("query")) == "none")
    rows = rows.withColumn("_n", F.count("*").over(whole))
    rows = rows.withColumn("_edge", F.max(F.when(F.col("rank") == F.col("limit"), F.col("score"))).over(whole))
    rows = rows.withColumn("_top", F.max(F.when(F.col("rank") == 1, F.col("session_id"))).over(whole))
    rows = rows.withColumn("_spread", spread & (F.col("limit") > 1) & (F.col("_n") > F.col("limit")))
    near = (F.col("score") >= F.greatest(F.col("_edge") * 0.75, F.col("_edge") - 0.15)) & (F.col("session_id") != F.col("_top"))
    own = Window.partitionBy("query_id", "session_id", F.coalesce(near, F.lit(False))).orderBy("rank")
    rows = rows.withColumn("_pick", F.when(~F.col("_spread") | (F.col("rank") == 1), True).otherwise(F.coalesce(near, F.lit(False)) & (F.row_number().over(own) == 1)))
    chosen = Window.partitionBy("query_id").orderBy(F.desc("_pick"), "rank")
    return rows.withColumn("_c", F.row_number().over(chosen)).where(F.col("_c") <= F.col("limit")).select(*ranked.columns)


def windows(selected: DataFrame, memories: DataFrame, radius: int = 1) -> DataFrame:
    """(query_id, memory_id, score, rank, context): each selected row with its session neighbours in source order."""
    keyed = selected.select(F.struct("query_id", "memory_id").alias("query_id"), "user_id", "memory_id", F.lit(1).cast("long").alias("rank"))
    near = neighbours(keyed, memories, radius).select("query_id.query_id", F.col("query_id.memory_id").alias("anchor"), "memory_id")
    row = F.struct(
        text.chunk_index(F.col("request_id")).alias("chunk"),
        F.coalesce("occurred_at", F.lit(0).cast("long")).alias("time"),
        F.col("ordinal").cast("long").alias("ordinal"),
        F.col("row_id").alias("row_id"),
        F.col("memory_id").alias("memory_id"),
        render_line(F.col("memory_id"), F.col("role"), F.col("occurred_at"), F.col("content")).alias("line"),
        F.col("created_at").alias("created_at"),
    )
    context = near.join(memories, "memory_id").groupBy("query_id", "anchor").agg(F.array_sort(F.collect_list(row)).alias("context"))
    return selected.select("query_id", "memory_id", "score", "rank").join(context.withColumnRenamed("anchor", "memory_id"), ["query_id", "memory_id"])


def render_line(memory_id: Column, role: Column, occurred_at: Column, content: Column) -> Column:
    time = F.coalesce(F.concat(F.lit(" | "), temporal.shown(occurred_at)), F.lit(""))
    return F.concat(F.lit("["), memory_id, F.lit(" | "), role, time, F.lit("] "), content)


def _tokens(line: str) -> int:
    cjk = sum("㐀" <= ch <= "䶿" or "一" <= ch <= "鿿" or "豈" <= ch <= "﫿" for ch in line)
    return cjk + (len(line) - cjk + 3) // 4


def _cut(line: str, most: int) -> str:
    if _tokens(line) <= most:
        return line
    low, high = 0, len(line)  # the longest prefix that leaves room for the dots; sizes never fall
    while low < high:
        n = (low + high + 1) // 2
        cjk = sum("㐀" <= ch <= "䶿" or "一" <= ch <= "鿿" or "豈" <= ch <= "﫿" for ch in line[:n])
        low, high = (n, high) if cjk + (n - cjk + 6) // 4 <= most else (low, n - 1)
    return line[:low].rstrip() + "..."


def pack(windowed: DataFrame, queries: DataFrame, max_tokens: int = 32_000, max_items: int = 100) -> DataFrame:
    """(query_id, place, source_id, score, content, source_ids) within a token budget for each query.

    ``windowed`` as from windows(), ``queries`` (query_id, top_k). Windows are taken by rank; lines that an
    earlier window gave are left out; a line that does not fit ends its window, cut short if it would be the
    first; later windows are still tried. A query has at most ``max_items`` windows, so its rows fit a task.
    """
    rows = windowed.join(queries.select("query_id", "top_k"), "query_id")

    def one(found: pd.DataFrame) -> pd.DataFrame:
        out, seen, used = [], set(), 0
        for row in found.sort_values("rank").itertuples(index=False):
            if len(out) >= min(row.top_k, max_items):
                break
            lines, ids = [], []
            for source in row.context:
                if source["memory_id"] in seen:
                    continue
                line = source["line"]
                if used + _tokens("\n".join([*lines, line])) > max_tokens:
                    if not lines and used + _tokens(short := _cut(line, max(1, max_tokens - used))) <= max_tokens:
                        lines, ids = [short], [source["memory_id"]]
                    break
                lines.append(line)
                ids.append(source["memory_id"])
            if lines:
                content = "\n".join(lines)
                used += _tokens(content)
                seen.update(ids)
                out.append((row.query_id, len(out) + 1, row.memory_id if row.memory_id in ids else ids[0], row.score, content, ids))
        return pd.DataFrame(out, columns=["query_id", "place", "source_id", "score", "content", "source_ids"])

    kind = windowed.schema["query_id"].dataType.simpleString()
    return rows.groupBy("query_id").applyInPandas(one, f"query_id {kind}, place bigint, source_id string, score double, content string, source_ids array<string>")


def emit(packed: DataFrame, memories: DataFrame) -> DataFrame:
    """Search items: (query_id, place, id, content, score in 0..1 to six digits, created_at)."""
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")), 6)
    return packed.join(memories.select(F.col("memory_id").alias("source_id"), "created_at"), "source_id").select(
        "query_id", "place", F.col("source_id").alias("id"), "content", score.alias("score"), "created_at"
    )


def scores_by(model: Callable[[str, list[str]], list[float]], ranked: DataFrame, queries: DataFrame, pool: int = RERANK_POOL) -> DataFrame:
    """(query_id, memory_id, rerank_score) that ``model`` (query, texts) -> scores gives the first ``pool`` rows."""
    rows = ranked.where(F.col("rank") <= pool).join(queries.select("query_id", "bounded"), "query_id").select("query_id", "memory_id", "content", "rank", "bounded")

    def run(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("rank")
        given = model(found.bounded.iloc[0], list(found.content))
        if given is None or len(given) != len(found):
            given = [None] * len(found)
        return pd.DataFrame({"query_id": found.query_id, "memory_id": found.memory_id, "rerank_score": given})

    kind = ranked.schema["query_id"].dataType.simpleString()
    return rows.groupBy("query_id").applyInPandas(run, f"query_id {kind}, memory_id string, rerank_score double")
