"""Derived tables of an index: postings, document sizes, corpus statistics, session positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text

INDEXED_WEIGHT = 2.0


@dataclass(frozen=True)
class Index:
    """postings (term, user_id, memory_id, tf) and docs (memory_id, user_id, dl); tf weighs search_text twice.

    ``terms`` is told() of the same rows, if it is at hand.
    """

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame | None = None


def content_tokens(content: Column) -> Column:
    return text.words(text.normalize(F.coalesce(content, F.lit(""))))


def build(memories: DataFrame, tokens=content_tokens, stems=None) -> Index:
    """Postings and sizes of ``memories`` (memory_id, user_id, content, search_text).

    ``tokens`` tokenizes content, ``stems`` maps an array of tokens to their stems (none: as they are).
    """
    kept = F.filter(F.split(F.coalesce("search_text", F.lit("")), " "), lambda t: t != "")
    rows = memories.select("memory_id", "user_id", tokens(F.col("content")).alias("_own"), kept.alias("_kept"))
    if stems is not None:
        rows = rows.select("memory_id", "user_id", stems("_own").alias("_own"), stems("_kept").alias("_kept"))
    docs = rows.select("memory_id", "user_id", (F.size("_own") + F.size("_kept")).cast("double").alias("dl"))
    weighed = F.concat(F.transform("_own", lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("w"))), F.transform("_kept", lambda t: F.struct(t.alias("term"), F.lit(INDEXED_WEIGHT).alias("w"))))
    postings = rows.select("memory_id", "user_id", F.explode(weighed).alias("p")).groupBy("user_id", "memory_id", F.col("p.term").alias("term")).agg(F.sum("p.w").alias("tf"))
    return Index(postings, docs)


def told(memories: DataFrame, markers=lexicon.UPDATE_MARKERS) -> DataFrame:
    """What ranking asks of a row's text, extracted once a row and not once a candidate.

    (memory_id, held, whole, brief, claims, updates): terms for coverage, for admission and for suppression,
    the terms of each of its statements, and whether it holds an update marker.
    """
    claims = F.transform(text.clauses(F.col("content")), lambda part: text.lexical_terms(part, 96))
    return memories.select(
        "memory_id",
        text.held_terms(F.col("content"), F.coalesce("search_text", F.lit(""))).alias("held"),
        text.whole_terms(F.col("content"), F.col("search_text")).alias("whole"),
        text.lexical_terms(F.col("content"), 96).alias("brief"),
        claims.alias("claims"),
        text.has_update_marker(F.col("content"), markers).alias("updates"),
    )


def source_order(chunk: Column, occurred_at: Column, ordinal: Column, row_id: Column, memory: Column) -> list[Column]:
    """Sort keys that put a session's rows in the order of their source."""
    return [chunk, F.coalesce(occurred_at, F.lit(0).cast("long")), ordinal, row_id, memory]


def positions(memories: DataFrame, by_chunk: bool = True) -> DataFrame:
    """(memory_id, user_id, session_id, position from 0): chunk order, or plain order of time and arrival."""
    time = F.coalesce("occurred_at", F.lit(0).cast("long"))
    order = [text.chunk_index(F.col("request_id")), time, F.col("created_at"), F.col("ordinal"), F.col("memory_id")] if by_chunk else [time, F.col("ordinal"), F.col("row_id"), F.col("memory_id")]
    here = Window.partitionBy("user_id", "session_id").orderBy(*order)
    return memories.select("memory_id", "user_id", "session_id", (F.row_number().over(here) - 1).cast("long").alias("position"))
