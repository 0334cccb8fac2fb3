"""Queries over the write path."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest
from .data import MEMORIES, memories, requests, table, terms


def ingest_memories(spark, sf):
    return memories(spark, sf).select("memory_id", "user_id", "session_id", "request_id", F.col("ordinal").cast("long").alias("ordinal"), "role", "content")


def build_search_text(spark, sf):
    return memories(spark, sf).select("memory_id", "search_text")


def validate_quarantine(spark, sf):
    """Every turn as a request; system turns and those of every seventh conversation, sent without a user, break rules."""
    turns = table(spark, sf, "conversations")
    said = F.struct("role", F.col("text").alias("content"), F.lit(None).cast("bigint").alias("timestamp"))
    rows = turns.select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("request_id"),
        F.when(F.col("conv_id") % 7 == 0, "").otherwise("u").alias("user_id"),
        F.lit("s").alias("session_id"),
        F.array(said).alias("messages"),
    )
    _, bad = ingest.validate(rows)
    return bad.select("request_id", F.array_join("errors", ",").alias("errors"))


def request_classify(spark, sf):
    """Documents as requests named by their text's length: against a ledger of even ids, and among themselves."""
    docs = table(spark, sf, "documents")
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"), F.lit(None).cast("bigint").alias("timestamp")))
    rows = docs.select(F.concat(F.lit("len-"), F.col("n_chars")).alias("request_id"), F.col("source").alias("user_id"), F.col("lang").alias("session_id"), said.alias("messages"), "doc_id")
    even = rows.where("doc_id % 2 = 0").withColumn("payload_hash", ingest.payload_hash(*(F.col(c) for c in ("request_id", "user_id", "session_id", "messages"))))
    ledger = even.groupBy("user_id", "request_id").agg(F.min("payload_hash").alias("payload_hash"))
    return ingest.classify(rows.where("doc_id % 2 = 1"), ledger).groupBy("user_id", "status").agg(F.count("*").alias("requests"))


def user_revision(spark, sf):
    return ingest.revisions(requests(spark, sf))


def payload_hash(spark, sf):
    rows = requests(spark, sf)
    return rows.select("user_id", "request_id", ingest.payload_hash(F.col("request_id"), F.col("user_id"), F.col("session_id"), F.col("messages")).alias("payload_hash"))


QUERIES = {f.__name__: f for f in (ingest_memories, build_search_text, validate_quarantine, request_classify, user_revision, payload_hash)}

_PAYLOAD = """sha256('{"messages":[{"content":' || to_json(%s) || ',"role":"' || %s || '","timestamp":null}],"request_id":"' || %s || '","session_id":"' || %s || '","user_id":"' || %s || '"}')"""
SQL = {
    "ingest_memories": f"WITH {MEMORIES} SELECT memory_id, user_id, session_id, request_id, 0::BIGINT AS ordinal, role, content FROM m",
    "build_search_text": f"WITH {MEMORIES} SELECT memory_id, array_to_string(terms, ' ') AS search_text FROM {terms('m', 'content', 384)}",
    "validate_quarantine": """SELECT 'c' || conv_id || '-' || turn AS request_id, array_to_string(list_filter([CASE WHEN conv_id % 7 = 0 THEN 'user_id:length' END,
      CASE WHEN role NOT IN ('user', 'assistant') THEN 'messages.[0].role:value' END], lambda x: x IS NOT NULL), ',') AS errors
      FROM conversations WHERE conv_id % 7 = 0 OR role NOT IN ('user', 'assistant')""",
    "request_classify": f"""WITH r AS (SELECT 'len-' || n_chars AS request_id, source AS user_id, doc_id, {_PAYLOAD % ('text', "'user'", "'len-' || n_chars", 'lang', 'source')} AS h FROM documents),
      l AS (SELECT user_id, request_id, min(h) AS known FROM r WHERE doc_id % 2 = 0 GROUP BY ALL),
      o AS (SELECT r.*, known, row_number() OVER w AS n, first_value(h) OVER w AS f FROM r LEFT JOIN l USING (user_id, request_id) WHERE doc_id % 2 = 1
        WINDOW w AS (PARTITION BY r.user_id, r.request_id ORDER BY h))
      SELECT user_id, CASE WHEN known IS NOT NULL THEN CASE WHEN known = h THEN 'existing' ELSE 'conflict' END WHEN n = 1 THEN 'new' WHEN h = f THEN 'existing' ELSE 'conflict' END AS status,
        count(*) AS requests FROM o GROUP BY ALL""",
    "user_revision": f"WITH {MEMORIES} SELECT user_id, count(*) AS revision FROM m GROUP BY user_id",
    "payload_hash": f"WITH {MEMORIES} SELECT user_id, request_id, {_PAYLOAD % ('content', 'role', 'request_id', 'session_id', 'user_id')} AS payload_hash FROM m",
}
