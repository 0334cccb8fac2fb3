"""The engine: idempotent batches in, evidence windows for batches of questions out."""

from __future__ import annotations

import json
import hashlib
import logging
import threading
import uuid
from collections import OrderedDict
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import porter, temporal, text
from ..operators import candidates, index, ingest, rank, retrieve
from ..sources import models, schemas
from ..sources.stages import settle
from ..sources.store import Store
from .config import EngineConfig

log = logging.getLogger("gleaner")


class ConflictError(ValueError):
    """A request id came back with other content."""


def plan_queries(queries: DataFrame, config: EngineConfig) -> DataFrame:
    """Everything that later stages take from a question: terms, day, intent, excerpt, expansion, option terms.

    ``queries`` (query_id, user_id, query, options, top_k) may carry an analyzer's terms, facets and intent.
    """
    none = F.array().cast("array<string>")
    for name, default in (("terms", none), ("facets", none), ("intent", F.lit("none"))):
        if name not in queries.columns:
            queries = queries.withColumn(name, default)
    planned = F.concat("terms", "facets")
    bounded = text.bounded_query(F.col("query"), config.query_model_max_chars)
    return queries.select(
        "query_id",
        "user_id",
        "query",
        F.least(F.greatest("top_k", F.lit(1)), F.lit(100)).alias("top_k"),
        bounded.alias("bounded"),
        text.query_terms(F.col("query"), config.query_model_max_chars, planned).alias("terms"),
        text.lexical_terms(F.array_join(planned, " "), 128).alias("expansion"),
        text.lexical_terms(F.array_join(F.coalesce("options", none), " "), 64).alias("option_terms"),
        text.lexical_terms(F.col("query"), None).alias("asked_terms"),
        temporal.event_day(F.col("query")).alias("day"),
        F.when(F.col("intent") != "none", F.col("intent")).otherwise(text.temporal_intent(F.col("query"))).alias("intent"),
        F.col("intent").alias("planned_intent"),
    )


def search(queries: DataFrame, memories: DataFrame, indexed: index.Index, embedded: DataFrame | None, config: EngineConfig, query_vectors: DataFrame | None = None) -> DataFrame:
    """Evidence for a batch of questions: (query_id, place, id, content, score, created_at, unranked).

    ``unranked`` marks the rows of a question for which a configured reranker gave no usable scores.

    Stages that are used more than once are written to the shared folder; the last ones are left lazy.
    """
    if config.exact_unicode:
        queries = queries.withColumn("query", text.normalize_exact(F.col("query")))
    asked = settle(plan_queries(queries, config))
    limit = config.candidate_limit
    if config.lexical_backend == "prefix":
        lexical = retrieve.prefix_search(asked, indexed, memories, limit)
    else:
        terms = asked.withColumn("terms", porter.stem_all("terms")) if config.tokenizer == "porter" else asked
        lexical = retrieve.with_substring_fallback(asked, retrieve.bm25(terms, indexed, limit, config.stats_scope), memories, limit)
    lexical = settle(lexical)
    if embedded is None:
        near = lexical.limit(0)
    else:
        sought = query_vectors if query_vectors is not None else queries.select("query_id", models.local_embedding(F.col("query")).alias("vector"))
        aimed = asked.select("query_id", "user_id", F.lit(config.embedding_model).alias("model")).join(sought, "query_id")
        aimed = retrieve.minimum_similarity(aimed, lexical, config.vector_min_similarity, config.vector_only_min_similarity)
        near = retrieve.vector_search(aimed, embedded, memories, limit)
    dated = settle(retrieve.date_search(asked, memories, limit))
    # a day without rows is not a day
    days = dated.select("query_id").distinct().withColumn("_dated", F.lit(True))
    asked = asked.join(days, "query_id", "left").withColumn("day", F.when(F.col("_dated"), F.col("day"))).drop("_dated")
    asked = settle(asked)
    met = indexed.terms if indexed.terms is not None else settle(index.told(memories.join(asked.select("user_id").distinct(), "user_id", "left_semi")))
    admitted = settle(candidates.admit(candidates.fuse(lexical, near, dated), asked, met))
    rows = settle(candidates.expand(admitted, asked, memories).join(memories, "memory_id").join(met.drop("whole"), "memory_id"))
    revisable = asked.where((F.col("intent") != "earliest") & F.col("day").isNull())
    kept = candidates.suppress(rows.join(revisable.select("query_id"), "query_id", "left_semi"), revisable)
    rows = kept.unionByName(rows.join(revisable.select("query_id"), "query_id", "left_anti"))
    ordered = settle(rank.rule_rank(rows, asked).drop("held", "brief", "claims", "updates"))
    if config.reranker is not None:
        open_to = asked.where((F.col("intent") == "none") & F.col("day").isNull())
        ordered = settle(rank.rerank(ordered, rank.scores_by(config.reranker, ordered.join(open_to.select("query_id"), "query_id", "left_semi"), open_to)))
        unranked = ordered.where("NOT reranked").join(open_to.select("query_id"), "query_id", "left_semi").select("query_id").distinct().withColumn("unranked", F.lit(True))
        ordered = ordered.drop("reranked")
    limits = asked.select("query_id", "query", "intent", "top_k", F.least("top_k", F.lit(config.max_output_items)).alias("limit"))
    picked = settle(rank.diversify(ordered, limits))
    windowed = rank.windows(picked, memories)
    items = rank.emit(rank.pack(windowed, limits, config.max_output_tokens, config.max_output_items), memories)
    if config.reranker is None:
        return items.withColumn("unranked", F.lit(False))
    return items.join(unranked, "query_id", "left").withColumn("unranked", F.coalesce("unranked", F.lit(False)))


def build_index(memories: DataFrame, config: EngineConfig) -> index.Index:
    """Postings, sizes and terms of ``memories`` as the settings want them."""
    if config.exact_unicode:
        memories = memories.withColumn("content", text.normalize_exact(F.col("content")))
    built = index.build(memories, stems=porter.stem_all if config.tokenizer == "porter" else None)
    return index.Index(built.postings, built.docs, index.told(memories))


class Engine:
    """A store, its index and the settings to search it with."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.store = Store(spark, path)
        self._cache: OrderedDict[tuple, list[dict]] = OrderedDict()
        self._lock = threading.Lock()
        self._searches = threading.BoundedSemaphore(self.config.search_concurrency)
        self._adds = threading.BoundedSemaphore(self.config.add_concurrency)

    # write path

    def add(self, requests: DataFrame, created_at: str | None = None, batch: str | None = None) -> DataFrame:
        """Take in new requests: (user_id, request_id, status, errors), status new, existing, conflict or invalid.

        A batch name that is already published is not written again; its requests report as existing.
        """
        with self._adds:
            batch = batch or uuid.uuid4().hex
            now = created_at or datetime.now(UTC).isoformat()
            good, bad = ingest.validate(requests)
            judged = ingest.classify(good, self.store.read("requests")).cache()
            try:
                told = judged.select("user_id", "request_id", "status", F.array().cast("array<string>").alias("errors")).unionByName(
                    bad.select("user_id", "request_id", F.lit("invalid").alias("status"), "errors")
                )
                told = self.spark.createDataFrame(told.toArrow())  # before the ledger changes; one row a request of the batch
                fresh = judged.where("status = 'new'")
                if not self.store.is_published(batch) and not fresh.isEmpty():
                    self._publish(batch, fresh, now)
            finally:
                judged.unpersist()
            return told

    def _publish(self, batch: str, fresh: DataFrame, now: str) -> None:
        rows = ingest.messages(fresh, F.lit(now))
        if self.config.annotator is not None:
            noted = models.annotate_with(self.config.annotator, rows, "content")
            rows = noted.withColumn("search_text", text.search_text(self._exact(F.col("content")), F.col("annotation"))).drop("annotation")
        elif self.config.exact_unicode:
            rows = rows.withColumn("search_text", text.search_text(self._exact(F.col("content"))))
        start = self.store.read("memories").agg(F.coalesce(F.max("row_id"), F.lit(0))).first()[0]
        rows = rows.withColumn("row_id", F.monotonically_increasing_id() + (start + 1))
        where = f"{self.store.path}/memories/batch={batch}"
        columns = [c.split()[0] for c in schemas.MEMORY.split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(where)
        rows = self.spark.read.schema(schemas.MEMORY).parquet(where)
        built = build_index(rows, self.config)
        tables = {"requests": fresh.withColumn("created_at", F.lit(now)), "postings": built.postings, "docs": built.docs, "terms": built.terms}
        if self.config.embeddings:
            tables["embeddings"] = self._embedded(rows)
        self.store.publish(batch, tables)
        log.info("published a batch of %d tables", len(tables) + 1)

    def _exact(self, content):
        return text.normalize_exact(content) if self.config.exact_unicode else content

    def _embedded(self, rows: DataFrame) -> DataFrame:
        if self.config.embedder is None:
            return ingest.embeddings(rows, models.local_embedding(F.col("content")), self.config.embedding_model)
        return ingest.embeddings(models.embed_with(self.config.embedder, rows, "content"), F.col("vector"), self.config.embedding_model)

    def add_one(self, request: dict, created_at: str | None = None) -> str:
        """One request; a conflict or a broken rule is an error."""
        status = self.add(self.spark.createDataFrame([request], schemas.REQUEST), created_at).first()
        if status["status"] == "conflict":
            raise ConflictError("request_id was used with other content")
        if status["status"] == "invalid":
            raise ValueError(", ".join(status["errors"]))
        return status["status"]

    def rebuild_index(self) -> index.Index:
        """Postings, sizes and terms from the memories alone."""
        return build_index(self.store.read("memories"), self.config)

    # read path

    def search_batch(self, queries: DataFrame) -> DataFrame:
        """Evidence for many questions (query_id, user_id, query, options, top_k) as one plan."""
        blank = F.raise_error(F.lit("a query is blank"))
        queries = queries.withColumn("query", F.when(text.strip(F.col("query")) != "", F.col("query")).otherwise(blank.cast("string")))
        if self.config.analyzer is not None:
            queries = self._analyzed(queries)
        indexed = index.Index(self.store.read("postings"), self.store.read("docs"), self.store.read("terms"))
        embedded = self.store.read("embeddings") if self.config.embeddings else None
        sought = None
        if embedded is not None and self.config.embedder is not None:
            sought = models.embed_with(self.config.embedder, queries.select("query_id", "query"), "query").select("query_id", "vector")
        return search(queries, self.store.read("memories"), indexed, embedded, self.config, sought)

    def _analyzed(self, queries: DataFrame) -> DataFrame:
        analyze, most = self.config.analyzer, self.config.query_model_max_chars

        def run(frames):
            for frame in frames:
                found = [analyze(q[:most], models.compact_options(list(o)) if o is not None else []) or {} for q, o in zip(frame["query"], frame["options"], strict=True)]
                intents = [f.get("intent") if f.get("intent") in ("latest", "earliest") else "none" for f in found]
                yield frame.assign(terms=[models.string_list(f.get("terms")) for f in found], facets=[models.string_list(f.get("facets")) for f in found], intent=intents)

        return queries.mapInPandas(run, f"{schemas.QUERY}, terms array<string>, facets array<string>, intent string")

    def revision(self, user_id: str) -> int:
        return self.store.read("requests").where(F.col("user_id") == user_id).count()

    def search(self, query: str, user_id: str, top_k: int = 100, options: list[str] | None = None) -> list[dict]:
        """Evidence for one question, remembered until the user's next accepted request."""
        if not query.strip() or not 1 <= top_k <= 100:
            raise ValueError("a query is not blank and top_k lies between 1 and 100")
        with self._searches:
            digest = hashlib.sha256(json.dumps([query, options], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
            key = (user_id, digest, top_k, self.revision(user_id), self.config.cache_part())
            with self._lock:
                if key in self._cache:
                    return [dict(item) for item in self._cache[key]]
            asked = self.spark.createDataFrame([("q", user_id, query, options, top_k)], schemas.QUERY)
            found = [r.asDict() for r in self.search_batch(asked).orderBy("place").collect()]
            ranked = not any([item.pop("unranked") for item in found])
            if found and ranked:  # an order that a failed reranker left is not remembered
                with self._lock:
                    self._cache[key] = found
                    while len(self._cache) > self.config.cache_entries:
                        self._cache.popitem(last=False)
            return [dict(item) for item in found]

    def health(self) -> dict:
        return {"status": "ok", "memories": self.store.read("memories").count(), "batches": self.store.batches().count(), "embeddings": self.config.embeddings}
