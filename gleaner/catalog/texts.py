"""Queries over text, time and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import metrics, temporal, text, vectors
from ..operators import audit
from .data import CJK, MEMORIES, QUESTIONS, TIMED, distinct, memories, norm, questions, table, terms, timed, values, words_list

#: Inline questions: data, not code. The driver tables hold no CJK text and no dates in questions.
QUERIES_INLINE = [
    (1, "What is my latest favorite drink?"), (2, "What was the first launch code for project zephyr?"), (3, "Where do I work now"),
    (4, "我最近住在哪里"), (5, "最早的计划是什么"), (6, "What drink do I prefer?"), (7, "firstly, snowfall"), (8, "我养猫"), (9, "北京的工作怎么样"),
]
DATES_INLINE = [
    (1, "What happened on 2024-01-01?"), (2, "What is due on 2024-01-01?"), (3, "On 2024-02-30 what?"), (4, "between 2024-01-01 and 2024-01-02"),
    (5, "2024年1月5日我们去了哪里发生"), (6, "2024-03-09 当天"), (7, "milestone-2024-01-01"), (8, "no date"), (9, "during 1999-12-31"),
]
UPDATES_INLINE = [(1, "Actually, I moved."), (2, "I know nothing"), (3, "Correction: beta"), (4, "其实是茶"), (5, "unchanged"), (6, "He changed jobs")]


def _inline(spark, rows, column="query"):
    return spark.createDataFrame(rows, f"query_id bigint, {column} string")


def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("normalized"))


def lexical_terms(spark, sf):
    return memories(spark, sf).select("memory_id", F.array_join(text.lexical_terms(F.col("content")), " ").alias("terms"))


def cjk_ngrams(spark, sf):
    return _inline(spark, QUERIES_INLINE).select("query_id", F.array_join(text.lexical_terms(F.col("query"), 256, True), " ").alias("terms"))


def semantic_terms(spark, sf):
    return _inline(spark, QUERIES_INLINE).select("query_id", F.array_join(text.semantic_terms(F.col("query")), " ").alias("terms"))


def fts_query_build(spark, sf):
    return questions(spark, sf).select("query_id", text.match_query(text.lexical_terms(F.col("query"), 160)).alias("match"))


def temporal_intent(spark, sf):
    return _inline(spark, QUERIES_INLINE).select("query_id", text.temporal_intent(F.col("query")).alias("intent"))


def update_marker(spark, sf):
    return _inline(spark, UPDATES_INLINE).select("query_id", text.has_update_marker(F.col("query")).alias("updated"))


def estimate_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


def bounded_query(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.bounded_query(F.col("text"), 512).alias("bounded"))


def clause_split(spark, sf):
    parts = F.transform(text.clauses(F.col("content")), text.strip)
    return memories(spark, sf).select("memory_id", F.size(parts).cast("long").alias("n"), F.array_join(parts, "|").alias("clauses"))


def explicit_date_range(spark, sf):
    day = temporal.explicit_day(F.col("query"))
    return _inline(spark, DATES_INLINE).select("query_id", day["start"].alias("start_ms"), day["end"].alias("end_ms"))


def event_day_range(spark, sf):
    day = temporal.event_day(F.col("query"))
    return _inline(spark, DATES_INLINE).select("query_id", day["start"].alias("start_ms"))


def prefix_terms(spark, sf):
    own = text.prefix_terms(text.lexical_terms(F.col("query"), 160, True))
    return _inline(spark, QUERIES_INLINE).select("query_id", F.array_join(F.transform(own, lambda t: F.concat(t["term"], F.when(t["prefix"], ":*").otherwise(""))), " ").alias("terms"))


def like_terms(spark, sf):
    return _inline(spark, QUERIES_INLINE).select("query_id", F.array_join(text.like_terms(text.lexical_terms(F.col("query"), 160, True)), " ").alias("terms"))


def render_time(spark, sf):
    return timed(spark, sf).select("memory_id", temporal.shown(F.col("occurred_at")).alias("shown"))


def mock_embedding(spark, sf):
    v = vectors.mock_embedding(F.col("content"), unit=False)
    return memories(spark, sf).select("memory_id", F.round(F.get(v, 0), 9).alias("first"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def weighted_embedding(spark, sf):
    """The mean of each label's vectors, weighted by their ids plus one."""
    rows = table(spark, sf, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("r"))
    mean = vectors.weighted_mean(F.transform("r", lambda r: r["embedding"].cast("array<double>")), F.transform("r", lambda r: r["vec_id"] + 1))
    return rows.select(F.col("label").cast("long").alias("label"), F.round(F.get(mean, 0), 6).alias("first"), F.round(F.get(mean, 63), 6).alias("last"))


def cache_digest(spark, sf):
    from ..operators.ingest import json_string

    return questions(spark, sf).select("query_id", F.sha2(F.concat(F.lit("["), json_string(F.col("query")), F.lit(",null]")), 256).alias("digest"))


#: Planted texts for the scan, put together here so that no text of this file looks like a secret itself.
SECRET_TEXTS = [
    (-1, "x -----BEGIN RSA " + "PRIVATE KEY----- y"), (-2, "key sk-" + "a1B2" * 6), (-3, "Bearer " + "q9" * 12 + " and AKIA" + "Z7" * 8), (-4, "ghp_" + "k3" * 12),
    (-5, "Bearer $TOKEN_FROM_ENVIRONMENT_VARIABLE"), (-6, "sk-short AKIA123"),
]


def secret_scan(spark, sf):
    """Every document, and a few planted texts."""
    planted = spark.createDataFrame(SECRET_TEXTS, "doc_id bigint, text string")
    return audit.secret_scan(table(spark, sf, "documents").select("doc_id", "text").unionByName(planted), "doc_id", "text")


def long_query_terms(spark, sf):
    """Every document's beginning as a question that is too long for its short way; the whole text is the question."""
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return rows.select("doc_id", text.query_terms(F.col("text"), 512).alias("terms")).select("doc_id", F.size("terms").cast("long").alias("n"), F.sha2(F.array_join("terms", " "), 256).alias("terms_sha256"))


def url_check(spark, sf):
    return table(spark, sf, "pages").select("page_id", audit.is_public_url(F.col("url")).alias("public"))


def percentiles(spark, sf):
    rows = table(spark, sf, "documents").groupBy("lang")
    return rows.agg(
        *(metrics.percentile(F.col("n_chars"), p).alias(f"p{p}") for p in (50, 95)), metrics.upper_median(F.col("n_chars")).alias("median"), F.round(metrics.mean(F.col("n_chars")), 6).alias("mean")
    )


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, lexical_terms, cjk_ngrams, semantic_terms, fts_query_build, temporal_intent, update_marker, estimate_tokens, bounded_query, clause_split,
        explicit_date_range, event_day_range, prefix_terms, like_terms, render_time, mock_embedding, weighted_embedding, cache_digest, secret_scan, long_query_terms, url_check, percentiles,
    )
}


def _marker(x: str, markers) -> str:
    ascii_ = "|".join(m for m in markers if m.isascii())
    rest = " OR ".join(f"contains({x}, '{m}')" for m in markers if not m.isascii())
    return f"(regexp_matches({x}, '(^|[^a-z0-9_])({ascii_})($|[^a-z0-9_])') OR {rest})"


_Q = values(QUERIES_INLINE, "query_id, query")
_CONCEPTS = "list_concat(terms, " + ", ".join(f"CASE WHEN list_has_any(terms, {words_list(g)}) THEN {words_list(sorted(g))} ELSE [] END" for g in L.CONCEPTS) + ")"
_DAY = "regexp_extract(query, '(\\d{4})[-年]\\s*(\\d{1,2})[-月]\\s*(\\d{1,2})', ['y', 'm', 'd'])"
_DAYS_FOUND = "len(regexp_extract_all(' ' || query || ' ', '[^A-Za-z0-9_-](\\d{4}-\\d{1,2}-\\d{1,2}|\\d{4}年\\s*\\d{1,2}月\\s*\\d{1,2}日)[^A-Za-z0-9_-]'))"
_START = f"CASE WHEN {_DAYS_FOUND} = 1 THEN epoch_ms(TRY_CAST(({_DAY}).y || '-' || lpad(({_DAY}).m, 2, '0') || '-' || lpad(({_DAY}).d, 2, '0') AS DATE)::TIMESTAMP) END"
_HEX = "list_transform(range(0, 64), lambda i: (('0x' || substr(sha256(content), ((i % 32) * 2 + 1)::INT, 2))::INT)::DOUBLE / 255.0 * 2.0 - 1.0)"

SQL = {
    "normalize_text": f"SELECT doc_id, sha256({norm('text')}) AS normalized FROM documents",
    "lexical_terms": f"WITH {MEMORIES} SELECT memory_id, array_to_string(terms, ' ') AS terms FROM {terms('m', 'content', 256)}",
    "cjk_ngrams": f"SELECT query_id::BIGINT AS query_id, array_to_string(terms, ' ') AS terms FROM {terms(_Q, 'query', 256, cjk=True, characters=True)}",
    "semantic_terms": f"SELECT query_id::BIGINT AS query_id, array_to_string(({distinct('_w')})[1:128], ' ') AS terms FROM (SELECT *, {_CONCEPTS} AS _w FROM {terms(_Q, 'query', 128, cjk=True)})",
    "fts_query_build": f"WITH {QUESTIONS} SELECT query_id, array_to_string(list_transform(terms, lambda t: '\"' || t || '\"'), ' OR ') AS match FROM {terms('q', 'query', 160)}",
    "temporal_intent": f"SELECT query_id::BIGINT AS query_id, CASE WHEN {_marker(norm('query'), L.EARLIEST_MARKERS)} THEN 'earliest' WHEN {_marker(norm('query'), L.LATEST_MARKERS)} THEN 'latest' ELSE 'none' END AS intent FROM {_Q}",
    "update_marker": f"SELECT query_id::BIGINT AS query_id, {_marker(norm('query'), L.UPDATE_MARKERS)} AS updated FROM {values(UPDATES_INLINE, 'query_id, query')}",
    "estimate_tokens": f"SELECT doc_id, (length(text) - length(o) + (length(o) + 3) // 4)::BIGINT AS tokens FROM (SELECT doc_id, text, regexp_replace(text, '{CJK}', '', 'g') AS o FROM documents)",
    "bounded_query": "SELECT doc_id, CASE WHEN length(text) <= 512 THEN text ELSE substr(text, 1, 127) || chr(10) || right(text, 384) END AS bounded FROM documents",
    "clause_split": rf"""WITH {MEMORIES}, s AS (SELECT memory_id, string_split_regex(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), '(?i)\x01|[。！？;；]+|\b(?:and|also)\b|以及|另外|同时') AS parts FROM m),
      k AS (SELECT memory_id, list_filter(list_transform(parts, lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS c FROM s)
      SELECT memory_id, len(c)::BIGINT AS n, array_to_string(c, '|') AS clauses FROM k""",
    "explicit_date_range": f"SELECT query_id::BIGINT AS query_id, ({_START})::BIGINT AS start_ms, ({_START} + 86400000)::BIGINT AS end_ms FROM {values(DATES_INLINE, 'query_id, query')}",
    "event_day_range": rf"""SELECT query_id::BIGINT AS query_id, CASE WHEN NOT regexp_matches(query, '(?i)\b(?:due|deadline|scheduled|appointment|expires?|expiry|expiration)\b|到期|截止|期限|预约|预定') AND (
        regexp_matches(query, '(?i)(\b(?:on|at|during|as of)\s*|[在于]\s*)(\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{4}}年\s*\d{{1,2}}月\s*\d{{1,2}}日)')
        OR regexp_matches(query, '(\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{4}}年\s*\d{{1,2}}月\s*\d{{1,2}}日)\s*(?:当天|当日|那天|这天)')
        OR regexp_matches(query, '^(\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{4}}年\s*\d{{1,2}}月\s*\d{{1,2}}日)\s*(?:我|他|她|我们|他们).{{0,40}}(?:住|去|到|在哪里|发生|做了什么)')) THEN ({_START})::BIGINT END AS start_ms
      FROM {values(DATES_INLINE, 'query_id, query')}""",
    "prefix_terms": f"SELECT query_id::BIGINT AS query_id, array_to_string(list_transform(terms, lambda t: t || CASE WHEN regexp_matches(t, '^[\\x00-\\x7f]+$') THEN ':*' ELSE '' END), ' ') AS terms FROM {terms(_Q, 'query', 160, cjk=True, characters=True)}",
    "like_terms": f"""SELECT query_id::BIGINT AS query_id, array_to_string(({distinct('_w')})[1:12], ' ') AS terms FROM (SELECT query_id,
        list_concat(list_filter(_o[1:1], lambda t: length(t) > 1), list_filter(_o, lambda t: length(t) = 1), list_filter(_o, lambda t: length(t) > 1)) AS _w
        FROM (SELECT query_id, list_filter(terms, lambda t: NOT regexp_matches(t, '^[\\x00-\\x7f]*$')) AS _o FROM {terms(_Q, 'query', 160, cjk=True, characters=True)}))""",
    "render_time": f"WITH {TIMED} SELECT memory_id, strftime(make_timestamp(occurred_at * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN occurred_at % 1000 <> 0 THEN '.' || lpad((occurred_at % 1000)::VARCHAR, 3, '0') || '000' ELSE '' END || 'Z' AS shown FROM t",
    "mock_embedding": f"WITH {MEMORIES} SELECT memory_id, round(v[1], 9) AS first, round(list_sum(v), 6) AS total FROM (SELECT memory_id, {_HEX} AS v FROM m)",
    "weighted_embedding": "SELECT label::BIGINT AS label, round(sum(embedding[1]::DOUBLE * (vec_id + 1)) / sum(vec_id + 1), 6) AS first, round(sum(embedding[64]::DOUBLE * (vec_id + 1)) / sum(vec_id + 1), 6) AS last FROM embeddings GROUP BY label",
    "cache_digest": f"WITH {QUESTIONS} SELECT query_id, sha256('[' || to_json(query) || ',null]') AS digest FROM q",
    "secret_scan": f"SELECT doc_id, kind FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {values(SECRET_TEXTS, 'doc_id, text')}), "
    + values([(k, p.replace("(?!\\$)", "")) for k, p in L.SECRETS.items()], "kind, pattern")
    + " WHERE regexp_matches(text, pattern)",
    "url_check": r"""SELECT page_id, coalesce(contains(h, '.') AND NOT (regexp_matches(h, '^(?:localhost|127\..*|10\..*|192\.168\..*|172\.(?:1[6-9]|2\d|3[01])\..*|169\.254\..*|0\.0\.0\.0)$')
      OR h LIKE '%.local' OR h LIKE '%.internal'), false) AS public FROM (SELECT page_id, lower(regexp_extract(url, '^https://([^/?#:@]+)(?::\d+)?(?:[/?#]|$)', 1)) AS h FROM pages)""",
    "percentiles": """SELECT lang, l[greatest(round_even(0.5 * len(l) + 0.5, 0)::INT, 1)]::DOUBLE AS p50, l[least(greatest(round_even(0.95 * len(l) + 0.5, 0)::INT, 1), len(l))]::DOUBLE AS p95,
      l[len(l) // 2 + 1]::DOUBLE AS median, round(list_avg(l), 6) AS mean FROM (SELECT lang, list_sort(list(n_chars)) AS l FROM documents GROUP BY lang)""",
}
