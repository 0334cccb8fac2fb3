"""Queries over scores, selection, windows, packing, evaluation and the whole search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics, temporal, text
from ..operators import candidates, index, ingest, rank, retrieve
from ..plans import engine, evaluation
from ..plans.config import EngineConfig
from ..sources import models
from ..sources.stages import settle
from .data import MEMORIES, QUESTIONS, TIMED, asked, memories, norm, questions, table, terms, timed, values
from .retrieval import _POS, _bm25, _channels

STATEMENTS = [
    (1, "a", "The launch code for project zephyr is alpha.", 1, "t1", "r1", 0, 1),
    (1, "b", "Correction: the launch code for project zephyr is beta.", 2, "t2", "r2", 0, 2),
    (1, "c", "Alice likes jazz music.", 3, "t3", "r3", 0, 3),
    (2, "d", "The launch code for zephyr is alpha. Her sister paints boats in Lisbon.", 1, "t1", "r1", 0, 4),
    (2, "e", "Actually the launch code for zephyr is beta.", 2, "t2", "r2", 0, 5),
]
LATER = [
    (1, 5, 4, "a", "b", "r", "r", 0, 1, 1, 2), (2, None, 4, "b", "a", "r", "r", 0, 1, 1, 2), (3, None, None, "a", "a", "r", "r", 2, 1, 1, 2),
    (4, None, None, "a", "a", "r", "s", 2, 1, 3, 2), (5, 4, 4, "a", "a", "r", "s", 0, 0, 0, 2), (6, 4, 4, "a", "a", "r", "r", 0, 0, 2, 1),
]
_FIELDS = "query_id, occurred_at, b_occurred_at, created_at, b_created_at, request_id, b_request_id, ordinal, b_ordinal, row_id, b_row_id"


def is_later(spark, sf):
    kinds = "query_id bigint, occurred_at bigint, b_occurred_at bigint, created_at string, b_created_at string, request_id string, b_request_id string, ordinal int, b_ordinal int, row_id bigint, b_row_id bigint"
    names = ("occurred_at", "created_at", "request_id", "ordinal", "row_id")
    return spark.createDataFrame(LATER, kinds).select("query_id", temporal.is_later({c: F.col(c) for c in names}, {c: F.col(f"b_{c}") for c in names}).alias("later"))


def suppress_superseded(spark, sf):
    rows = spark.createDataFrame(STATEMENTS, "query_id bigint, memory_id string, content string, occurred_at bigint, created_at string, request_id string, ordinal int, row_id bigint")
    q = spark.createDataFrame([(1, "launch code zephyr"), (2, "sister boats Lisbon")], "query_id bigint, q string").select("query_id", text.lexical_terms(F.col("q"), None).alias("asked_terms"))
    return candidates.suppress(rows, q).select("query_id", "memory_id")


def suppress_volume(spark, sf):
    """Suppression over each question's BM25 candidates, with common words standing in for markers."""
    m, q, lexical, _ = _channels(spark, sf)
    rows = lexical.select("query_id", "memory_id").join(m, "memory_id")
    return candidates.suppress(rows, q.select("query_id", F.col("terms").alias("asked_terms")), ["the", "der", "les", "los"], share=0.3).groupBy("query_id").agg(F.count("*").alias("kept"))


def time_score(spark, sf):
    """Each user's events scored as the latest and as the earliest, with the day of the first as the asked day."""
    from pyspark.sql import Window

    whole = Window.partitionBy("user_id")
    rows = timed(spark, sf).withColumn("first", F.min("occurred_at").over(whole)).withColumn("last", F.max("occurred_at").over(whole))
    start = (F.floor(F.col("first") / 86400000) * 86400000).cast("long")
    day = F.struct(start.alias("start"), (start + 86400000).alias("end"))
    score = lambda intent: F.round(rank.time_score(F.col("occurred_at"), F.col("first"), F.col("last"), F.lit(intent), F.lit(False), day), 6)
    return rows.select("memory_id", score("latest").alias("latest"), score("earliest").alias("earliest"))


def rank_rule_score(spark, sf):
    m, q, lexical, _ = _channels(spark, sf)
    plan = q.select("query_id", F.col("query").alias("bounded"), "terms", F.array().cast("array<string>").alias("expansion"), F.array().cast("array<string>").alias("option_terms"), F.lit("none").alias("intent"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("day"))
    rows = lexical.select("query_id", "memory_id", "rank").join(m.select("memory_id", "content", "search_text", "occurred_at"), "memory_id")
    return rank.rule_rank(rows, plan).select("query_id", "memory_id", F.round("score", 6).alias("score"))


def rerank_merge(spark, sf):
    """BM25 order, the first ten reranked by text length; every third question lacks a score."""
    m, _, lexical, _ = _channels(spark, sf)
    scored = lexical.join(m.select("memory_id", "content"), "memory_id").where(~((F.col("query_id") % 3 == 0) & (F.col("rank") == 1)))
    out = rank.rerank(lexical, scored.select("query_id", "memory_id", F.length("content").cast("double").alias("rerank_score")), pool=10)
    return out.select("query_id", "memory_id", F.round("score", 6).alias("score"))


def diversity_select(spark, sf):
    """Every question as a summary over sessions, five rows each."""
    m, q, lexical, _ = _channels(spark, sf)
    rows = lexical.join(m.select("memory_id", "session_id"), "memory_id").select("query_id", "memory_id", "session_id", "score", "rank")
    limits = q.select("query_id", F.lit("Summarize the whole conversation history").alias("query"), F.lit(5).alias("limit"), F.lit("none").alias("intent"))
    return rank.diversify(rows, limits).select("query_id", "memory_id", "rank")


def phrase_bonus(spark, sf):
    """Whether a question stands in a document, word for word (documents of the same residue)."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), (F.col("doc_id") % 10).alias("k"))
    q = questions(spark, sf).withColumn("k", F.col("query_id") % 10)
    return q.join(docs, "k").withColumn("bonus", text.phrase_bonus(F.col("query"), F.col("content"))).groupBy("query_id").agg(F.sum("bonus").alias("bonus"))


def phrase_bonus_all(spark, sf):
    """Whether a question stands in a document, word for word, over every question and document.

    White space bounds a question's inner words on both sides, so a document that holds the question has
    each of them as a word: pairs meet at the question's rarest one. Questions without inner words meet every document.
    """
    split = lambda c: F.split(c, "\\s+")
    docs = table(spark, sf, "documents").select(F.col("text").alias("content"))
    q = settle(questions(spark, sf).withColumn("own", split(text.normalize(F.col("query")))))
    inner = q.where(F.size("own") > 2).select("query_id", "query", F.explode(F.array_distinct(F.expr("slice(own, 2, size(own) - 2)"))).alias("word"))
    held = docs.select(F.explode(F.array_distinct(split(text.normalize(F.col("content"))))).alias("word"))
    often = held.join(F.broadcast(inner.select("word").distinct()), "word").groupBy("word").agg(F.count("*").alias("n"))
    # a word that no document has is the rarest: its question meets none
    least = inner.join(often, "word", "left").groupBy("query_id", "query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "word"))["word"].alias("word"))
    least = settle(least)
    worded = docs.withColumn("word", F.explode(F.array_distinct(split(text.normalize(F.col("content")))))).join(F.broadcast(least), "word")
    short = docs.crossJoin(F.broadcast(q.where(F.size("own") <= 2).select("query_id", "query")))
    pairs = worded.select("query_id", "query", "content").unionByName(short.select("query_id", "query", "content"))
    found = pairs.withColumn("bonus", text.phrase_bonus(F.col("query"), F.col("content"))).groupBy("query_id").agg(F.sum("bonus").alias("bonus"))
    return q.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("bonus", F.lit(0.0)).alias("bonus"))


def term_coverage(spark, sf):
    q = asked(spark, sf).select("query_id", "user_id", "terms")
    rows = q.join(memories(spark, sf).select("user_id", "memory_id", "content"), "user_id")
    return rows.select("query_id", "memory_id", F.round(text.coverage(F.col("terms"), F.col("content")), 6).alias("coverage"))


def lexical_overlap(spark, sf):
    rows = asked(spark, sf).join(memories(spark, sf).select("user_id", "memory_id", "content"), "user_id")
    return rows.select("query_id", "memory_id", text.lexical_overlap(F.col("terms"), F.col("content"), F.lit("")).alias("overlap"))


def render_line(spark, sf):
    return timed(spark, sf).select("memory_id", rank.render_line(F.col("memory_id"), F.col("role"), F.col("occurred_at"), F.coalesce("content", F.lit(""))).alias("line"))


def truncate_line(spark, sf):
    return memories(spark, sf).select("memory_id", text.truncate_line(F.col("content"), F.lit(20)).alias("line"))


def neighbor_windows(spark, sf):
    """The window of lines around each question's best row."""
    m, _, lexical, _ = _channels(spark, sf)
    best = lexical.where("rank = 1").join(m.select("memory_id", "user_id"), "memory_id")
    return rank.windows(best, m).select("query_id", "memory_id", F.sha2(F.array_join(F.transform("context", lambda c: c["line"]), "\n"), 256).alias("window_sha256"))


def pack_windows(spark, sf):
    m, q, lexical, _ = _channels(spark, sf)
    best = lexical.where("rank <= 10").join(m.select("memory_id", "user_id"), "memory_id")
    return rank.pack(rank.windows(best, m), q.select("query_id", F.lit(5).alias("top_k")), 1000).select("query_id", "place", "source_id", F.sha2("content", 256).alias("content"))


def recall_at_k(spark, sf):
    """Of each question's ten best rows, the share of its user's first turns, both by BM25 and by recency of rows."""
    m, q, lexical, _ = _channels(spark, sf)
    found = lexical.where("rank <= 10").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))), lambda s: s["memory_id"]).alias("ids"))
    relevant = m.where("row_id % 100000 = 1").groupBy("user_id").agg(F.collect_list("memory_id").alias("relevant"))
    rows = q.select("query_id", "user_id").join(found, "query_id").join(relevant, "user_id")
    return rows.select("query_id", F.round(metrics.recall_at_k(F.col("ids"), F.col("relevant"), 10), 6).alias("recall"))


def evidence_match(spark, sf):
    """Each question's five best rows against the evidence expected of it: its user's longest row, or its own first word."""
    m, q, lexical, _ = _channels(spark, sf)
    found = lexical.where("rank <= 5").join(m.select("memory_id", "content"), "memory_id").groupBy("query_id").agg(
        F.collect_list("memory_id").alias("ids"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda s: s["content"]), " ").alias("told")
    )
    longest = m.groupBy("user_id").agg(F.array(F.max(F.struct(F.length("content"), "memory_id"))["memory_id"]).alias("expected"))
    rows = q.join(found, "query_id", "left").join(longest, "user_id", "left").withColumn("word", F.array(F.regexp_extract("query", r"^\S+", 0)))
    none = F.array().cast("array<string>")
    hit = evaluation.matches(F.coalesce("ids", none), F.coalesce("told", F.lit("")), F.col("word"), F.col("expected"))
    return rows.select("query_id", hit.alias("hit"))


def hit_rate(spark, sf):
    """Questions by whether their best row is long."""
    m, _, lexical, _ = _channels(spark, sf)
    best = lexical.where("rank = 1").join(m.select("memory_id", "content"), "memory_id")
    return best.agg(F.round(metrics.mean((F.length("content") > 300).cast("double")), 6).alias("hit_rate"), F.count("*").alias("questions"))


def end_to_end_search(spark, sf):
    """The whole search for every benchmark item."""
    m = settle(memories(spark, sf))
    built = engine.build_index(m, EngineConfig())
    built = index.Index(settle(built.postings), settle(built.docs), settle(built.terms))
    embedded = settle(ingest.embeddings(m, models.local_embedding(F.col("content")), "mock-64"))
    q = questions(spark, sf).select("query_id", "user_id", "query", F.lit(None).cast("array<string>").alias("options"), F.lit(10).alias("top_k"))
    return engine.search(q, m, built, embedded, EngineConfig()).select("query_id", "place", "id", "content", "score")


QUERIES = {
    f.__name__: f
    for f in (
        is_later, suppress_superseded, suppress_volume, time_score, rank_rule_score, rerank_merge, diversity_select, phrase_bonus, phrase_bonus_all, term_coverage, lexical_overlap, render_line,
        truncate_line, neighbor_windows, pack_windows, recall_at_k, evidence_match, hit_rate, end_to_end_search,
    )
}

_T = f"{TIMED}, w AS (SELECT *, min(occurred_at) OVER (PARTITION BY user_id) AS f, max(occurred_at) OVER (PARTITION BY user_id) AS l FROM t)"
_DAY = "CASE WHEN occurred_at >= f // 86400000 * 86400000 AND occurred_at < f // 86400000 * 86400000 + 86400000 THEN 0.25 ELSE 0 END"
_SHOWN = "strftime(make_timestamp(occurred_at * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN occurred_at % 1000 <> 0 THEN '.' || lpad((occurred_at % 1000)::VARCHAR, 3, '0') || '000' ELSE '' END || 'Z'"
_M_TERMS = f"k AS {terms('m', 'content', 512, name='own_terms')}"
SQL = {
    "is_later": f"""SELECT query_id::BIGINT AS query_id, CASE WHEN occurred_at IS NOT NULL AND b_occurred_at IS NOT NULL AND occurred_at <> b_occurred_at THEN occurred_at > b_occurred_at
      WHEN created_at <> b_created_at THEN created_at > b_created_at WHEN request_id = b_request_id AND ordinal <> b_ordinal THEN ordinal > b_ordinal
      WHEN row_id <> 0 AND b_row_id <> 0 AND row_id <> b_row_id THEN row_id > b_row_id ELSE false END AS later FROM {values(LATER, _FIELDS)}""",
    "time_score": f"""WITH {_T} SELECT memory_id, round(coalesce(0.16::DOUBLE * (occurred_at - f) / nullif(l - f, 0), 0) + {_DAY}, 6) AS latest,
      round(coalesce(0.16::DOUBLE * (1 - (occurred_at - f) / nullif(l - f, 0)::DOUBLE), 0) + {_DAY}, 6) AS earliest FROM w""",
    "rank_rule_score": _bm25(40)
    + f""", {_M_TERMS}, st AS {terms('own', "array_to_string(terms, ' ')", 512, 'memory_id', 'st_terms')}
      SELECT hits.query_id, hits.memory_id, round(0.4::DOUBLE * len(list_intersect(a.terms, list_concat(own_terms, st_terms))) / greatest(len(a.terms), 1) + 0.16::DOUBLE / rank
        + CASE WHEN length({norm('a.query')}) >= 4 AND contains({norm('k.content')}, {norm('a.query')}) THEN 0.06 ELSE 0 END, 6) AS score
      FROM hits JOIN a ON a.query_id = hits.query_id JOIN k ON k.memory_id = hits.memory_id JOIN st ON st.memory_id = hits.memory_id""",
    "rerank_merge": _bm25(40)
    + """ SELECT query_id, memory_id, round(CASE WHEN query_id % 3 = 0 THEN score WHEN rank <= 10 THEN length(content) ELSE 0 END, 6)::DOUBLE AS score FROM hits JOIN m USING (memory_id)""",
    "diversity_select": _bm25(40)
    + """, r AS (SELECT hits.query_id, hits.memory_id, m.session_id, score, rank, count(*) OVER w AS n, max(CASE WHEN rank = 5 THEN score END) OVER w AS edge, max(CASE WHEN rank = 1 THEN session_id END) OVER w AS top
        FROM hits JOIN m USING (memory_id) WINDOW w AS (PARTITION BY hits.query_id)),
      e AS (SELECT *, coalesce(score >= greatest(edge * 0.75::DOUBLE, edge - 0.15::DOUBLE) AND session_id <> top, false) AS near FROM r),
      o AS (SELECT *, n <= 5 OR rank = 1 OR (near AND row_number() OVER (PARTITION BY query_id, session_id, near ORDER BY rank) = 1) AS pick FROM e)
      SELECT query_id, memory_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pick DESC, rank) AS c FROM o) WHERE c <= 5""",
    "phrase_bonus": f"""SELECT item_id AS query_id, sum(CASE WHEN length({norm('b.text')}) >= 4 AND contains({norm('d.text')}, {norm('b.text')}) THEN 1.0::DOUBLE ELSE 0 END) AS bonus
      FROM benchmark b JOIN documents d ON d.doc_id % 10 = b.item_id % 10 GROUP BY item_id""",
    "term_coverage": f"WITH {MEMORIES}, {QUESTIONS}, a AS {terms('q', 'query', 160)}, {_M_TERMS} SELECT query_id, memory_id, round(len(list_intersect(terms, own_terms))::DOUBLE / greatest(len(terms), 1), 6) AS coverage FROM a JOIN k USING (user_id)",
    "lexical_overlap": f"WITH {MEMORIES}, {QUESTIONS}, a AS {terms('q', 'query', 160)}, k AS {terms('m', 'content', 1024, name='own_terms')} SELECT query_id, memory_id, list_has_any(list_filter(terms, lambda t: length(t) > 2), own_terms) AS overlap FROM a JOIN k USING (user_id)",
    "render_line": f"WITH {TIMED} SELECT memory_id, '[' || memory_id || ' | ' || role || ' | ' || {_SHOWN} || '] ' || coalesce(content, '') AS line FROM t",
    "truncate_line": f"WITH {MEMORIES} SELECT memory_id, CASE WHEN (length(content) + 3) // 4 <= 20 THEN content ELSE regexp_replace(substr(content, 1, 77), '\\s+$', '') || '...' END AS line FROM m",
    "neighbor_windows": _bm25(40)
    + f""", {_POS}, b AS (SELECT hits.query_id, hits.memory_id, pos.user_id, pos.session_id, pos.position FROM hits JOIN pos USING (memory_id) WHERE rank = 1)
      SELECT b.query_id, b.memory_id, sha256(string_agg('[' || n.memory_id || ' | ' || n.role || '] ' || n.content, chr(10) ORDER BY n.turn, n.row_id)) AS window_sha256
      FROM b JOIN pos n ON n.user_id = b.user_id AND n.session_id = b.session_id AND abs(n.position - b.position) <= 1 GROUP BY ALL""",
    "recall_at_k": _bm25(10)
    + """, rel AS (SELECT user_id, memory_id FROM m WHERE row_id % 100000 = 1), c AS (SELECT user_id, count(*) AS n FROM rel GROUP BY user_id)
      SELECT h.query_id, round(count(rel.memory_id)::DOUBLE / any_value(n), 6) AS recall FROM hits h JOIN q ON q.query_id = h.query_id JOIN c ON c.user_id = q.user_id
      LEFT JOIN rel ON rel.user_id = q.user_id AND rel.memory_id = h.memory_id GROUP BY h.query_id""",
    "evidence_match": _bm25(5)
    + r""", best AS (SELECT query_id, list(memory_id) AS ids, string_agg(content, ' ' ORDER BY rank) AS told FROM hits JOIN m USING (memory_id) GROUP BY query_id),
      longest AS (SELECT user_id, arg_max(memory_id, (length(content), memory_id)) AS expected FROM m GROUP BY user_id),
      worded AS (SELECT query_id, user_id, regexp_extract(query, '^\S+') AS word FROM q)
      SELECT worded.query_id, coalesce(list_contains(ids, expected), false) OR (word <> '' AND contains(coalesce(told, ''), word)) AS hit
      FROM worded LEFT JOIN best ON best.query_id = worded.query_id LEFT JOIN longest ON longest.user_id = worded.user_id""",
    # the statements are inline, so are the ones that stay: a correction takes the older one, unless that also says what was asked
    "suppress_superseded": f"SELECT query_id::BIGINT AS query_id, memory_id FROM {values([(1, 'b'), (1, 'c'), (2, 'd'), (2, 'e')], 'query_id, memory_id')}",
    "suppress_volume": _bm25(40)
    + rf""", cand AS (SELECT hits.query_id, m.* FROM hits JOIN m ON m.memory_id = hits.memory_id),
      said AS (SELECT DISTINCT memory_id, content FROM cand),
      brief AS {terms('said', 'content', 96, 'memory_id, content', 'brief')},
      part AS (SELECT memory_id, unnest(list_filter(string_split_regex(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'),
        '(?i)\x01|[。！？;；]+|\b(?:and|also)\b|以及|另外|同时'), lambda x: trim(x) <> '')) AS part FROM said),
      claim AS {terms('part', 'part', 96, 'memory_id, part', 'claim')},
      st AS (SELECT cand.query_id, cand.memory_id, cand.row_id, brief.brief, regexp_matches({norm('cand.content')}, '(^|[^a-z0-9_])(the|der|les|los)($|[^a-z0-9_])') AS updates
        FROM cand JOIN brief ON brief.memory_id = cand.memory_id),
      pairs AS (SELECT n.query_id, n.memory_id AS n_id, o.memory_id AS o_id, n.brief AS n_brief FROM st n JOIN st o ON o.query_id = n.query_id AND o.memory_id <> n.memory_id
        WHERE n.updates AND len(n.brief) > 0 AND len(o.brief) > 0 AND n.row_id > o.row_id AND len(list_intersect(n.brief, o.brief))::DOUBLE / len(n.brief) >= 0.3),
      held AS (SELECT DISTINCT pairs.query_id, n_id, o_id FROM pairs JOIN a ON a.query_id = pairs.query_id JOIN claim ON claim.memory_id = o_id
        WHERE len(claim) >= 2 AND len(list_intersect(claim, n_brief))::DOUBLE / len(claim) < 0.4 AND list_has_any(claim, a.terms)),
      gone AS (SELECT DISTINCT query_id, o_id FROM pairs ANTI JOIN held USING (query_id, n_id, o_id))
      SELECT cand.query_id, count(*) AS kept FROM cand ANTI JOIN gone ON gone.query_id = cand.query_id AND gone.o_id = cand.memory_id GROUP BY cand.query_id""",
    "hit_rate": _bm25(40) + " SELECT round(avg((length(content) > 300)::INT), 6) AS hit_rate, count(*) AS questions FROM hits JOIN m USING (memory_id) WHERE rank = 1",
}
