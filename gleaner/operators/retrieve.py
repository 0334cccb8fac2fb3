"""Candidate generators: BM25, prefix and substring search, exact vectors, days, recency.

Queries are rows (query_id, user_id, ...); results are (query_id, memory_id, score, rank), rank from 1,
ties in favour of the smaller memory_id. Scores are rounded to nine digits before they are ranked, so the
order in which parts of a sum meet cannot change a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.stages import settle
from . import nearest
from .index import Index

K1, B = 1.2, 0.75
SCORE_DIGITS = 9
#: Components of the vectors of a cell: rows at most, rows at least while there are fewer than CELLS, queries at most.
#: What the best of a query are is found anew in every cell, so small cells cost as much as large ones.
CELL, CELL_LEAST, CELLS, ASKING = 1 << 22, 1 << 19, 16, 1 << 20
#: Queries at most where rows are only counted: nothing is held for them.
COUNTING = 1 << 22


def ranked(hits: DataFrame, limit: int, *order: Column) -> DataFrame:
    """``hits`` with their rank within query_id, the first ``limit`` of each."""
    first = Window.partitionBy("query_id").orderBy(*order, F.col("memory_id"))
    return hits.withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= limit)


def bm25(queries: DataFrame, index: Index, limit: int = 300, scope: str = "corpus") -> DataFrame:
    """Top memories of the query's own user by BM25 over ``queries`` (query_id, user_id, terms).

    ``scope`` "corpus" takes counts and lengths over all users, "user" over the query's own. A term in more
    than half of the rows keeps a weight of 1e-6. A term counts as often as the query has it.
    """
    asked = queries.select("query_id", "user_id", F.explode("terms").alias("term")).groupBy("query_id", "user_id", "term").agg(F.count("*").alias("times"))
    by = ["user_id"] if scope == "user" else []
    size = index.docs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    often = index.postings.join(asked.select(*by, "term").distinct(), [*by, "term"]).groupBy(*by, "term").agg(F.count("*").alias("df"))
    hits = index.postings.join(asked, ["user_id", "term"]).join(often, [*by, "term"]).join(index.docs.select("memory_id", "dl"), "memory_id")
    hits = hits.join(size, "user_id") if by else hits.join(F.broadcast(size))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(1e-6)
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", "memory_id").agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))
    return ranked(scored, limit, F.desc("score"))


def prefix_search(queries: DataFrame, index: Index, memories: DataFrame, limit: int = 300) -> DataFrame:
    """Memories with a term that begins with (ASCII) or equals (others) a query term, or that contain a CJK term.

    The score is the summed weight 1 + ln(tf) of the matching postings, 0 for a match by substring alone:
    a stand-in for a text rank whose exact form belongs to one database.
    """
    asked = queries.select("query_id", "user_id", F.explode(text.prefix_terms(F.col("terms"))).alias("t")).select("query_id", "user_id", "t.term", "t.prefix")
    # prefixes share their first character with what they match, which gives the join a key
    own = index.postings.select("user_id", "memory_id", "tf", F.col("term").alias("found"), F.substring("term", 1, 1).alias("_c"))
    keyed = asked.withColumn("_c", F.substring("term", 1, 1))
    matches = keyed.join(own, ["user_id", "_c"]).where(F.when(F.col("prefix"), F.startswith("found", "term")).otherwise(F.col("found") == F.col("term")))
    by_term = matches.groupBy("query_id", "memory_id").agg(F.round(F.sum(1 + F.log("tf")), SCORE_DIGITS).alias("score"))
    like = queries.select("query_id", "user_id", text.like_terms(F.col("terms")).alias("like")).where(F.size("like") > 0)
    inside = like.join(memories.select("user_id", "memory_id", "content"), "user_id").where(F.exists("like", lambda t: F.contains(F.col("content"), t)))
    both = by_term.unionByName(inside.select("query_id", "memory_id", F.lit(0.0).alias("score"))).groupBy("query_id", "memory_id").agg(F.max("score").alias("score"))
    return ranked(both, limit, F.desc("score"))


def with_substring_fallback(queries: DataFrame, hits: DataFrame, memories: DataFrame, limit: int = 300) -> DataFrame:
    """``hits`` filled up to ``limit`` with rows that hold the query's first single CJK character, latest first."""
    single = queries.select("query_id", "user_id", text.first_single_cjk(F.col("terms")).alias("_char")).where("_char IS NOT NULL")
    found = single.join(memories.select("user_id", "memory_id", "content", "occurred_at", "ordinal", "row_id"), "user_id").where(F.contains("content", "_char"))
    found = found.join(hits.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    last = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("occurred_at"), F.desc("ordinal"), F.desc("row_id"), "memory_id")
    held = hits.groupBy("query_id").agg(F.count("*").alias("_held"))
    more = found.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= limit).join(held, "query_id", "left")
    more = more.select("query_id", "memory_id", F.lit(0.0).alias("score"), (F.coalesce("_held", F.lit(0)) + F.col("_n")).cast("long").alias("rank"))
    return hits.select("query_id", "memory_id", "score", "rank").unionByName(more.where(F.col("rank") <= limit))


def vector_search(queries: DataFrame, embedded: DataFrame, memories: DataFrame, limit: int = 300) -> DataFrame:
    """Exact cosine search over ``queries`` (query_id, user_id, model, vector, min_similarity) by user and model.

    Vectors of other dimensions or without length take no part; ties go to the later row. Queries and rows
    of a user and model are dealt into cells, so that neither many of one user nor many users end in one task.
    """
    by = ["user_id", "model"]
    times = memories.select("memory_id", F.coalesce("occurred_at", F.lit(0)).cast("long").alias("time"))
    asked, rows, _ = _dealt(queries, embedded, ASKING, times)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, memory_id {embedded.schema['memory_id'].dataType.simpleString()}, score double, time bigint"
    met = lambda a, b: nearest.cell(limit, SCORE_DIGITS)(a, b)
    near = asked.groupBy(*by, "r", "q").cogroup(rows.groupBy("u", "m", "rr", "qq")).applyInArrow(met, kinds)
    return ranked(near, limit, F.desc("score"), F.desc("time")).select("query_id", "memory_id", "score", "rank")


def vector_hits(queries: DataFrame, embedded: DataFrame, limit: int = 300) -> DataFrame:
    """(query_id, hits): how many rows ``vector_search`` finds, up to ``limit``, of queries that have any.

    Cells tell numbers only, so neither hits nor their ranks become rows, and rows need no memories.
    """
    by = ["user_id", "model"]
    asked, rows, cells = _dealt(queries, embedded, COUNTING)
    sc = queries.sparkSession.sparkContext
    n_cells = cells.agg(F.sum(F.col("row_parts") * F.col("query_parts")).cast("long")).first()[0] or 1
    # many more partitions than cells, so that few cells share one
    n = min(4 * n_cells, max(16 * sc.defaultParallelism, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    asked, rows = asked.repartition(n, *by, "r", "q"), rows.drop("memory_id").repartition(n, "u", "m", "rr", "qq")
    met = lambda a, b: nearest.counted(limit, SCORE_DIGITS)(a, b)
    found = asked.groupBy(*by, "r", "q").cogroup(rows.groupBy("u", "m", "rr", "qq")).applyInArrow(met, f"query_id {queries.schema['query_id'].dataType.simpleString()}, hits bigint")
    return found.groupBy("query_id").agg(F.least(F.sum("hits"), F.lit(limit).cast("long")).alias("hits"))


def _dealt(queries: DataFrame, embedded: DataFrame, asking: int, times: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries and rows, with their ``times`` if given, dealt into cells (user_id, model, r, q) and (u, m, rr, qq), and how many of those a user has."""
    by = ["user_id", "model"]
    asked = queries.where("min_similarity IS NOT NULL").select("query_id", *by, _plain(queries), "min_similarity")
    sizes = asked.groupBy(*by).agg(F.count("*").alias("asks"), F.max(F.size("vector")).alias("width"))
    held = embedded.groupBy(*by).agg(F.count("*").alias("rows"))
    slices = lambda n, most: F.greatest(F.lit(1), F.ceil(F.col(n) * F.col("width") / most))
    query_parts = slices("asks", asking)
    parts = F.greatest(slices("rows", CELL), F.least(F.ceil(CELLS / query_parts), slices("rows", CELL_LEAST)))
    cells = settle(sizes.join(held, by).where("width > 0").select(*by, parts.alias("row_parts"), query_parts.alias("query_parts")))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    asked = asked.join(cells, by).select(*by, each("row_parts").alias("r"), mine("query_id", "query_parts").alias("q"), "query_id", "vector", "min_similarity")
    rows = embedded.select(*by, "memory_id", _plain(embedded)).join(cells, by)
    if times is not None:
        rows = rows.join(times, "memory_id")
    # under other names: the two sides may come from one table
    rows = rows.select(F.col("user_id").alias("u"), F.col("model").alias("m"), mine("memory_id", "row_parts").alias("rr"), each("query_parts").alias("qq"), "memory_id", *(["time"] if times is not None else []), "vector")
    return asked, rows, cells


def _plain(df: DataFrame) -> Column:
    """The column vector of ``df`` with components that are floats or doubles."""
    kind = df.schema["vector"].dataType.simpleString()
    return (F.col("vector") if kind == "array<float>" else F.col("vector").cast("array<double>")).alias("vector")


def minimum_similarity(queries: DataFrame, lexical: DataFrame, usual: float = 0.35, alone: float = 0.65) -> DataFrame:
    """``queries`` with the similarity that a vector hit needs: more where no term matched."""
    found = lexical.groupBy("query_id").agg(F.count("*").alias("n_lexical"))
    return queries.join(found, "query_id", "left").withColumn("n_lexical", F.coalesce("n_lexical", F.lit(0))).withColumn(
        "min_similarity", F.when(F.col("n_lexical") > 0, usual).otherwise(alone)
    )


def date_search(queries: DataFrame, memories: DataFrame, limit: int = 300) -> DataFrame:
    """Rows of the query's day (query_id, user_id, day struct<start, end>), the latest first."""
    asked = queries.where("day IS NOT NULL").select("query_id", "user_id", "day")
    inside = asked.join(memories.select("user_id", "memory_id", "occurred_at"), "user_id").where((F.col("occurred_at") >= F.col("day.start")) & (F.col("occurred_at") < F.col("day.end")))
    return ranked(inside, limit, F.desc("occurred_at")).select("query_id", "memory_id", F.lit(0.0).alias("score"), "rank")


def recent(memories: DataFrame, limit: int) -> DataFrame:
    """(user_id, memory_id, rank): each user's latest rows; rows without a time last."""
    last = Window.partitionBy("user_id").orderBy(F.desc(F.coalesce("occurred_at", F.lit(0))), F.desc("row_id"), "memory_id")
    return memories.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= limit).select("user_id", "memory_id", "rank")
