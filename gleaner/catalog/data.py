"""How the driver tables become memories and questions, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text
from ..operators import ingest

CREATED = "2026-01-01T00:00:00+00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each turn that a user or an assistant said."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    said = F.struct(F.col("role"), F.col("text").alias("content"), F.lit(None).cast("bigint").alias("timestamp"))
    return turns.select(
        F.concat(F.lit("conv-"), F.col("conv_id"), F.lit(":chunk-"), F.col("turn")).alias("request_id"),
        F.concat(F.lit("u"), F.col("conv_id") % 10).alias("user_id"),
        F.concat(F.lit("s"), F.col("conv_id")).alias("session_id"),
        F.array(said).alias("messages"),
        (F.col("conv_id") * 100000 + F.col("turn") + 1).alias("row_id"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir)
    ids = rows.select("user_id", "request_id", "row_id")
    return ingest.messages(rows, F.lit(CREATED)).join(ids, ["user_id", "request_id"])


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item, asked by one of the users."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("query_id"), F.concat(F.lit("u"), F.col("item_id") % 10).alias("user_id"), F.col("text").alias("query"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).withColumn("terms", text.lexical_terms(F.col("query"), 160))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows with a time: (user_id, memory_id, row_id, occurred_at, ordinal, role, content)."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("memory_id"),
        F.col("event_id").alias("row_id"),
        ms.alias("occurred_at"),
        F.lit(0).alias("ordinal"),
        F.col("event_type").alias("role"),
        F.col("props").alias("content"),
    )


# SQL of the same


def words_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STOP = words_list(L.STOPWORDS)
CJK = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]"
MEMORIES = """m AS (
  SELECT 'mem_' || substr(sha256('["u' || (conv_id % 10) || '","conv-' || conv_id || ':chunk-' || turn || '",0]'), 1, 24) AS memory_id,
    conv_id * 100000 + turn + 1 AS row_id, 'u' || (conv_id % 10) AS user_id, 's' || conv_id AS session_id,
    'conv-' || conv_id || ':chunk-' || turn AS request_id, turn, role, text AS content
  FROM conversations WHERE role IN ('user', 'assistant'))"""
QUESTIONS = "q AS (SELECT item_id AS query_id, 'u' || (item_id % 10) AS user_id, text AS query FROM benchmark)"
TIMED = """t AS (
  SELECT user_id::VARCHAR AS user_id, 'e' || lpad(event_id::VARCHAR, 12, '0') AS memory_id, event_id AS row_id, epoch_us(ts) // 1000 AS occurred_at,
    event_type AS role, props AS content FROM events)"""


def norm(x: str) -> str:
    return f"regexp_replace(replace(lower({x}), 'ß', 'ss'), '^\\s+|\\s+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[A-Za-z0-9_]+(?:[-''][A-Za-z0-9_]+)*')"


def stems(w: str) -> str:
    cut = lambda end, longer: f"CASE WHEN length({w}) > {longer} AND suffix({w}, '{end}') THEN substr({w}, 1, length({w}) - {len(end)}) END"
    return f"list_sort(list_distinct(list_filter([{w}, {cut('ing', 5)}, {cut('ed', 4)}, {cut('es', 4)}, {cut('s', 3)}], lambda v: v IS NOT NULL AND length(v) > 1)))"


def grams(run: str) -> str:
    """CJK segments of a run, then its single characters."""
    n = f"length({run})"
    of = lambda k: f"list_transform(range(1, greatest({n} - {k} + 2, 1)), lambda i: substr({run}, i, {k}))"
    return f"CASE WHEN {n} = 1 THEN [{run}] ELSE list_concat({of(2)}, {of(3)}) END"


def distinct(column: str) -> str:
    """A list without repeats, first mentions kept in order; ``column`` is a column's name."""
    return f"list_filter({column}, lambda x, i: list_position({column}, x) = i)"


def terms(source: str, text_sql: str, limit: int | None = None, keep: str = "*", name: str = "terms", cjk: bool = False, characters: bool = False) -> str:
    """A subquery: rows of ``source`` with their lexical terms."""
    own = f"flatten(list_transform(list_filter({words('_n')}, lambda w: length(w) > 1 AND NOT list_contains({STOP}, w)), lambda w: {stems('w')}))"
    if cjk:
        single = "list_transform(range(1, length(r) + 1), lambda j: substr(r, j, 1))"
        extra = f"list_concat({grams('r')}, {single})" if characters else grams("r")
        own = f"list_concat({own}, list_filter(flatten(list_transform(regexp_extract_all(_n, '{CJK}+'), lambda r: {extra})), lambda g: NOT list_contains({STOP}, g)))"
    cut = f"[1:{limit}]" if limit else ""
    return (
        f"(SELECT * EXCLUDE (_n, _l), ({distinct('_l')}){cut} AS {name} FROM (SELECT *, {own} AS _l FROM (SELECT {keep}, {norm(text_sql)} AS _n FROM {source})))"
    )


def values(rows: list[tuple], columns: str) -> str:
    """An inline table."""
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS v({columns})"
