"""The write path: validation, identities, idempotency, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal, text, vectors

MOST_LABELS = 12


def json_string(c: Column) -> Column:
    """A string as a JSON string, non-ASCII as it is, control characters with lower-case hexadecimal digits."""
    quoted = F.to_json(F.array(c))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    for code in (0x0B, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F, 0x0E, 0x0F):
        quoted = F.replace(quoted, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return quoted


def memory_id(user_id: Column, request_id: Column, ordinal: Column) -> Column:
    """Identity of a message; the JSON array keeps its parts apart whatever they hold."""
    key = F.concat(F.lit("["), json_string(user_id), F.lit(","), json_string(request_id), F.lit(","), ordinal.cast("string"), F.lit("]"))
    return F.concat(F.lit("mem_"), F.substring(F.sha2(key, 256), 1, 24))


def payload_hash(request_id: Column, user_id: Column, session_id: Column, messages: Column) -> Column:
    """SHA-256 of the request as compact JSON with sorted keys; null timestamps are written."""
    said = F.transform(
        messages,
        lambda m: F.concat(
            F.lit('{"content":'), json_string(m["content"]), F.lit(',"role":'), json_string(m["role"]), F.lit(',"timestamp":'), F.coalesce(m["timestamp"].cast("string"), F.lit("null")), F.lit("}")
        ),
    )
    whole = F.concat(
        F.lit('{"messages":['), F.array_join(said, ","), F.lit('],"request_id":'), json_string(request_id), F.lit(',"session_id":'), json_string(session_id), F.lit(',"user_id":'), json_string(user_id), F.lit("}")
    )
    return F.sha2(whole, 256)


def errors(requests: DataFrame) -> Column:
    """Labels of the rules that a request breaks, without any of its values; the thirteenth tells how many more."""
    rule = lambda broken, label: F.when(F.coalesce(broken, F.lit(True)), F.lit(label))
    size = lambda c, most: ~F.length(c).between(1, most)
    own = [
        rule(size(F.col("request_id"), 512), "request_id:length"),
        rule(size(F.col("user_id"), 512), "user_id:length"),
        rule(F.length("session_id") < 1, "session_id:length"),
        rule(F.size("messages") < 1, "messages:length"),
    ]
    each = F.transform(
        F.coalesce("messages", F.array().cast(requests.schema["messages"].dataType)),
        lambda m, i: F.array_compact(
            F.array(
                F.when(F.coalesce(~m["role"].isin("user", "assistant"), F.lit(True)), F.concat(F.lit("messages.["), i.cast("string"), F.lit("].role:value"))),
                F.when(m["content"].isNull(), F.concat(F.lit("messages.["), i.cast("string"), F.lit("].content:missing"))),
                F.when(~m["timestamp"].between(temporal.LEAST_MS, temporal.MOST_MS), F.concat(F.lit("messages.["), i.cast("string"), F.lit("].timestamp:range"))),
            )
        ),
    )
    found = F.concat(F.array_compact(F.array(*own)), F.flatten(each))
    more = F.size(found) - MOST_LABELS
    return F.when(more > 0, F.concat(F.slice(found, 1, MOST_LABELS), F.array(F.concat(more.cast("string"), F.lit("_more"))))).otherwise(found)


def validate(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound requests, and the others with their ``errors``."""
    judged = requests.withColumn("errors", errors(requests))
    return judged.where(F.size("errors") == 0).drop("errors"), judged.where(F.size("errors") > 0)


def classify(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """``requests`` with payload_hash and status: new, existing, or conflict.

    Within the batch the first row of a (user_id, request_id), by payload hash, stands for the id; equal
    rows are existing, others conflict, as they do against the ledger.
    """
    own = requests.withColumn("payload_hash", payload_hash(F.col("request_id"), F.col("user_id"), F.col("session_id"), F.col("messages")))
    known = ledger.select("user_id", "request_id", F.col("payload_hash").alias("_known"))
    same_id = Window.partitionBy("user_id", "request_id").orderBy("payload_hash")
    own = own.join(known, ["user_id", "request_id"], "left").withColumn("_n", F.row_number().over(same_id)).withColumn("_first", F.first("payload_hash").over(same_id))
    status = (
        F.when(F.col("_known").isNotNull(), F.when(F.col("_known") == F.col("payload_hash"), "existing").otherwise("conflict"))
        .when(F.col("_n") == 1, "new")
        .when(F.col("payload_hash") == F.col("_first"), "existing")
        .otherwise("conflict")
    )
    return own.withColumn("status", status).drop("_known", "_n", "_first")


def messages(requests: DataFrame, created_at: Column, annotation: Column | None = None) -> DataFrame:
    """Memory rows of sound requests; ``annotation`` is an array column with a text for each message."""
    given = [annotation.alias("_notes")] if annotation is not None else []
    rows = requests.select("user_id", "session_id", "request_id", *given, F.posexplode("messages").alias("ordinal", "m"))
    note = F.get(F.col("_notes"), F.col("ordinal")) if annotation is not None else None
    return rows.select(
        memory_id(F.col("user_id"), F.col("request_id"), F.col("ordinal")).alias("memory_id"),
        "user_id",
        "session_id",
        "request_id",
        "ordinal",
        F.col("m.role").alias("role"),
        F.col("m.content").alias("content"),
        F.col("m.timestamp").alias("occurred_at"),
        created_at.alias("created_at"),
        text.search_text(F.col("m.content"), note).alias("search_text"),
    )


def revisions(ledger: DataFrame) -> DataFrame:
    """(user_id, revision): accepted requests of each user."""
    return ledger.groupBy("user_id").agg(F.count("*").alias("revision"))


def embeddings(memories: DataFrame, vector: Column, model: str) -> DataFrame:
    """(memory_id, user_id, model, dimensions, vector); a vector that is not sound stops the batch."""
    broken = F.raise_error(F.concat(F.lit("vector is empty or not finite: "), F.col("memory_id")))
    sound = F.when(vectors.is_sound(F.col("vector")), F.col("vector")).otherwise(broken.cast("array<double>"))
    rows = memories.select("memory_id", "user_id", F.lit(model).alias("model"), vector.cast("array<double>").alias("vector"))
    return rows.select("memory_id", "user_id", "model", F.size("vector").alias("dimensions"), sound.alias("vector"))
