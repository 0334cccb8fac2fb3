"""Calendar days that a query names, and how times are shown and compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

DAY_MS = 86_400_000
#: Years 1 to 9999, in milliseconds since 1970.
LEAST_MS, MOST_MS = -62_135_596_800_000, 253_402_300_799_999


def _width(c: Column) -> Column:
    """Full-width digits, hyphens and Latin letters as ASCII ones."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    return F.translate(c, wide, "".join(chr(0x21 + i) for i in range(94)))


def explicit_day(query: Column) -> Column:
    """struct<start, end> in ms of the one calendar day (UTC) that a query names, half open; null otherwise."""
    text = _width(query)
    part = lambda i: F.regexp_extract_all(text, F.lit(L.EXPLICIT_DATE), F.lit(i))
    pick = lambda a, b: F.when(F.get(part(a), 0) != "", F.get(part(a), 0)).otherwise(F.get(part(b), 0)).cast("int")
    day = F.try_make_timestamp(pick(1, 4), pick(2, 5), pick(3, 6), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    start = F.when(F.size(part(0)) == 1, F.unix_millis(day))
    return F.when(start.isNotNull(), F.struct(start.alias("start"), (start + DAY_MS).alias("end")))


def event_day(query: Column) -> Column:
    """The day as in explicit_day, if the query asks what happened on it rather than for a date."""
    at = F.regexp_instr(query, F.lit(L.DATE_TEXT), F.lit(0))
    found = F.regexp_extract(query, L.DATE_TEXT, 0)
    before = F.substring(query, F.lit(1), at - 1)
    after = F.substring(query, at + F.length(found), F.length(query))
    cued = before.rlike(L.DAY_CUE_BEFORE) | after.rlike(L.DAY_CUE_AFTER) | (at == 1) & after.rlike(L.DATE_FIRST_EVENT)
    return F.when((at > 0) & ~query.rlike(L.DATE_ATTRIBUTE) & cued, explicit_day(query))


def shown(ms: Column) -> Column:
    """ISO 8601 in UTC with Z, microseconds only if there are any; ``{ms}ms`` beyond the calendar; null stays."""
    inside = ms.between(LEAST_MS, MOST_MS)
    safe = F.when(inside, ms).otherwise(0)
    seconds = F.date_format(F.timestamp_millis(safe), "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.pmod(safe, F.lit(1000))
    told = F.concat(seconds, F.when(rest != 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 3, "0"), F.lit("000"))).otherwise(""), F.lit("Z"))
    return F.when(inside, told).when(ms.isNotNull(), F.concat(ms.cast("string"), F.lit("ms")))


def is_later(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether row ``a`` comes after ``b``: by occurrence, else ingestion, else place in the request, else row."""
    return (
        F.when(a["occurred_at"].isNotNull() & b["occurred_at"].isNotNull() & (a["occurred_at"] != b["occurred_at"]), a["occurred_at"] > b["occurred_at"])
        .when(a["created_at"] != b["created_at"], a["created_at"] > b["created_at"])
        .when((a["request_id"] == b["request_id"]) & (a["ordinal"] != b["ordinal"]), a["ordinal"] > b["ordinal"])
        .when((a["row_id"] != 0) & (b["row_id"] != 0) & (a["row_id"] != b["row_id"]), a["row_id"] > b["row_id"])
        .otherwise(F.lit(False))
    )
