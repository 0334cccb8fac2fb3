"""Audits over text and URLs: literal secrets, addresses that are not public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon


def secret_kinds(text: Column) -> Column:
    """Names of the kinds of secret that a text holds, never the secrets."""
    return F.array_compact(F.array(*(F.when(text.rlike(pattern), F.lit(kind)) for kind, pattern in lexicon.SECRETS.items())))


def secret_scan(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind): one row for each kind of secret in each text."""
    return rows.select(F.col(key), F.explode(secret_kinds(F.col(text))).alias("kind"))


def is_public_url(url: Column) -> Column:
    """HTTPS, a host with a dot, no user, no local or private host."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^https://([^/?#:@]+)(?::\d+)?(?:[/?#]|$)", 1), F.lit("")))
    local = host.rlike(r"^(?:localhost|127\..*|10\..*|192\.168\..*|172\.(?:1[6-9]|2\d|3[01])\..*|169\.254\..*|0\.0\.0\.0)$") | host.endswith(".local") | host.endswith(".internal")
    return F.coalesce(F.contains(host, F.lit(".")) & ~local, F.lit(False))
