"""Retrieval metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recall_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant ids among the first ``k`` retrieved; 0 without relevant ids."""
    hit = F.size(F.array_intersect(F.array_distinct(F.slice(retrieved, 1, k)), relevant))
    return F.when(F.size(relevant) > 0, hit / F.size(F.array_distinct(relevant))).otherwise(0.0)


def mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def percentile(c: Column, p: float) -> Column:
    """Nearest-rank percentile of a group, ranks rounded half to even; 0 for an empty group."""
    values = F.array_sort(F.collect_list(c.cast("double")))
    n = F.size(values)
    rank = F.bround(F.lit(p / 100.0) * n + 0.5).cast("int")
    return F.coalesce(F.get(values, F.least(F.greatest(rank - 1, F.lit(0)), n - 1)), F.lit(0.0))


def upper_median(c: Column) -> Column:
    values = F.array_sort(F.collect_list(c.cast("double")))
    return F.coalesce(F.get(values, F.floor(F.size(values) / 2).cast("int")), F.lit(0.0))
