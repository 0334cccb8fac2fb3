"""Turning an operator's verdicts into a smaller table of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, in_batches, in_filter, settle, text_key


def _row(names: list[str]) -> list:
    """What tells rows apart: the doc_id, and the text's key where the verdicts have it."""
    return [F.col("doc_id"), *(text_key(F.col("text")) if "h1" in names else [])]


def _parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` whose row is surely not among ``ids``, and the others: only those need an exact join."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(ids, F.xxhash64(*ids.columns)))

    def run(inside: bool):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_filter(bits.value, batch["_key"].to_numpy()) == inside))

        return keep

    keyed = docs.select(F.xxhash64(*_row(ids.columns)).alias("_key"), F.struct(*docs.columns).alias("_row"))
    back = lambda df: df.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
    return tuple(back(in_batches(keyed, run(inside), keyed.schema)) for inside in (False, True))


def _but(docs: DataFrame, ids: DataFrame) -> DataFrame:
    own = docs.select("*", *(c.alias(f"_own{i}") for i, c in enumerate(_row(ids.columns))))
    gone = ids.toDF(*(f"_gone{i}" for i in range(len(ids.columns))))
    same = [F.col(f"_own{i}").eqNullSafe(F.col(f"_gone{i}")) for i in range(len(ids.columns))]
    return own.join(gone, same, "left_anti").select(*docs.columns)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the rows among ``ids``: (doc_id, h1, h2), or only doc_id where that tells rows apart.

    Null equals null. Repeated rows share a verdict.
    """
    ids = settle(ids.select(*_named(ids)).distinct())
    sure, unsure = _parted(docs, ids)
    return sure.unionByName(_but(unsure, ids))


def _named(ids: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "h1", "h2") if c in ids.columns]


def one_of_each(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """One document of each component: the row that ``linked`` (doc_id, h1, h2, first) marks as its first.

    Documents without words are components of their own and stay. Of rows that repeat a doc_id and a text,
    one stays. Where a doc_id tells rows apart, ``linked`` may be (doc_id, component_id): the document stays
    that names its component.
    """
    names = _named(linked)
    other = ~F.col("first") if "first" in linked.columns else ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    linked = settle(linked.select(*names, other.alias("other")))
    gone = settle(linked.where("other").select(*names).distinct())
    repeated = linked.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").select(*names)
    sure, unsure = _parted(docs, gone.union(repeated))
    return sure.unionByName(_but(unsure, gone).dropDuplicates(["doc_id", "text"]))
