"""What the two classifiers share: the labelled sample, sparse rows of 32-bit feature ids, and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import as_bytes, in_batches, trim

#: Labelled rows that a classifier is fitted on at most: those first by a hash of their id.
TRAIN_ROWS = 5000
#: Rows of the sample that a feature must be seen in.
SEEN = 2
#: Entries of the sample's rows that are summed at once.
BLOCK = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Rows kept for evaluation: crc32 of the id as text, modulo 5, is 0; also rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, y) of at most ``rows`` labelled ids outside the held-out fold; the least of differing labels."""
    own = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sample_features(docs: DataFrame, sample: DataFrame, features: Callable[[bytes], np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature ids (sorted, distinct) and labels of the sampled documents, one row an id (of repeated ids the least text).

    The sample is bounded, so it is broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or b"").tobytes() for t in as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array(found, pa.binary())], ["doc_id", "y", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
    rows = in_batches(picked, run, f"doc_id {kind}, y int, f binary").toArrow().to_pylist()
    trim()
    rows.sort(key=lambda r: (r["doc_id"], r["f"]))  # the fit does not depend on the order of tasks
    return [np.frombuffer(r["f"], np.uint32) for r in rows], np.array([r["y"] for r in rows], np.int64)


class Sparse:
    """Rows of feature ids over a kept vocabulary, as one flat array."""

    def __init__(self, rows: list[np.ndarray]):
        # most features are seen once: they go before anything is sorted, as their bucket is seen once
        often = np.zeros(1 << 24, np.uint8)
        for r in rows:
            often[r >> 8] = np.minimum(often[r >> 8] + 1, SEEN)
        rows = [r[often[r >> 8] >= SEEN] for r in rows]
        size = [len(r) for r in rows]
        flat = np.concatenate(rows) if rows else np.empty(0, np.uint32)
        del rows, often
        ids, counts = np.unique(flat, return_counts=True)
        self.ids = ids[counts >= SEEN]
        self.columns, ends, end, at = np.empty(len(flat), np.int32), [], 0, 0
        for n in size:
            own = found(self.ids, flat[at : at + n])
            self.columns[end : end + len(own)] = own
            at, end = at + n, end + len(own)
            ends.append(end)
        self.columns = self.columns[:end]
        self.rows = np.split(self.columns, ends[:-1]) if size else []
        self.owner = np.repeat(np.arange(len(size), dtype=np.int16 if len(size) < 1 << 15 else np.int32), [len(r) for r in self.rows])

    def _blocks(self):
        return (slice(a, a + BLOCK) for a in range(0, len(self.columns), BLOCK))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return sum((np.bincount(self.owner[b], w[self.columns[b]], minlength=len(self.rows)) for b in self._blocks()), np.zeros(len(self.rows)))

    def back(self, v: np.ndarray) -> np.ndarray:
        return sum((np.bincount(self.columns[b], v[self.owner[b]], minlength=len(self.ids)) for b in self._blocks()), np.zeros(len(self.ids)))


def found(ids: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Places in the sorted ``ids`` of those features that are among them."""
    if not len(ids):
        return np.empty(0, np.int32)
    at = np.minimum(np.searchsorted(ids, features), len(ids) - 1)
    return at[ids[at] == features].astype(np.int32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def scored(docs: DataFrame, features: Callable[[bytes], np.ndarray], score: Callable[[np.ndarray], float], model, threshold: float) -> DataFrame:
    """``docs`` with held_out, score and predicted. ``model`` is sent once; ``score(model, features)`` gives a probability.

    Rows go to Python and back as they are, a bounded number at a time, the text among them once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    trim()
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    given = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict = {}
            out = []
            for t in as_bytes(batch["text"]):
                if (s := known.get(t)) is None:
                    s = known[t] = float(score(sent.value, features(t or b"")))
                out.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    out = in_batches(given, run, StructType([*given.schema.fields]).add("score", DoubleType()))
    return out.select(*names, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
