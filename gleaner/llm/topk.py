"""Exact top-k by inner product over a pivot-distance index.

Vectors become integers (floor of scale * x). One more coordinate, sqrt(M^2 - |x|^2) with M the largest
norm, makes the largest inner product the nearest neighbour: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. The index
keys every vector by its nearest pivot and its distance to it and keeps each pivot's vectors sorted by
distance, cut into annuli of consecutive rows. By the triangle inequality no vector of an annulus scores
more than (|q|^2 + M^2 - gap^2) / 2, gap being how far the query's own distance to the pivot lies from the
annulus. Each query expands outward from its own place, annulus by annulus in order of that bound, and stops
at the first one whose bound is below its k-th best score; queries that are at the same annulus are scored
together. Bounds are floating point with a margin; scores are exact integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, settle, shared_folder

#: Vectors that the pivots and the first thresholds are taken from.
SAMPLE = 2048
PIVOTS = 48
#: Vectors in an annulus at most.
ANNULUS = 512
#: Queries that go to every task at once.
QUERY_BLOCK = 4096


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products, queries by vectors."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    width = queries.shape[1]
    most = float(np.abs(queries).max()) * float(np.abs(vectors).max()) * width
    if most < 2**52:  # every partial sum is then exact in a double
        return np.rint(queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    whole = queries.astype(object) @ vectors.astype(object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def _lifted(vectors: np.ndarray, norm2: float) -> np.ndarray:
    v = vectors.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(norm2 - (v * v).sum(1), 0))[:, None]])


def _far_apart(points: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` of the points, each the farthest from those before it."""
    chosen, gap = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(d2, 0))


#: Stands for a null id: it sorts last.
_NO_ID = np.iinfo(np.int64).max


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows for every row that ``is_query`` holds for.

    Candidates are all rows but the query's own row; a repeated row or id is a row of its own, as query and
    as candidate. Ties go to the smaller id, a null id last. Vectors that are null or hold a null, infinite
    or NaN component take no part; a shorter vector counts as padded with zeros; scores beyond 64 bits stop
    at their ends. Fewer candidates than ``k`` give fewer rows, an empty table none.
    """
    with scratch(vectors.sparkSession):
        return _found(vectors, is_query, k, id_col, vector, scale)


def _found(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector: str, scale: int) -> DataFrame:
    spark = vectors.sparkSession
    x = F.col(vector)
    sound = x.isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.where(sound).select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("row"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("v"),
    )
    rows = settle(rows)
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    norm2, width = rows.agg(F.max(norm), F.max(F.size("v"))).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if norm2 is None:
        return spark.createDataFrame([], schema)

    def matrix(lists: list) -> np.ndarray:
        out = np.zeros((len(lists), width), np.int64)
        for i, values in enumerate(lists):
            out[i, : len(values)] = values
        return out

    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("row", "v").toArrow().to_pydict()
    seen, seen_rows = matrix(sample["v"]), np.array(sample["row"])
    pivots = _far_apart(_lifted(seen, norm2), PIVOTS)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_lifted(matrix(batch["v"].to_pylist()), norm2), pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["asks"], batch["row"], batch["v"], pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])],
                ["id", "asks", "row", "v", "pivot", "distance"],
            )

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: pa.Table) -> pa.RecordBatch:
            d, ids = part["distance"].to_numpy(), part["id"]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part["pivot"][0].as_py()], pa.int32()),
                    *(pa.array([x], pa.float64()) for x in (d[0], d[-1])),
                    pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                    pa.array([part["row"].to_numpy().tobytes()], pa.binary()),
                    pa.array([matrix(part["v"].to_pylist()).tobytes()], pa.binary()),
                ],
                ["pivot", "low", "high", "ids", "rows", "vectors"],
            )

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cuts = np.flatnonzero(np.diff(held["pivot"].to_numpy())) + 1
            start = 0
            for end in [*cuts, len(held)]:
                while end - start >= ANNULUS or (end < len(held) and end > start):
                    n = min(ANNULUS, end - start)
                    yield out(held.slice(start, n))
                    start += n
            held = held.slice(start)
        if held is not None and len(held):
            yield out(held)

    keyed = rows.mapInArrow(key, "id bigint, asks boolean, row bigint, v array<bigint>, pivot int, distance double")
    index = settle(
        keyed.repartitionByRange("pivot", "distance", "row")
        .sortWithinPartitions("pivot", "distance", "row")
        .mapInArrow(annuli, "pivot int, low double, high double, ids array<bigint>, rows binary, vectors binary")
    )

    def answers(asked: pa.Table) -> DataFrame:
        asking, asking_rows, q = asked["id"].fill_null(_NO_ID).to_numpy(), asked["row"].to_numpy(), matrix(asked["v"].to_pylist())
        base = _exact(q, seen)
        base[asking_rows[:, None] == seen_rows[None, :]] = np.iinfo(np.int64).min
        floor = np.sort(base, axis=1)[:, -k] if base.shape[1] >= k else np.full(len(q), np.iinfo(np.int64).min)
        if not len(q):
            return spark.createDataFrame([], "row bigint, query_id bigint, vec_id bigint, score bigint")
        sent = spark.sparkContext.broadcast((q, asking, asking_rows, floor, _distances(np.hstack([q.astype(np.float64), np.zeros((len(q), 1))]), pivots)))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, asking, asking_rows, floor, far = sent.value
            reach, floor = (q.astype(np.float64) ** 2).sum(1) + norm2, floor.copy()
            best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
            for batch in batches:
                blocks = batch.to_pylist()
                low, high = np.array([b["low"] for b in blocks]), np.array([b["high"] for b in blocks])
                d = far[:, [b["pivot"] for b in blocks]]
                gap = np.maximum(0, np.maximum(low[None, :] - d, d - high[None, :]) - 1e-6 * (1 + d))
                bound = (reach[:, None] - gap * gap) / 2 * (1 + 1e-9) + 1
                outward = np.argsort(-bound, axis=1, kind="stable")
                asks = np.arange(len(q))
                for step in range(len(blocks)):
                    at = outward[asks, step]
                    going = bound[asks, at] >= floor[asks]
                    asks, at = asks[going], at[going]
                    if not len(asks):
                        break
                    order = np.argsort(at, kind="stable")
                    for ask in np.split(asks[order], np.flatnonzero(np.diff(at[order])) + 1):
                        block = blocks[outward[ask[0], step]]
                        ids = np.array([_NO_ID if i is None else i for i in block["ids"]], np.int64)
                        here = np.frombuffer(block["rows"], np.int64)
                        scores = _exact(q[ask], np.frombuffer(block["vectors"], np.int64).reshape(len(here), width))
                        for i, row in zip(ask, scores, strict=True):
                            good = np.flatnonzero((row >= floor[i]) & (here != asking_rows[i]))
                            if len(good):
                                s, n = np.concatenate([best[i][0], row[good]]), np.concatenate([best[i][1], ids[good]])
                                top = np.lexsort((n, -s))[:k]
                                best[i] = (s[top], n[top])
                                if len(top) == k:
                                    floor[i] = max(floor[i], s[top[-1]])
            each = [len(s) for s, _ in best]
            ids = np.concatenate([n for _, n in best])
            columns = [
                pa.array(np.repeat(asking_rows, each)),
                pa.array(np.repeat(asking, each), mask=np.repeat(asking, each) == _NO_ID),
                pa.array(ids, mask=ids == _NO_ID),
                pa.array(np.concatenate([s for s, _ in best])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "query_id", "vec_id", "score"])

        return index.mapInArrow(search, "row bigint, query_id bigint, vec_id bigint, score bigint")

    asks = rows.where("asks").select("id", "row", "v")
    path, blocks = f"{shared_folder(spark)}/top-{uuid.uuid4().hex}", max(1, -(-asks.count() // QUERY_BLOCK))
    for b in range(blocks):  # the stated queries against all rows, block by block, each block's answers written
        first = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        found = answers(asks.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()).select("*", F.row_number().over(first).alias("rank"))
        found.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
