"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Bounded-space online best fit: a task holds at most ``open_bins`` open bins, found through a bitset keyed by
free space (the lowest set bit at or above a piece's length is the tightest bin), and closes the fullest one
when it needs room for another. A second pass packs the bins that tasks of the first left open, as pieces of
their fill, so that what many tasks leave does not add up.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, scratch, settle

CAPACITY = 1024
OPEN_BINS = 4096
#: Pieces that one task packs, about; more pieces make more tasks.
PIECES_A_TASK = 100_000
#: Tasks whose open bins are packed together.
TASKS_TOGETHER = 64

PIECE = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Token ids of byte_bpe_50k as ``tokenizers`` gives them, with ``end`` after each text.

    Texts without a special token's string are encoded from the same vocabulary's ranks, which gives the same
    ids several times as fast; the others go through ``tokenizers`` itself, which is loaded for the first of them.
    """

    def __init__(self, end: int = 2, name: str = "byte_bpe_50k"):
        import public_tokenizers as public
        import tiktoken

        self.path = public.path(f"{name}.json")
        with open(public.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(self.path, encoding="utf-8") as file:
            held = file.read()
        added, _ = json.JSONDecoder().raw_decode(held, held.index("[", held.index('"added_tokens"')))
        self.special = [t["content"] for t in added]
        self.end = np.array([end], np.uint32)

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.concatenate([np.array(ids, "<u4"), self.end]).astype("<u4")


@cache
def _encoder() -> Encoder:
    """One encoder a Python worker."""
    return Encoder()


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document; only one that is too long is cut, its first piece short."""
    first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


class Packer:
    """Bounded-space online best fit; ``put`` yields bins as they close, ``rest`` those still open."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most, self.bits, self.count = capacity, open_bins, 0, 0
        self.bins: list[list[list]] = [[] for _ in range(capacity + 1)]  # by free space

    def _take(self, free: int) -> list:
        found = self.bins[free].pop()
        self.count -= 1
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        return found

    def put(self, item, length: int) -> Iterator[tuple[list, int]]:
        if fitting := self.bits >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            target = self._take(free)
        else:
            if self.count >= self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                yield self._take(fullest), self.capacity - fullest
            free, target = self.capacity, []
        target.append(item)
        if free == length:
            yield target, self.capacity
        else:
            self.bins[free - length].append(target)
            self.bits |= 1 << (free - length)
            self.count += 1

    def rest(self) -> Iterator[tuple[list, int]]:
        for free, bins in enumerate(self.bins):
            for held in bins:
                yield held, self.capacity - free


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's token ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder()
        for batch in batches:
            each, found, known = [], [], {}
            for t in batch["text"].to_pylist():
                if (own := known.get(t)) is None:
                    own = known[t] = pieces_of(encoder.ids(t or ""), capacity)
                each.append(len(own))
                found += own
            columns = np.array(found, np.int64).reshape(-1, 4).T
            ids = batch["doc_id"].take(pa.array(np.repeat(np.arange(len(each)), each)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(columns[0].astype(np.int32)), *(pa.array(c) for c in columns[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).transform(in_batches, encode, PIECE.format(id=kind))


def pack(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece.

    A null or empty text is its end token alone. Repeated rows are documents of their own. A full piece is
    a sequence by itself. Every sequence is gapless from offset 0. A null doc_id is kept. An empty table
    gives an empty result; further columns are ignored.
    """
    with scratch(docs.sparkSession):
        return settle(_packed(settle(token_pieces(docs, capacity, doc_id, text)), capacity, open_bins), outlast=True)


def _packed(pieces: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    kind = pieces.schema["doc_id"].dataType.simpleString()
    whole = pieces.where(F.col("length") == capacity).select(
        "*", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < capacity)
    tasks = max(1, -(-rest.count() // PIECES_A_TASK))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    bins = f"at bigint, fill int, open boolean, pieces array<struct<{PIECE.format(id=kind).replace(' ', ':').replace(',:', ',')}>>"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, shape = Packer(capacity, open_bins), None

        def out(found: list, still_open: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([b[0]["_task"] for b, _ in found], pa.int64()),
                    pa.array([fill for _, fill in found], pa.int32()),
                    pa.array([still_open] * len(found), pa.bool_()),
                    pa.array([[{n: p[n] for n in names} for p in b] for b, _ in found], pa.list_(shape)),
                ],
                ["at", "fill", "open", "pieces"],
            )

        for batch in batches:
            shape = pa.struct([batch.schema.field(n) for n in names])
            closed = [c for p in batch.to_pylist() for c in packer.put(p, p["length"])]
            yield out(closed, False)
        if shape is not None:
            yield out(list(packer.rest()), True)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, shape = Packer(capacity, open_bins), None
        task, made = None, 0

        def out(found: list) -> pa.RecordBatch:
            nonlocal made
            rows = []
            for b, _ in found:
                offset = 0
                for p in (p for held in b for p in held):
                    rows.append(p | {"sequence_id": (task << 33 | made) * 2, "offset": offset})
                    offset += p["length"]
                made += 1
            fields = [*shape, pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())]
            return pa.RecordBatch.from_pylist(rows, pa.schema(fields))

        for batch in batches:
            shape = list(batch.schema.field("pieces").type.value_type)
            closed = []
            for row in batch.to_pylist():
                task = row["task"]
                closed += packer.put(row["pieces"], row["fill"]) if row["open"] else [([row["pieces"]], row["fill"])]
            yield out(closed)
        if shape is not None:
            yield out(list(packer.rest()))

    # pieces arrive in an order of their own, by hash, however the table is cut into files and batches
    ordered = rest.repartition(tasks).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "length")
    packed = in_batches(ordered.withColumn("_task", F.spark_partition_id().cast("long")), first, bins)
    group = F.when(F.col("open"), F.floor(F.col("at") / TASKS_TOGETHER)).otherwise(F.col("at"))
    packed = packed.repartition(tasks, "open", group).sortWithinPartitions("open", "at", F.desc("fill"), F.col("pieces")[0])
    packed = in_batches(packed.withColumn("task", F.spark_partition_id().cast("long")), second, PIECE.format(id=kind) + ", sequence_id bigint, offset bigint")
    return packed.unionByName(whole)
