"""Which hashes of which texts also stand elsewhere: an exchange of packed keys.

Every text gives entries: a 64-bit hash, the unit of the text that it belongs to, and whether it is indexed.
Entries of many texts form a chunk, are sorted by hash and travel as arrays, one row for each part of the
hash range that a chunk touches. A part's task sorts its keys; an entry is hit if its key stands there twice
or more, an indexed one among them. Units that are hit go back to their chunk.

Equal hashes of one chunk that hold an indexed one are hit without travelling: one of them goes along for the
sake of other chunks. So however often a hash occurs, a part gets it at most once a chunk (or, where none of
a chunk's occurrences is indexed, as often as it stands there). A part holds about KEYS_A_PART entries and is
sorted alone, so memory does not depend on the number of partitions; a row carries at least KEYS_A_ROW
entries until chunks of MOST_KEYS no longer suffice for that, and never more rows than entries are sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_batches, settle

#: Entries of a part, about; of a chunk, at least and at most; of a row, while chunks can be made larger.
KEYS_A_PART, CHUNK_KEYS, MOST_KEYS, KEYS_A_ROW = 2_000_000, 1 << 19, 1 << 21, 256
#: The unit of an entry that travels only for the sake of others.
_NOBODY = np.uint32(0xFFFFFFFF)
#: Bytes of results that leave a part's task together.
_OUT = 1 << 22

Entries = tuple[np.ndarray, np.ndarray, np.ndarray | None, int]


def often(keys: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    """Which keys stand there twice or more, with a marked one among their equals if ``marks`` are given."""
    order = np.argsort(keys, kind="stable")
    first = _firsts(keys[order])
    count = np.diff(np.append(first, len(keys)))
    good = count >= 2
    if marks is not None and len(keys):
        good &= np.add.reduceat(marks[order].astype(np.int64), first) > 0
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(good, count)
    return out


def _firsts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def _packed(held: list[tuple], bits: int, exact: bool) -> tuple[list[list], tuple]:
    """Rows (part, keys, units, marks) of a chunk, and its (names, units a text, units that are hit already)."""
    sizes = np.array([e[3] for *_, e in held], np.int64)
    base = np.cumsum(sizes) - sizes
    h = np.concatenate([e[0] for *_, e in held])
    units = np.concatenate([e[1].astype(np.int64) + b for (*_, e), b in zip(held, base, strict=True)]).astype(np.uint32)
    marks = np.concatenate([np.ones(len(e[0]), bool) if e[2] is None else e[2] for *_, e in held])
    order = np.argsort(h, kind="stable")
    h, units, marks = h[order], units[order], marks[order]
    first = _firsts(h)
    count = np.diff(np.append(first, len(h)))
    known = (count >= 2) & (np.add.reduceat(marks.astype(np.int64), first) > 0) if len(h) else np.empty(0, bool)
    each = np.repeat(known, count)
    hit = units[each]
    keep = ~each
    keep[first[known]] = True
    units[first[known]], marks[first[known]] = _NOBODY, True
    h, units, marks = h[keep], units[keep], marks[keep]
    part = (h >> np.uint64(64 - bits)).astype(np.int64)
    keys = h if exact else (h >> np.uint64(32 - bits)).astype(np.uint32)
    starts = _firsts(part)
    rows: list[list] = [[], [], [], []]
    for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True):
        own = None if marks[a:b].all() else np.packbits(marks[a:b]).tobytes()
        for column, value in zip(rows, (part[a], keys[a:b].tobytes(), units[a:b].tobytes(), own), strict=True):
            column.append(value)
    return rows, (np.array([n[:2] for n in held], np.int64).tobytes(), sizes.astype(np.uint32).tobytes(), np.unique(hit).tobytes())


def shared_units(texts: DataFrame, entries: Callable[..., Entries | None], keys: int, exact: bool = False, least: tuple[int, int] | None = None) -> DataFrame:
    """(h1, h2, units binary) of the texts with hits: their units (sorted, 32 bits each) that hold a hit entry.

    ``texts`` has h1, h2, text and further columns; ``entries(text, *further)`` gives (hashes, units, marks or
    None for all, number of units), or None. ``keys`` is the number of entries, about. With ``exact`` whole
    64-bit hashes meet; otherwise 32 bits beyond the part's, so that few entries are taken for hit by chance:
    no hit is missed. ``least`` (numerator, denominator) leaves out texts of which a smaller share of units is hit.
    """
    bits = max(4, (max(1, keys // KEYS_A_PART)).bit_length() + 1)
    parts = 1 << bits
    chunk_keys = min(max(CHUNK_KEYS, KEYS_A_ROW * parts), MOST_KEYS)
    names = ["part", "chunk", "keys", "units", "marks", "known"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32

        def out(held: list[tuple]) -> pa.RecordBatch:
            nonlocal chunk
            rows, (own, sizes, known) = _packed(held, bits, exact)
            chunk += 1
            columns = [[*rows[0], chunk % parts], [chunk] * (len(rows[0]) + 1), [*rows[1], own], [*rows[2], sizes], [*rows[3], None], [*[None] * len(rows[0]), known]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        held, count, units = [], 0, 0
        for batch in batches:
            for h1, h2, *row in zip(*(as_bytes(c) if pa.types.is_string(c.type) else c.to_pylist() for c in batch.columns), strict=True):
                own = entries(*row)
                if own is None or not len(own[0]):
                    continue
                held.append((h1, h2, own))
                count += len(own[0])
                units += own[3]
                if count >= chunk_keys or units >= 1 << 31:
                    yield out(held)
                    held, count, units = [], 0, 0
        if held:
            yield out(held)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint64 if exact else np.uint32
        result: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal size
            columns = zip(*result, strict=True) if result else [[]] * 4
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kinds[1], *kinds[2:5]), strict=True)], ["chunk", "texts", "sizes", "hits"])
            result.clear()
            size = 0
            return made

        def judged(rows: list[dict]) -> None:
            nonlocal size
            keys = [np.frombuffer(r["keys"], kind) for r in rows]
            marks = None
            if any(r["marks"] is not None for r in rows):
                marks = np.concatenate(
                    [np.ones(len(k), bool) if r["marks"] is None else np.unpackbits(np.frombuffer(r["marks"], np.uint8), count=len(k)).astype(bool) for r, k in zip(rows, keys, strict=True)]
                )
            hit = often(np.concatenate(keys), marks)
            for r, own in zip(rows, np.split(hit, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
                units = np.unique(np.frombuffer(r["units"], np.uint32)[own])
                units = units[units != _NOBODY]
                if len(units):
                    result.append((r["chunk"], None, None, units.tobytes()))
                    size += units.nbytes

        part, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["known"] is not None:
                    result.append((r["chunk"], r["keys"], r["units"], r["known"]))
                    size += len(r["keys"]) + len(r["known"])
                    continue
                if r["part"] != part and held:
                    judged(held)
                    held = []
                    if size >= _OUT:
                        yield out()
                part = r["part"]
                held.append(r)
        if held:
            judged(held)
        yield out()

    sent = in_batches(texts, send, "part bigint, chunk bigint, keys binary, units binary, marks binary, known binary")
    back = settle(in_batches(sent.repartition("part").sortWithinPartitions("part"), met, "chunk bigint, texts binary, sizes binary, hits binary"))
    hits = back.where("texts IS NULL").groupBy("chunk").agg(F.collect_list("hits").alias("more"))
    both = back.where("texts IS NOT NULL").join(hits, "chunk", "left").select("texts", "sizes", "hits", "more")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
                ends = np.cumsum(sizes)
                hit = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in (row["hits"], *(row["more"] or ()))])).astype(np.int64)
                owner = np.searchsorted(ends, hit, side="right")
                own = np.frombuffer(row["texts"], np.int64).reshape(-1, 2)
                which, first = np.unique(owner, return_index=True)
                count = np.diff(np.append(first, len(hit)))
                good = np.flatnonzero(count * least[1] >= sizes[which] * least[0]) if least else np.arange(len(which))
                found = [(hit[first[i] : first[i] + count[i]] - (ends[which[i]] - sizes[which[i]])).astype(np.uint32).tobytes() for i in good]
                yield pa.RecordBatch.from_arrays([pa.array(own[which[good], 0]), pa.array(own[which[good], 1]), pa.array(found, pa.binary())], ["h1", "h2", "units"])

    return in_batches(both, told, "h1 bigint, h2 bigint, units binary")
