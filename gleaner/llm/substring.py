"""Substring deduplication by fixed-block anchors.

A repeated window of ``size`` words holds, wherever it stands, one whole block of (size + 1) // 2 words that
begins at a multiple of the block's length. Those non-overlapping blocks of every document are the index;
every rolling window of a block's length of every document is a probe. Probes and index meet by hash
(meet.py). A probe that meets an indexed block standing elsewhere is an anchor. Anchors are extended: each
``size``-word window around one is looked up among all such windows by its whole hash, and those that start
at least twice, joined where they overlap, are the maximal exact repeats, whose words go.

The unit is a distinct text; a text with copies repeats as a whole, so copies are never paired with one
another. Segments of texts, not probes, are reported back by the first lookup, and the windows of one text
by the second, so nothing that the lookups return grows with the number of times a passage repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import as_bytes, bit_filter, copied_texts, distinct_texts, in_batches, in_filter, maybe_among, rolling, scratch, settle, text_key, word_hashes
from .meet import shared_units

#: Words of a text that the first lookup reports together.
SEGMENT = 64


def _anchored(texts: DataFrame, size: int) -> DataFrame:
    """(h1, h2, units) of the texts with anchors: the segments in which an anchor starts."""
    block = (size + 1) // 2
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def probes(text: bytes | None):
        words = (text or b"").split()
        if len(words) < size:
            return None
        h = rolling(word_hashes(words), block)
        at = np.arange(len(h), dtype=np.uint32)
        return h, at // SEGMENT, at % block == 0, (len(h) - 1) // SEGMENT + 1

    return settle(shared_units(texts, probes, total // 6))


def _repeats(texts: DataFrame, size: int) -> DataFrame:
    """(h1, h2, spans) of the texts with repeats: (start, end) pairs of the words to remove, as 64-bit integers."""
    block = (size + 1) // 2
    anchored = _anchored(texts, size)
    bits = texts.sparkSession.sparkContext.broadcast(bit_filter(anchored, F.col("h1")))
    near = settle(maybe_among(texts, bits).join(anchored, ["h1", "h2"]).select("h1", "h2", "text", "units"))
    segments = anchored.agg(F.sum(F.octet_length("units"))).first()[0] or 0

    def windows(text: bytes | None, segs: bytes):
        w = word_hashes((text or b"").split())
        n = len(w) - size + 1
        around = np.zeros(n + 1, np.int64)
        low = np.frombuffer(segs, np.uint32).astype(np.int64) * SEGMENT
        np.add.at(around, np.maximum(low - (size - block), 0).clip(max=n), 1)
        np.add.at(around, (low + SEGMENT).clip(max=n), -1)
        starts = np.flatnonzero(np.cumsum(around)[:n] > 0)
        return rolling(w, size)[starts], starts.astype(np.uint32), None, n

    again = shared_units(near, windows, segments // 4 * SEGMENT, exact=True)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for units in batch["units"].to_pylist():
                own = np.frombuffer(units, np.uint32).astype(np.int64)
                cut = np.flatnonzero(own[1:] > own[:-1] + size) + 1
                out.append(np.stack([own[np.append(0, cut)], own[np.append(cut - 1, len(own) - 1)] + size], 1).tobytes())
            yield pa.RecordBatch.from_arrays([batch["h1"], batch["h2"], pa.array(out, pa.binary())], ["h1", "h2", "spans"])

    return in_batches(again, spans, "h1 bigint, h2 bigint, spans binary")


def remove_repeats(docs: DataFrame, size: int = 35, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text: every word in a repeated window of ``size`` words removed.

    A window is repeated if its words also start anywhere else, in another row or the same text; windows
    are judged on the input. ``kept_text`` joins the kept words by single spaces. A null text has no words;
    texts of fewer than ``size`` words lose none; a repeated row repeats all its windows. An empty table
    stays empty. Columns of ``docs`` by the names of the results are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    docs = docs.select(*names)
    own = docs.select(F.col(text).alias("text"))
    with scratch(docs.sparkSession):
        copies = copied_texts(own)
        found = settle(copies.join(_repeats(distinct_texts(own, copies), size), ["h1", "h2"], "full").select("h1", "h2", "m", "spans"), outlast=True)
    keyed = docs.select(*text_key(F.col(text)), F.struct(*names).alias("_row"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(found, F.col("h1")))
    touched = maybe_among(keyed, bits).join(found, ["h1", "h2"], "left").select("_row", "m", "spans")

    def cut(rows: pa.Array, copies: list, repeats: list) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for t, m, spans in zip(as_bytes(rows.field(text)), copies, repeats, strict=True):
            words = (t or b"").split()
            kept = words
            if m is not None and len(words) >= size:
                kept = []
            elif spans is not None:
                kept, at = [], 0
                for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
                    kept += words[at:a]
                    at = b
                kept += words[at:]
            for column, value in zip(out, (len(words), len(words) - len(kept), b" ".join(kept)), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary())
        n_words, n_removed, kept_text = (pa.array(c, k) for c, k in zip(out, kinds, strict=True))
        return pa.RecordBatch.from_arrays([rows, n_words, n_removed, kept_text.cast(pa.string())], ["_row", "n_words", "n_removed", "kept_text"])

    def cut_touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield cut(batch["_row"], batch["m"].to_pylist(), batch["spans"].to_pylist())

    def cut_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch["_row"].filter(pa.array(~in_filter(bits.value, batch["h1"].to_numpy())))
            yield cut(rows, [None] * len(rows), [None] * len(rows))

    schema = StructType([keyed.schema["_row"]]).add("n_words", LongType()).add("n_removed", LongType()).add("kept_text", StringType())
    done = in_batches(touched, cut_touched, schema).union(in_batches(keyed, cut_others, schema))
    return done.select(*(F.col("_row")[c].alias(c) for c in names), "n_words", "n_removed", "kept_text")
