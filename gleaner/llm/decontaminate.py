"""Benchmark decontamination: a prefix-filtered set join of item windows into documents.

A window is ``size`` consecutive words of an item (a shorter item is one window). Its set are its shingles of
up to SHINGLE words. Containment of a whole window needs every one of its shingles, so in any order a prefix
of one shingle is enough; the order is by rarity over all documents, which makes that the window's rarest
shingle, and a window whose rarest shingle occurs nowhere is done with. Documents are probed with every
shingle; a match fixes where the window would have to start (positional bound) and whether it fits the
document (length bound), and the window's own hash at that place verifies exact containment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bit_filter, in_batches, maybe_among, mixed, rolling, scratch, settle, text_key, word_hashes

SHINGLE = 3
#: Distinct windows that go to every task at once; a larger benchmark takes several passes.
BLOCK_WINDOWS = 500_000
#: Tasks that the rows of one text with hits are dealt to.
SALTS = 8

_KEPT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of digits, letters and bytes beyond ASCII, A-Z in lower case."""
    return (text or b"").lower().translate(_KEPT).split()


def _grams(w: np.ndarray, k: int) -> np.ndarray:
    return mixed(w) if k == 1 else rolling(w, k)


def windows_of(benchmark: DataFrame, size: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id string, whash, wlen, shingles) of each distinct window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for name, t in zip(batch["item_id"].to_pylist(), as_bytes(batch["text"]), strict=True):
                w = word_hashes(words_of(t))
                if not len(w):
                    continue
                k = min(size, len(w))
                s = min(SHINGLE, k)
                own, first = np.unique(_grams(w, k).astype(np.int64), return_index=True)
                shingles = _grams(w, s).astype(np.int64)
                for h, at in zip(own.tolist(), first.tolist(), strict=True):
                    for column, value in zip(out, (name, h, k, shingles[at : at + k - s + 1]), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["item_id", "whash", "wlen", "shingles"])

    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item_id"), F.col(text).alias("text"))
    return in_batches(named, run, "item_id string, whash bigint, wlen int, shingles array<bigint>")


class _Lookup:
    """Sorted 64-bit keys behind a small table of their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.near = np.zeros(1 << 22, bool)
        self.near[self.keys >> np.uint64(42)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes``, places in ``keys``) of the matches."""
        at = np.flatnonzero(self.near[hashes >> np.uint64(42)])
        if not len(at) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        to = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[to] == hashes[at]
        return at[same], to[same]


def _rarity(docs: DataFrame, vocabulary: dict[int, np.ndarray], text: str) -> dict[int, np.ndarray]:
    """How often each shingle of the benchmark occurs in all documents, by shingle length."""
    sent = docs.sparkSession.sparkContext.broadcast({s: _Lookup(v) for s, v in vocabulary.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = sent.value
        counts = {s: np.zeros(len(x.keys), np.int64) for s, x in lookups.items()}
        for batch in batches:
            for t in as_bytes(batch["text"]):
                w = word_hashes(words_of(t))
                for s, x in lookups.items():
                    np.add.at(counts[s], x(_grams(w, s))[1], 1)
        for s, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(at), pa.array(c[at])], ["s", "at", "n"])

    rows = in_batches(docs.select(F.col(text).alias("text")), run, "s int, at bigint, n bigint").groupBy("s", "at").agg(F.sum("n").alias("n")).toArrow()
    out = {s: np.zeros(len(v), np.int64) for s, v in vocabulary.items()}
    for s, at, n in zip(rows["s"].to_pylist(), rows["at"].to_pylist(), rows["n"].to_pylist(), strict=True):
        out[s][at] = n
    return out


def _probe(docs: DataFrame, windows: pa.Table, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h1, h2, n_words, spans, found) of every document against one block of windows."""
    lengths, shingles, hashes = windows["wlen"].to_numpy(), windows["shingles"].to_pylist(), windows["whash"].to_numpy().astype(np.uint64)
    flat = {s: [] for s in {min(SHINGLE, int(n)) for n in lengths}}
    for n, own in zip(lengths.tolist(), shingles, strict=True):
        flat[min(SHINGLE, n)] += own
    vocabulary = {s: np.unique(np.array(v, np.int64).astype(np.uint64)) for s, v in flat.items()}
    counts = _rarity(docs, vocabulary, text)
    index: dict[int, list[tuple]] = {s: [] for s in vocabulary}
    for i, (n, own) in enumerate(zip(lengths.tolist(), shingles, strict=True)):
        s = min(SHINGLE, n)
        often = counts[s][np.searchsorted(vocabulary[s], np.array(own, np.int64).astype(np.uint64))]
        offset = int(often.argmin())
        if often[offset]:
            index[s].append((own[offset], offset, n, i))
    tables = {}
    for s, rows in index.items():
        if rows:
            keys, offsets, sizes, which = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            keys = keys.astype(np.uint64)
            order = np.argsort(keys, kind="stable")
            lookup = _Lookup(keys)
            starts = np.searchsorted(keys[order], lookup.keys)
            ends = np.searchsorted(keys[order], lookup.keys, side="right")
            tables[s] = (lookup, starts, ends, offsets[order], sizes[order], hashes[which[order]])
    sent = docs.sparkSession.sparkContext.broadcast(tables)

    def matches(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, hash) of the windows that the document contains."""
        found, whole = [], {}
        for s, (lookup, starts, ends, offsets, sizes, of) in sent.value.items():
            at, key = lookup(_grams(w, s))
            if not len(at):
                continue
            many = ends[key] - starts[key]
            row = np.repeat(starts[key] - np.cumsum(many) + many, many) + np.arange(many.sum())
            start = np.repeat(at, many) - offsets[row]
            fits = (start >= 0) & (start + sizes[row] <= len(w))
            start, row = start[fits], row[fits]
            for n in np.unique(sizes[row]):
                own = whole.setdefault(int(n), _grams(w, int(n)))
                here = sizes[row] == n
                same = own[start[here]] == of[row[here]]
                found.append((start[here][same], np.full(same.sum(), n, np.int64), of[row[here]][same]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, spans, seen = [], [], []
            for t in as_bytes(batch["text"]):
                w = word_hashes(words_of(t))
                start, length, hashed = matches(w) if len(w) else (np.empty(0, np.int64),) * 3
                words.append(len(w))
                spans.append(np.unique(np.stack([start, start + length], 1), axis=0).ravel() if len(start) else None)
                seen.append(np.unique(hashed).astype(np.int64) if len(start) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(seen, pa.list_(pa.int64()))],
                ["doc_id", "h1", "h2", "n_words", "spans", "found"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), F.col(text).alias("text"))
    longs = "h1 bigint, h2 bigint, n_words bigint, spans array<bigint>, found array<bigint>"
    return in_batches(rows, run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, {longs}")


def _covered(spans):
    """How many words the flat list of (start, end) pairs covers, as a column."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), lambda i: F.struct(F.get(spans, i).alias("a"), F.get(spans, i + 1).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        pairs,
        zero,
        lambda s, p: F.struct(
            (s["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(p["a"], s["end"]))).cast("long").alias("n"), F.greatest(p["b"], s["end"]).cast("long").alias("end")
        ),
    )["n"]


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", keys: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) for every document.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` holds the ids (as sorted
    strings) of the items with such windows. Null and empty texts have no words and no windows; repeated
    items count once by id, a null id as an empty string; repeated documents are rows of their own. An
    empty benchmark leaves every document clean, an empty table stays empty; further columns are ignored.
    ``keys`` adds the text's 128-bit key (h1, h2), which tells rows of one doc_id apart.
    """
    with scratch(docs.sparkSession):
        found = _judged(docs, settle(windows_of(benchmark, size, item, item_text)), doc_id, text)
        return settle(found if keys else found.drop("h1", "h2"), outlast=True)


def _judged(docs: DataFrame, windows: DataFrame, doc_id: str, text: str) -> DataFrame:
    distinct = windows.groupBy("whash", "wlen").agg(F.first("shingles").alias("shingles"))
    blocks = max(1, -(-distinct.count() // BLOCK_WINDOWS))
    probed = [
        settle(_probe(docs, distinct.where(F.pmod(F.xxhash64("whash", "wlen"), F.lit(blocks)) == b).toArrow(), doc_id, text)) for b in range(blocks)
    ]
    hits = reduce(DataFrame.union, [p.where("found IS NOT NULL").select("h1", "h2", "spans", "found") for p in probed])
    # one row a text: copies have the same hits in each block
    texts = settle(hits.groupBy("h1", "h2").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("found")).alias("found")))
    named = (
        texts.select("h1", "h2", F.explode("found").alias("whash"))
        .join(windows.select("whash", "item_id").distinct(), "whash")
        .groupBy("h1", "h2")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    known = texts.select("h1", "h2", _covered(F.col("spans")).alias("n_hit")).join(named, ["h1", "h2"])
    rows = probed[0].select("doc_id", "h1", "h2", "n_words")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(texts, F.col("h1")))
    # rows without hits need no join; those of one text with hits go to SALTS tasks
    salted = maybe_among(rows, bits).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = salted.join(known, ["h1", "h2", "salt"], "left").select("doc_id", "n_words", "n_hit", "items", "h1", "h2")
    clean = maybe_among(rows, bits, False).select("doc_id", "n_words", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"), "h1", "h2")
    hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return met.unionByName(clean).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (hit > 0).alias("contaminated"), "h1", "h2"
    )
