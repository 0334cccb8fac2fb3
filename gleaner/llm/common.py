"""What the training-data operators share: shared-folder tables, word hashes, bit filters, components.

Identity by hash: words, shingles and windows are compared through 64-bit hashes, whole texts and whole
sets through 128-bit ones. Nothing here is kept in a machine-local folder; tables that cut lineage go to
the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a membership filter that goes to every task: least and most (16 MiB), and bits a key in between.
FILTER_LEAST, FILTER_MOST, FILTER_SPREAD = 1 << 20, 1 << 27, 16
#: Rows that a task's Python code sees at once.
STEP = 1000
#: Distinct words whose hashes a task remembers at once, and the bytes of the longest.
CACHE_WORDS, LONGEST = 150_000, 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a session of one machine gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="gleaner-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile at most STEP rows go to Python at once: else a worker and its JVM each hold 10,000 whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, STEP if int(before) <= 0 else min(int(before), STEP))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Lists of tables to remove, innermost last; each thread has its own.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def settle(df: DataFrame, outlast: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: computed once, safe from lost executors.

    Within scratch() the table goes when that ends; with ``outlast``, when the scratch() around that one ends,
    or stays, as checkpoints do, where there is none. ``discard`` removes it earlier.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    held = _SCRATCH.get()[: -1 if outlast else None]
    if held:
        held[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def _remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame | None) -> None:
    """Remove the table that settle() wrote for ``df``; nothing lazy may still need it."""
    if df is not None and getattr(df, "settled_at", None):
        _remove(df.sparkSession, df.settled_at)


def hand_back(spark: SparkSession) -> None:
    """Executors collect their garbage and give heap that is not in use back to the machine.

    A JVM keeps the heap that it once touched, up to all it may have, while the next step's Python workers
    and buffers come on top.
    """
    slots = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, slots, 1, slots).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that settle() writes meanwhile are removed at the end; nothing lazy may still need them.

    The outermost one also hands back memory.
    """
    own: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), own))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for name in own:
            _remove(spark, name)
    if not _SCRATCH.get():
        hand_back(spark)


def trim() -> None:
    """Give memory that is not in use back to the machine: Python workers outlive their tasks, the driver its fits."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not a glibc
        pass


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def in_batches(df: DataFrame, run: Run, schema) -> DataFrame:
    """mapInArrow with at most STEP rows a batch, whatever the session's setting; freed memory is given back.

    On what in_batches() returned, both run in one pass: a task has one Python worker instead of two, and
    texts cross over once.
    """
    df, before = getattr(df, "passed", (df, []))
    runs = [*before, run]

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = lambda given: (b.slice(at, STEP) for b in given for at in range(0, b.num_rows, STEP))
        try:
            for each in runs:
                batches = each(sliced(batches))
            yield from batches
        finally:
            trim()

    out = df.mapInArrow(bounded, schema)
    out.passed = (df, runs)
    return out


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered for up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One memory a Python worker, whatever operators it runs in turn.
WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return WORDS.of(words)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX2
    return h ^ (h >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes, in order; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= _ODD
        out += hashes[i : n + i]
    return mixed(out ^ np.uint64(k))


def bit_filter(keys: DataFrame, key) -> np.ndarray:
    """Membership bits of the 64-bit ``key`` column of a written table: at most FILTER_MOST, 16 MiB.

    A key that was put in is always found; others are found by chance, more often the more keys there are.
    It only spares work: every use is followed by an exact join, which the input's size bounds. The bits are
    merged by the executors and reach the driver as at most FILTER_MOST / 64 rows.
    """
    size = 1 << int(np.clip(FILTER_SPREAD * max(keys.count(), 1), FILTER_LEAST, FILTER_MOST) - 1).bit_length()
    bit = F.pmod(key, F.lit(size))
    words = (
        keys.select(F.shiftright(bit, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(size // 64, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the signed 64-bit ``keys`` may be in the filter."""
    at = np.mod(keys, len(bits) * 64)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def maybe_among(docs: DataFrame, bits, yes: bool = True) -> DataFrame:
    """Rows of ``docs`` (with a column h1) whose h1 may be in the broadcast filter; with ``yes`` False the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(bits.value, batch["h1"].to_numpy()) == yes))

    return in_batches(docs, run, docs.schema)


def copied_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h1, h2, m) of the texts that stand in several rows of ``docs``, as a written table."""
    return settle(docs.select(*text_key(F.col(text))).groupBy("h1", "h2").agg(F.count("*").alias("m")).where("m > 1"))


def distinct_texts(docs: DataFrame, copies: DataFrame, text: str = "text") -> DataFrame:
    """(h1, h2, text) of each distinct text of ``docs``; only ``copies``, copied_texts() of them, are shuffled."""
    keyed = docs.select(*text_key(F.col(text)), F.col(text).alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(copies, F.col("h1")))
    # a written table, so that a task that runs again sees the same rows in the same order
    one_each = settle(maybe_among(keyed, bits).dropDuplicates(["h1", "h2"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single = pa.array(~in_filter(bits.value, batch["h1"].to_numpy()))
            yield batch.select(["h1", "h2", "text"]).filter(pc.or_(batch["chosen"], single))

    rows = keyed.withColumn("chosen", F.lit(False)).unionByName(one_each.withColumn("chosen", F.lit(True)))
    return in_batches(rows, run, keyed.schema)


def text_key(text) -> list:
    """Two 64-bit hash columns, h1 and h2, that stand for a whole text (null as empty)."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b), any orderable type: (node, root), root the least node.

    Each round gives every component the least label next to it and contracts the edges, so the number of
    rounds is logarithmic for stars and short chains; what is left is written to the shared folder each time.
    """
    with scratch(edges.sparkSession):
        return _components(edges)


def _components(edges: DataFrame) -> DataFrame:
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = settle(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        near = edges.select("a", "b").union(edges.select("b", "a")).toDF("c", "o").groupBy("c").agg(F.min("o").alias("o"))
        step = near.select("c", F.least("c", "o").alias("m"))
        jump = settle(step.alias("x").join(step.alias("y"), F.col("x.m") == F.col("y.c"), "left").select("x.c", F.coalesce("y.m", "x.m").alias("m")))
        labels = settle(labels.join(jump, labels.root == jump.c, "left").select("node", F.coalesce("m", "root").alias("root")))
        x, y = jump.toDF("a", "ra"), jump.toDF("b", "rb")
        edges = settle(
            edges.join(x, "a").join(y, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
    return settle(labels, outlast=True)
