"""N-gram Jaccard join by grouped prefixes.

A document is the set of its word shingles. Shingles are ordered by rarity: first those that only one text
has, found exactly (meet.py), then the others by the logarithm of how often their bucket of BUCKETS occurs,
then by hash. Two sets that are similar enough share a shingle within each one's first
``n - ceil(threshold * n) + 1``, its prefix; what only one text has is shared with nothing, so a text with
that many such shingles is done with, and only the shared rest of a prefix is ever joined. Documents with
identical prefixes and size collapse into one group; prefixes of groups, not of documents, are joined. Group
pairs that pass the filters are expanded into their members, distinct sets, and every candidate pair of sets
is verified exactly on the whole sets.

Components need links enough to connect them, not every pair of a large group of copies. So candidates come
in rounds: first each group with one pivot, of those of its shingles the one that shares the most of its
prefix, which costs one pair a group; then, for shingles whose groups still lie in different components, all
pairs of groups across those components that length and position allow: as a similar pair shares several
shingles of its prefixes, its first common one has several others behind it in both, so only the beginnings
of prefixes are paired. Pairs inside one component can add nothing. No candidate is dropped, so no link between components is
missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, bit_filter, components, copied_texts, distinct_texts, in_batches, maybe_among, rolling, scratch, settle, text_key, word_hashes
from .meet import shared_units

#: Buckets that shared shingles are counted in for their order: 1 MiB goes to every task.
BUCKETS = 1 << 20
#: Rounds of one pivot a group, before all pairs across components.
ROUNDS = 1


def _runs(text: bytes | None, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, A-Z in lower case; of all words if there are fewer."""
    words = (text or b"").lower().split()
    return rolling(word_hashes(words), min(k, len(words))) if words else np.empty(0, np.uint64)


def shingles(text: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``k`` words."""
    return np.unique(_runs(text, k))


def signature(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _sized(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with n and sig, the size and the 128-bit key of each set, instead of text."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, k) for t in as_bytes(batch["text"])]
            arrays = (pa.array([len(s) for s in own], pa.int32()), pa.array([signature(s) if len(s) else None for s in own], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *arrays], [*names, "n", "sig"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return in_batches(docs, run, f"{kinds}, n int, sig binary")


def _sets(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(sig, n, own, units) of the sets of which at least the threshold's share of shingles is in other texts too.

    ``own`` is the sorted set, ``units`` the places of its shared shingles, 32 bits each.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def entries(text: bytes | None):
        own = shingles(text, k)
        return (own, np.arange(len(own), dtype=np.uint32), None, len(own)) if len(own) else None

    shared = settle(shared_units(texts, entries, total // 6, least=(num, den)))
    bits = texts.sparkSession.sparkContext.broadcast(bit_filter(shared, F.col("h1")))
    near = maybe_among(texts, bits).join(shared, ["h1", "h2"]).select("text", "units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, k) for t in as_bytes(batch["text"])]
            arrays = (
                pa.array([signature(s) for s in own], pa.binary()),
                pa.array([len(s) for s in own], pa.int32()),
                pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64())),
            )
            yield pa.RecordBatch.from_arrays([*arrays, batch["units"]], ["sig", "n", "own", "units"])

    return settle(in_batches(near, run, "sig binary, n int, own array<bigint>, units binary").dropDuplicates(["sig"]))


def _flat(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy()
    return np.split(flat, (ends[1:-1] - ends[0]))


def _ranks(sets: DataFrame) -> np.ndarray:
    """Logarithm of how often each bucket of shared shingles occurs in ``sets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            if batch.num_rows:
                shared = [own[np.frombuffer(u, np.uint32)] for own, u in zip(_flat(batch["own"]), batch["units"].to_pylist(), strict=True)]
                counts += np.bincount((np.concatenate(shared) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["b", "n"])

    rows = in_batches(sets.select("own", "units"), run, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.uint8)
    out[rows["b"].to_numpy()] = np.log2(np.maximum(rows["n"].to_numpy(), 1)).astype(np.uint8).clip(max=31)
    return out


def _heads(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, n, grp, sel, skipped, prefix): a set's group, the group's place among pivots, and its prefix.

    ``prefix`` holds only shared shingles, after ``skipped`` ones that no other text has.
    """
    ranks = sets.sparkSession.sparkContext.broadcast(_ranks(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for own, units in zip(_flat(batch["own"]), batch["units"].to_pylist(), strict=True):
                at, n = np.frombuffer(units, np.uint32), len(own)
                shared, alone = own[at], np.delete(own, at)
                ranked = ranks.value[(shared % np.uint64(BUCKETS)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | shared >> np.uint64(6)
                prefix = np.sort(ranked)[: n - -(-n * num // den) + 1 - len(alone)]
                group = xxhash.xxh3_64_intdigest(alone.tobytes() + prefix.tobytes(), n)
                values = (group - (1 << 63), 127 * len(alone) // n << 56 | group >> 8, len(alone), prefix.astype(np.int64))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["sig"], batch["n"], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["sig", "n", "grp", "sel", "skipped", "prefix"])

    return settle(in_batches(sets.select("sig", "n", "own", "units"), run, "sig binary, n int, grp bigint, sel bigint, skipped int, prefix array<bigint>"))


def _verified(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (sig_a, sig_b) whose sets are similar enough, as (a, b)."""
    pairs = pairs.where("sig_a <> sig_b").select(F.least("sig_a", "sig_b").alias("a"), F.greatest("sig_a", "sig_b").alias("b")).distinct()
    whole = pairs.join(sets.select(F.col("sig").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("own").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return settle(whole.where(den * common >= num * (F.size("x") + F.size("y") - common)).select("a", "b"))


def _links(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b) of sets, by their keys: links that connect whatever all links connect."""
    sets = _sets(texts, k, num, den)
    heads = _heads(sets, num, den)
    groups = heads.dropDuplicates(["grp"])
    postings = groups.select("grp", "sel", "n", F.posexplode("prefix").alias("at", "token"), "skipped").withColumn("pos", F.col("skipped") + F.col("at")).drop("at", "skipped")
    several = postings.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("token")
    postings = settle(postings.join(several, "token"))
    members = heads.select("grp", F.col("sig").alias("sig_a"))
    firsts = heads.groupBy("grp").agg(F.min("sig").alias("sig_b"))
    close = den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")

    links = None
    candidates = members.join(firsts, "grp").select("sig_a", "sig_b")
    left = postings.withColumn("comp", F.col("grp"))
    for r in range(ROUNDS + 1):
        if r == ROUNDS:
            candidates = _across(left, groups, members, num, den)
        else:
            order = F.col("sel") if r == 0 else F.xxhash64(F.lit(r), F.col("grp"))
            pivots = left.groupBy("token").agg(F.min(F.struct(order.alias("o"), F.col("grp").alias("grp"), F.col("n").alias("n"), F.col("comp").alias("comp"))).alias("p"))
            star = left.select("token", F.col("grp").alias("grp_a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a")).join(
                pivots.select("token", F.col("p.grp").alias("grp_b"), F.col("p.n").alias("n_b"), F.col("p.comp").alias("comp_b")), "token"
            )
            star = star.where((F.col("comp_a") != F.col("comp_b")) & close).groupBy("grp_a", "grp_b").agg(F.count("*").alias("c"))
            star = star.groupBy("grp_a").agg(F.max(F.struct("c", "grp_b")).alias("best")).select("grp_a", F.col("best.grp_b").alias("grp_b"))
            star = star.join(members.withColumnRenamed("grp", "grp_a"), "grp_a").join(firsts.withColumnRenamed("grp", "grp_b"), "grp_b").select("sig_a", "sig_b")
            candidates = candidates.union(star) if r == 0 else star
        found = _verified(sets, candidates, num, den)
        links = found if links is None else links.union(found)
        if r == ROUNDS:
            return links
        roots = components(links)
        placed = settle(heads.select("sig", "grp").join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "grp", F.coalesce("root", "sig").alias("root")))
        where = placed.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        if r == 0:  # members of a group that its first one did not connect: the pairs of those
            split = placed.join(where.where("lo <> hi").select("grp"), "grp")
            inside = split.select("grp", F.col("sig").alias("sig_a"), F.col("root").alias("root_a")).join(split.select("grp", F.col("sig").alias("sig_b"), F.col("root").alias("root_b")), "grp")
            links = links.union(_verified(sets, inside.where("root_a < root_b").select("sig_a", "sig_b"), num, den))
        where = where.select("grp", F.when(F.col("lo") == F.col("hi"), F.xxhash64("lo")).otherwise(F.col("grp")).alias("comp"))
        located = postings.join(where, "grp")
        apart = located.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        left = settle(located.join(apart, "token"))
        if left.isEmpty():
            return links


def _across(left: DataFrame, groups: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """(sig_a, sig_b): all pairs across components that the bounds allow, of ``left`` (token, grp, n, pos, comp)."""
    # how many of its group's shared shingles stand from here on: if a pair's first common one is here, it has no more
    left = left.withColumn("rest", F.count("*").over(Window.partitionBy("grp").orderBy(F.desc("token"))))
    # shingles that the same groups hold (those of one passage) are one, which stands where its first one does
    same = F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("grp")), F.bit_xor(F.xxhash64(F.lit(1), "grp")))
    kinds = left.groupBy("token").agg(same.alias("cls"))
    rows = left.join(kinds, "token").groupBy("cls", "grp", "n", "comp").agg(F.max("rest").alias("rest"))
    tail = lambda n: F.ceil(F.col(n) * num / den) - 1
    reaches = lambda shared, behind, n, m: (num + den) * (shared + behind) >= num * (F.col(n) + F.col(m))
    # a row that falls short with the smallest and with the largest partner that its class has for it does so with all
    sizes = rows.groupBy("cls").agg(F.min("n").alias("least"), F.max("n").alias("largest"))
    rows = rows.join(sizes, "cls").withColumn("few", F.greatest("least", F.ceil(F.col("n") * num / den))).withColumn("many", F.least("largest", F.floor(F.col("n") * den / num)))
    rows = rows.where(F.greatest(*(((num + den) * (F.col("rest") + F.greatest(tail("n"), tail(m))) >= num * (F.col("n") + F.col(m))).cast("int") for m in ("few", "many"))) == 1)
    rows = settle(rows.join(groups.select("grp", F.element_at("prefix", -1).alias("end")), "grp").select("cls", "grp", "n", "comp", "rest", "end"))
    side = lambda s: rows.select("cls", *(F.col(c).alias(f"{c}_{s}") for c in ("grp", "n", "comp", "rest", "end")))
    close = den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")
    # what both prefixes share, with all that lies behind the prefix that ends first, bounds the overlap
    behind = F.when(F.col("end_a") < F.col("end_b"), tail("n_a")).when(F.col("end_a") > F.col("end_b"), tail("n_b")).otherwise(F.greatest(tail("n_a"), tail("n_b")))
    pairs = side("a").join(side("b"), "cls").where((F.col("comp_a") < F.col("comp_b")) & close & reaches(F.least("rest_a", "rest_b"), behind, "n_a", "n_b"))
    pairs = settle(pairs.select("grp_a", "grp_b", "n_a", "n_b", behind.alias("behind")).distinct())
    x, y = groups.select(F.col("grp").alias("grp_a"), F.col("prefix").alias("x")), groups.select(F.col("grp").alias("grp_b"), F.col("prefix").alias("y"))
    pairs = pairs.join(x, "grp_a").join(y, "grp_b").where(reaches(F.size(F.array_intersect("x", "y")), F.col("behind"), "n_a", "n_b")).select("grp_a", "grp_b")
    return pairs.join(members.toDF("grp_a", "sig_a"), "grp_a").join(members.toDF("grp_b", "sig_b"), "grp_b").select("sig_a", "sig_b")


def ngram_jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document; ``threshold`` is a fraction (numerator, denominator).

    ``n_shingles`` is the size of the document's set, ``component_id`` the least doc_id that links lead to,
    its own included. Documents without words (null texts too) are linked with nothing. Equal sets are
    linked. Repeated rows are documents with equal sets. A null doc_id is not a component's id while the
    component has another. An empty table stays empty; further columns are ignored.
    """
    with scratch(docs.sparkSession):
        own, named = _joined(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), k, *threshold)
        rows = own.select("doc_id", "n", "sig").join(named.select("sig", "component_id"), "sig", "left")
        return settle(rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), outlast=True)


def near_copies(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """(doc_id, h1, h2, first) for every document, a row told by its doc_id and its text's 128-bit key.

    ``first`` marks the row that stands for its component: the one with the least doc_id (null last), and
    of its texts the one with the least key. Repeats of that row are marked too; documents without words
    stand for themselves.
    """
    with scratch(docs.sparkSession):
        own, named = _joined(docs.select("doc_id", *text_key(F.col("text")), "text"), k, *threshold)
        own = own.select("sig", "doc_id", "h1", "h2").withColumn("key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2"))
        known = named.select("sig", "root")
        least = own.where("sig IS NOT NULL").groupBy("sig").agg(F.min("key").alias("least")).join(known, "sig").groupBy("root").agg(F.min("least").alias("least"))
        rows = own.join(known.join(least, "root").select("sig", "least"), "sig", "left")
        return settle(rows.select("doc_id", "h1", "h2", (F.col("least").isNull() | F.col("key").eqNullSafe(F.col("least"))).alias("first")), outlast=True)


def _joined(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The rows of _sized(), and (sig, root, component_id) of each distinct set."""
    own = settle(_sized(docs, k))
    with scratch(docs.sparkSession):
        roots = settle(components(_links(distinct_texts(docs, copied_texts(docs)), k, num, den)), outlast=True)
    classes = own.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    named = classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "rep", F.coalesce("root", "sig").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return own, named.join(least, "root").select("sig", "root", "component_id")
