"""Exact cosine similarity of many queries and many rows, in cells of bounded size.

A cell holds a part of the queries and a part of the rows of one user and model. Products of unit vectors in
single precision tell which pairs can be among a query's best; their error is bounded, and what lies within
the bound is scored anew in doubles, summed from left to right as ``functions.vectors.cosine`` does. Copies
of a vector are scored once; of those only the first ``limit`` in the order of ties can be among the best.
Vectors whose length a double can't hold are scored with everything.

Where only the number of rows is asked that are similar enough, products beyond the bound count as they are, no
pair is kept, and a query with ``limit`` of them is looked at no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and distinct rows that are multiplied at once, and components of pairs that are scored anew at once.
QUERIES, ROWS, AGAIN = 1024, 2048, 1 << 21
#: The same where they are only counted: products that the processor's cache can hold.
COUNTED = 1024, 256
#: Multipliers of the hash that tells copies; equal hashes are compared.
_ODD = np.uint64(0x9E3779B97F4A7C15)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` as Spark rounds it: half up, in decimals as they are printed; for |x| up to a few."""
    scaled = x * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out + 0.0


def by_dimensions(column: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, places, matrix) of the vectors; those that are null, empty or hold a null are left out."""
    lists = pa.concat_arrays(column.chunks)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, flat = np.cumsum(sizes), lists.flatten()
    good = sizes > 0
    if flat.null_count:
        good[np.searchsorted(ends, np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)), side="right")] = False
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    for d in np.unique(sizes[good]):
        at = np.flatnonzero(good & (sizes == d))
        whole = len(at) * d == len(values)
        yield int(d), at, values.reshape(-1, d) if whole else values[(ends[at] - d)[:, None] + np.arange(d)]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, each summed from left to right."""
    out, step = np.empty(len(a)), max(1, AGAIN // a.shape[1])
    for i in range(0, len(a), step):
        out[i : i + step] = np.cumsum(a[i : i + step] * b[i : i + step], axis=1)[:, -1]
    return out


def _margin(dimensions: int, digits: int) -> float:
    """How far a product of unit vectors can be from the rounded score."""
    return (dimensions + 16) * 1.2e-7 + 10.0**-digits


def _units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, single-precision unit vectors, and which of them are of use."""
    squares = _dots(m, m)
    fine = np.isfinite(squares) & (squares > 1e-200)
    units = np.zeros(m.shape, np.float32)
    units[fine] = m[fine] / np.sqrt(squares[fine])[:, None]
    return np.sqrt(squares), units, fine


def _copies(m: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, start, count): vector g stands at places[start[g]], and at ``count[g]`` places, ``limit`` at most."""
    bits = np.ascontiguousarray(m).view(np.uint64)
    hashes = np.zeros(len(m), np.uint64)
    for j in range(bits.shape[1]):
        hashes = (hashes ^ bits[:, j]) * _ODD
        hashes ^= hashes >> np.uint64(29)
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(m), bool)
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]]) + 1
    new[same] = (bits[order[same]] != bits[order[same - 1]]).any(1)
    start = np.flatnonzero(new)
    return order, start, np.minimum(np.diff(np.append(start, len(m))), limit)


def _places(flags: np.ndarray) -> np.ndarray:
    """Where ``flags``, of which few are set, are set: looked for eight at a time."""
    whole = len(flags) // 8 * 8
    eights = np.flatnonzero(flags[:whole].view(np.uint64) != 0)
    some = flags[:whole].reshape(-1, 8)[eights]
    i, j = np.nonzero(some)
    return np.concatenate([eights[i] * 8 + j, whole + np.flatnonzero(flags[whole:])])


def _cut(i: np.ndarray, r: np.ndarray, about: np.ndarray, floor: np.ndarray, count: np.ndarray, limit: int, margin: float) -> tuple[np.ndarray, ...]:
    """The pairs that can still be among the best ``limit``, by query; raises ``floor`` to what that many rows reach."""
    order = np.lexsort((-about, i))
    i, r, about = i[order], r[order], about[order].astype(np.float64)
    upto = np.cumsum(count[r])
    before = upto - count[r]
    start = before[np.searchsorted(i, i)]  # copies stand in ``count`` rows
    last = (upto - start >= limit) & (before - start < limit)
    floor[i[last]] = np.maximum(floor[i[last]], about[last] - margin)
    left = about >= floor[i] - margin
    return i[left], r[left], about[left].astype(np.float32)


def _best(q: np.ndarray, least: np.ndarray, rows: np.ndarray, limit: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) of each query's best rows, by places; ``rows`` stand in the order of ties."""
    places, start, count = _copies(rows, limit)
    rows = rows[places[start]]
    length, units, fine = _units(rows)
    q_length, q_units, q_fine = _units(q)
    margin = _margin(q.shape[1], digits)
    # written again by every block: new pages cost more than the products
    products, flags = np.empty(QUERIES * ROWS, np.float32), np.empty(QUERIES * ROWS, bool)

    def scored(held: tuple, a: int, i: np.ndarray, r: np.ndarray) -> tuple:
        """``held`` and the pairs, scored in doubles; the best of each query."""
        kept, step = [], max(1, AGAIN // q.shape[1])
        for c in range(0, len(i), step):
            x, y = i[c : c + step], r[c : c + step]
            size = q_length[a + x] * length[y]
            score = rounded(_dots(q[a + x], rows[y]) / size, digits)
            wanted = ~(size <= 0) & ((score >= least[a + x]) | np.isnan(score))
            kept.append((x[wanted], y[wanted], score[wanted]))
        if not any(len(x) for x, _, _ in kept):
            return held
        x, y, score = (np.concatenate(c) for c in zip(*kept, strict=True))
        each = count[y]
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        found = (np.repeat(x, each), places[np.repeat(start[y], each) + nth], np.repeat(score, each))
        held = tuple(np.concatenate(c) for c in zip(held, found, strict=True))
        key = np.where(np.isnan(held[2]), np.inf, held[2])  # Spark's order: NaN is the largest
        order = np.lexsort((held[1], -key, held[0]))
        asks = held[0][order]
        rank = np.arange(len(asks)) - np.searchsorted(asks, asks)
        return tuple(c[order[rank < limit]] for c in held)

    for a in range(0, len(q), QUERIES):
        mine = slice(a, min(a + QUERIES, len(q)))
        n = mine.stop - a
        floor = np.where(q_fine[mine], least[mine], np.inf)
        pairs, waiting = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))], 0
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for b in range(0, len(rows), ROWS):
            part = slice(b, min(b + ROWS, len(rows)))
            width = part.stop - b
            about, near = products[: n * width].reshape(n, width), flags[: n * width]
            np.matmul(q_units[mine], units[part].T, out=about)
            if odd := not fine[part].all():
                about[:, ~fine[part]] = -np.inf
            bar = lambda: np.nextafter((floor - margin).astype(np.float32), np.float32(-np.inf))[:, None]  # noqa: E731, B023
            np.greater_equal(about, bar(), out=near.reshape(n, width))
            if width > limit and np.count_nonzero(near) > 4 * limit * n:  # as many are at least that similar
                floor = np.maximum(floor, np.partition(about, -limit, axis=1)[:, -limit] - margin)
                np.greater_equal(about, bar(), out=near.reshape(n, width))
            at = _places(near)
            if len(at):
                pairs.append((at // width, at % width + b, about.ravel()[at]))
                if odd:
                    pairs[-1] = tuple(c[fine[pairs[-1][1]]] for c in pairs[-1])
                waiting += len(at)
            if waiting > 4 * limit * n:
                pairs = [_cut(*(np.concatenate(c) for c in zip(*pairs, strict=True)), floor, count, limit, margin)]
                waiting = len(pairs[0][0])
            if odd or not q_fine[mine].all():
                i, r = np.nonzero(~(q_fine[mine][:, None] & fine[part]))
                held = scored(held, a, i, r + b)
        i, r, _ = _cut(*(np.concatenate(c) for c in zip(*pairs, strict=True)), floor, count, limit, margin)
        held = scored(held, a, i, r)
        yield held[0] + a, held[1], held[2]


def _hits(q: np.ndarray, least: np.ndarray, rows: np.ndarray, limit: int, digits: int) -> np.ndarray:
    """How many rows are similar enough to each query, counted up to ``limit``."""
    places, start, count = _copies(rows, limit)
    order = np.argsort(-count, kind="stable")  # queries near to many copies are done soon
    rows, count = rows[places[start[order]]], count[order]
    asking, first, same = _copies(np.column_stack([q, least]), len(q))
    order = np.argsort(least[asking[first]], kind="stable")  # a block's bars are about the same
    asks = asking[first[order]]
    q, least = q[asks], least[asks]
    length, units, fine = _units(rows)
    q_length, q_units, q_fine = _units(q)
    margin = _margin(q.shape[1], digits)
    low = np.nextafter((least - margin).astype(np.float32), np.float32(-np.inf))
    high = np.nextafter((least + margin).astype(np.float32), np.float32(np.inf))
    hits, step = np.zeros(len(q), np.int64), max(1, AGAIN // q.shape[1])

    def score(i: np.ndarray, r: np.ndarray) -> None:
        """Counts the pairs that are similar enough in doubles."""
        for c in range(0, len(i), step):
            x, y = i[c : c + step], r[c : c + step]
            size = q_length[x] * length[y]
            found = rounded(_dots(q[x], rows[y]) / size, digits)
            wanted = ~(size <= 0) & ((found >= least[x]) | np.isnan(found))
            np.add.at(hits, x[wanted], count[y[wanted]])

    there, usable = np.flatnonzero(fine), np.flatnonzero(q_fine)
    units, each = units[there], count[there]
    height, width = COUNTED
    products, flags = np.empty(height * width, np.float32), np.empty(height * width, bool)
    for a in range(0, len(usable), height):
        mine = usable[a : a + height]
        block, bar, sure, few = q_units[mine], low[mine], high[mine], False
        for b in range(0, len(there), width):
            part = units[b : b + width]
            n, w = len(mine), len(part)
            about, near = products[: n * w].reshape(n, w), flags[: n * w]
            np.matmul(block, part.T, out=about)
            if few and about.max() < bar[0]:
                continue
            np.greater_equal(about, bar[:, None], out=near.reshape(n, w))
            at = _places(near)
            few = not len(at)
            if few:
                continue
            i, r = at // w, at % w + b
            clear = about.ravel()[at] > sure[i]
            hits[mine] += np.bincount(i[clear], each[r[clear]], n).astype(np.int64)
            if not clear.all():
                score(mine[i[~clear]], there[r[~clear]])
            open_ = hits[mine] < limit
            if np.count_nonzero(open_) < 0.9 * n:
                mine, block, bar, sure = mine[open_], block[open_], bar[open_], sure[open_]
                if not len(mine):
                    break
    odd = np.flatnonzero(~fine)
    for x in range(len(q)) if len(odd) else np.flatnonzero(~q_fine):
        others = odd if q_fine[x] else np.arange(len(rows))
        for c in range(0, len(others), step):
            if hits[x] < limit:
                some = others[c : c + step]
                score(np.full(len(some), x), some)
    out = np.empty(len(asking), np.int64)
    out[asking] = np.repeat(np.minimum(hits, limit)[np.argsort(order)], same)
    return out


def counted(limit: int, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a cell's queries and rows, as for ``cell`` but without ids and times of rows: (query_id, hits)."""

    def met(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], queries["query_id"].type), pa.array([], pa.int64())], ["query_id", "hits"])]
        if queries.num_rows and rows.num_rows:
            least = queries["min_similarity"].to_numpy()
            asked = {d: (at, q) for d, at, q in by_dimensions(queries["vector"])}
            with np.errstate(all="ignore"):
                for d, _, m in by_dimensions(rows["vector"]):
                    if d in asked:
                        at, q = asked[d]
                        hits = _hits(q, least[at], m, limit, digits)
                        some = np.flatnonzero(hits)
                        out.append(pa.table([queries["query_id"].take(pa.array(at[some])), pa.array(hits[some])], ["query_id", "hits"]))
        return pa.concat_tables(out)

    return met


def cell(limit: int, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a cell's queries and rows: (query_id, memory_id, score, time) of each query's best ``limit``.

    Queries have query_id, vector and min_similarity, rows memory_id, time and vector. Of equal scores the
    later row is better, then the smaller memory_id.
    """

    def met(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids, names = queries["query_id"].type, rows["memory_id"].type
        out = [pa.table([pa.array([], ids), pa.array([], names), pa.array([], pa.float64()), pa.array([], pa.int64())], ["query_id", "memory_id", "score", "time"])]
        if queries.num_rows and rows.num_rows:
            rows = rows.take(pc.sort_indices(rows, [("time", "descending"), ("memory_id", "ascending")]))
            least = queries["min_similarity"].to_numpy()
            asked = {d: (at, q) for d, at, q in by_dimensions(queries["vector"])}
            with np.errstate(all="ignore"):
                for d, there, m in by_dimensions(rows["vector"]):
                    if d in asked:
                        at, q = asked[d]
                        for i, r, score in _best(q, least[at], m, limit, digits):
                            best = rows.select(["memory_id", "time"]).take(pa.array(there[r]))
                            out.append(pa.table([queries["query_id"].take(pa.array(at[i])), best["memory_id"], pa.array(score), best["time"]], out[0].column_names))
        return pa.concat_tables(out)

    return met
