"""Queries over all rows, against brute force on the same tables."""

import functools
import math
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner import catalog
from gleaner.catalog.data import memories
from gleaner.operators import nearest, retrieve

SF = "/root/testdata/sf0.001"
RUN = catalog.queries()


def norm(t):
    return (t or "").lower().replace("ß", "ss").strip()


def test_phrase_bonus_meets_every_document(spark, tmp_path):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(9001, docs[5]), (9002, docs[6][3:40]), (9003, docs[7].split()[0]), (9004, "abc"), (9005, "no such words anywhere at all")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate([*docs, None, docs[5]])], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = [norm(t) for t in [*docs, None, docs[5]]]
    want = {i: float(sum(len(norm(t)) >= 4 and norm(t) in d for d in held)) for i, t in items}
    assert want[9001] >= 2 and want[9005] == 0
    assert {r.query_id: r.bonus for r in RUN["phrase_bonus_all"](spark, str(tmp_path)).collect()} == want


def test_vector_queries_meet_every_vector(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    found, counts = defaultdict(dict), {r.query_id: r.hits for r in RUN["vector_threshold_all"](spark, SF).collect()}
    for r in RUN["vector_search_all"](spark, SF).collect():
        found[r.query_id][r["rank"]] = (int(r.memory_id[1:]), r.score)
    queries = [i for i in rows if i % 100 == 0]
    assert set(found) == set(queries)
    for q in queries:
        cosine = {i: round(float(v @ rows[q] / np.sqrt((v @ v) * (rows[q] @ rows[q]))), 9) for i, v in rows.items()}
        best = sorted(cosine, key=lambda i: (-cosine[i], -i))[:10]
        assert [found[q][k][0] for k in range(1, 11)] == best
        assert np.allclose([found[q][k][1] for k in range(1, 11)], [cosine[i] for i in best], atol=2e-6)
        least = 0.35 if q % 200 == 0 else 0.65
        assert counts.get(q, 0) == min(300, sum(c >= least for c in cosine.values()))
    assert any(i % 2 for q in queries for i, _ in found[q].values())


def test_every_turn_has_its_neighbours(spark):
    sessions = defaultdict(list)
    for r in memories(spark, SF).select("user_id", "session_id", "row_id", "memory_id").collect():
        sessions[r.user_id, r.session_id].append((r.row_id, r.memory_id))
    want = Counter()
    for own in map(sorted, sessions.values()):
        for i, (row, _) in enumerate(own):
            want.update((row, own[j][1], abs(i - j), 0) for j in range(max(0, i - 1), min(len(own), i + 2)))
    assert Counter(map(tuple, RUN["neighbors_all"](spark, SF).collect())) == want


def test_long_questions_put_their_end_first(spark):
    """A question of more than 160 terms: the terms of its last 512 characters, then the others, longest first, those with digits last."""
    letters = "abcdefghijklmnopqrtuvwxyz"
    words = [f"w{a}{b}k" for a in letters[:12] for b in letters] + ["n1234567k", "longestwordk"]
    query = " ".join(words[::-1])
    tail = [t for t in query[-512:].split() if len(t) > 1][:80]
    rest = [w for w in query.split() if w not in tail]
    rest.sort(key=lambda w: (any(c.isdigit() for c in w), -len(w)))
    frame = spark.createDataFrame([(query,)], "q string")
    assert frame.select(text.query_terms(F.col("q")).alias("t")).first().t == (tail + rest)[:160]


def brute(queries, rows, limit):
    """Best rows by a loop over pairs: cosine summed from left to right, half up to nine digits, NaN first, then later, then smaller ids."""
    found = []
    for qid, user, q, least in queries:
        scored = []
        for name, owner, v, t in rows:
            if owner == user and v is not None and len(v) == len(q) and None not in v:
                dot = lambda a, b: functools.reduce(lambda s, x: s + x[0] * x[1], zip(a, b, strict=True), 0.0)
                size = math.sqrt(dot(q, q)) * math.sqrt(dot(v, v))
                s = dot(q, v) / size if size else None
                s = s if s is None or math.isnan(s) else float(Decimal(repr(s)).quantize(Decimal("1e-9"), ROUND_HALF_UP))
                if s is not None and (math.isnan(s) or s >= least):
                    scored.append((-math.inf if math.isnan(s) else -s, -(t or 0), name, s))
        found += [(qid, name, "nan" if math.isnan(s) else s, k + 1) for k, (_, _, name, s) in enumerate(sorted(scored, key=lambda x: x[:3])[:limit])]
    return sorted(found, key=repr)


@pytest.mark.parametrize("limit", [3, 40])
def test_vector_search_in_cells_is_the_loop_over_pairs(spark, monkeypatch, limit):
    """Copies, nearly equal vectors, unequal dimensions, nulls, NaN, lengths beyond a double; many small cells and blocks."""
    for name, value in (("CELL", 1 << 9), ("CELL_LEAST", 1 << 7), ("ASKING", 1 << 6)):
        monkeypatch.setattr(retrieve, name, value)
    for name, value in (("ROWS", 16), ("QUERIES", 4), ("AGAIN", 256)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.normal(size=8)] for _ in range(150)]
    vectors += [vectors[0]] * 50 + [[x + 1e-8 * float(rng.normal()) for x in vectors[1]] for _ in range(50)] + [[2 * x for x in vectors[0]]] * 5
    vectors += [None, [], [1.0], [0.0] * 8, [1.0, None, *[0.0] * 6], [float("nan")] * 8, [1e200] * 8, [1e-170] * 8, [-1e-220] * 8, [1.0] + [0.0] * 7, [2.0, 1.0]]
    rows = [(f"m{i:03}", "uw"[i % 7 == 0], v, None if i % 5 == 0 else i // 4) for i, v in enumerate(vectors)]
    queries = [(i, "u", v, least) for i, (v, least) in enumerate([(v, lo) for v in (*vectors[:12], vectors[205], *vectors[-8:]) for lo in (-1.0, 0.35)]) if v is not None and None not in v]
    queries += [(900, "w", vectors[0], 0.65), (901, "nobody", vectors[0], -1.0), (902, "w", vectors[7], -1.0)]
    asked = spark.createDataFrame([(i, u, "m", v, lo) for i, u, v, lo in [*queries, (903, None, vectors[0], -1.0), (904, "u", vectors[0], None)]], "query_id bigint, user_id string, model string, vector array<double>, min_similarity double")
    held = spark.createDataFrame([(n, u, "m", v) for n, u, v, _ in rows] + [("other", "u", "else", vectors[0])], "memory_id string, user_id string, model string, vector array<double>")
    times = spark.createDataFrame([(n, t) for n, _, _, t in rows] + [("other", 1)], "memory_id string, occurred_at bigint")
    got = [(r.query_id, r.memory_id, "nan" if math.isnan(r.score) else r.score, r["rank"]) for r in retrieve.vector_search(asked, held, times, limit).collect()]
    want = brute(queries, rows, limit)
    assert sorted(got, key=repr) == want
    own = [x for x in queries if x[1] == "u"]
    asks = pa.table({"query_id": [x[0] for x in own], "vector": pa.array([x[2] for x in own], pa.list_(pa.float64())), "min_similarity": [x[3] for x in own]})
    there = [(n, t or 0, v) for n, u, v, t in rows if u == "u"]
    met = nearest.cell(limit, 9)(asks, pa.table({"memory_id": [n for n, _, _ in there], "time": [t for _, t, _ in there], "vector": pa.array([v for *_, v in there], pa.list_(pa.float64()))}))
    pairs = [(r["query_id"], r["memory_id"], "nan" if math.isnan(r["score"]) else r["score"]) for r in met.to_pylist()]
    assert sorted(pairs, key=repr) == sorted((x[:3] for x in want if x[0] < 900), key=repr)
    assert retrieve.vector_search(asked.limit(0), held, times, limit).count() == retrieve.vector_search(asked, held.limit(0), times, limit).count() == 0


def test_vector_search_makes_no_row_a_pair(spark):
    """20,000 vectors of one user, 2,000 queries: 40 million pairs, of which only the best may become rows."""
    one = spark.range(20000).select(F.format_string("m%05d", "id").alias("memory_id"), F.lit("u").alias("user_id"), F.lit("m").alias("model"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.hash("id", i).cast("double")).alias("vector"))
    times, asked = one.select("memory_id", F.lit(0).cast("long").alias("occurred_at")), one.where("memory_id < 'm02000'").select(F.col("memory_id").alias("query_id"), "user_id", "model", "vector", F.lit(-1.0).alias("min_similarity"))
    found = retrieve.vector_search(asked, one, times, 2)
    assert "CoGroup" in found._jdf.queryExecution().toString()
    assert found.where("rank = 1 AND query_id = memory_id").count() == 2000


def test_few_pairs_of_a_cell_are_scored_in_doubles(monkeypatch):
    """Products of all blocks are looked through before pairs are scored: hardly more pairs than results."""
    rng, scored = np.random.default_rng(5), []
    rows, q, dots = rng.normal(size=(20000, 16)), rng.normal(size=(300, 16)), nearest._dots
    monkeypatch.setattr(nearest, "_dots", lambda a, b: scored.append(0 if a is b else len(a)) or dots(a, b))
    monkeypatch.setattr(nearest, "ROWS", 1024)
    found = sum(len(i) for i, _, _ in nearest._best(q, np.full(300, -1.0), rows, 10, 9))
    assert found == 3000 and sum(scored) <= 1.2 * found


def test_copies_of_the_best_vectors_are_not_all_expanded(monkeypatch):
    """300 copies of each vector fill a query's results alone: no other vector is scored in doubles."""
    rng, scored = np.random.default_rng(6), []
    rows, dots = np.repeat(rng.normal(size=(100, 16)), 300, axis=0), nearest._dots
    monkeypatch.setattr(nearest, "_dots", lambda a, b: scored.append(0 if a is b else len(a)) or dots(a, b))
    assert sum(len(i) for i, _, _ in nearest._best(rows[::3000], np.full(10, -1.0), rows, 300, 9)) == 3000
    assert sum(scored) <= 20


@pytest.mark.parametrize("limit", [3, 60])
def test_vector_hits_are_counted_as_the_loop_over_pairs(spark, monkeypatch, limit):
    """Copies, scores at the bar, unequal dimensions, nulls, NaN, lengths beyond a double, a query twice; many small cells and blocks."""
    for name, value in (("CELL", 1 << 9), ("CELL_LEAST", 1 << 7), ("COUNTING", 1 << 6)):
        monkeypatch.setattr(retrieve, name, value)
    for name, value in (("COUNTED", (4, 16)), ("AGAIN", 256)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in rng.normal(size=8)] for _ in range(120)] + [[1.0] + [0.0] * 7, [0.35, math.sqrt(1 - 0.35**2)] + [0.0] * 6, [0.35 - 2e-9, 1.0] + [0.0] * 6]
    vectors += [vectors[0]] * 50 + [[x + 1e-8 * float(rng.normal()) for x in vectors[121]] for _ in range(50)] + [[2 * x for x in vectors[0]]] * 5
    vectors += [None, [], [1.0], [0.0] * 8, [1.0, None, *[0.0] * 6], [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1e200] * 8, [1e-170] * 8, [-1e-220] * 8, [2.0, 1.0]]
    rows = [(f"m{i:03}", "uw"[i % 7 == 0], v, 0) for i, v in enumerate(vectors)]
    whole = [v for v in (*vectors[:10], vectors[120], *vectors[-10:]) if v is not None and None not in v]
    queries = [(i, "u", v, least) for i, (v, least) in enumerate([(v, lo) for v in whole for lo in (-1.0, 0.35, 0.65)])] + [(900, "w", vectors[0], 0.65), (901, "nobody", vectors[0], -1.0), (1, "u", vectors[0], 0.35)]
    kinds = "query_id bigint, user_id string, model string, vector array<double>, min_similarity double"
    asked = spark.createDataFrame([(i, u, "m", v, lo) for i, u, v, lo in [*queries, (902, None, vectors[0], -1.0), (903, "u", vectors[0], None)]], kinds)
    held = spark.createDataFrame([(n, u, "m", v) for n, u, v, _ in rows] + [("other", "u", "else", vectors[0])], "memory_id string, user_id string, model string, vector array<double>")
    want = {i: min(limit, n) for i, n in Counter(x[0] for x in brute(queries, rows, len(rows))).items()}
    assert {r.query_id: r.hits for r in retrieve.vector_hits(asked, held, limit).collect()} == want
    own = [x for x in queries if x[1] == "u" and x[0] != 1]
    asks = pa.table({"query_id": [x[0] for x in own], "vector": pa.array([x[2] for x in own], pa.list_(pa.float64())), "min_similarity": [x[3] for x in own]})
    met = nearest.counted(limit, 9)(asks, pa.table({"vector": pa.array([v for _, u, v, _ in rows if u == "u"], pa.list_(pa.float64()))}))
    assert dict(zip(met["query_id"].to_pylist(), met["hits"].to_pylist(), strict=True)) == {x[0]: want[x[0]] for x in own if x[0] in want}
    assert retrieve.vector_hits(asked.limit(0), held, limit).count() == retrieve.vector_hits(asked, held.limit(0), limit).count() == 0


def test_vector_threshold_makes_no_row_a_hit(spark, tmp_path):
    """Copies of few vectors: every query has its fill of hits in every cell, which are only counted, neither ranked nor joined."""
    rng = np.random.default_rng(7)
    kinds = [[float(x) for x in rng.normal(size=16)] for _ in range(10)]
    spark.createDataFrame([(i, kinds[i % 10]) for i in range(8000)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = RUN["vector_threshold"](spark, str(tmp_path))
    assert "Window" not in (plan := found._jdf.queryExecution().toString()) and "memory_id" not in plan.split("CoGroup")[0]
    assert {(r.query_id, r.hits) for r in found.collect()} == {(i, 300) for i in range(0, 8000, 50)}


def test_counted_pairs_are_hardly_ever_scored_in_doubles(monkeypatch):
    """A product beyond the bound counts as it is, and a query that has its fill is left out of what follows."""
    rng, scored, met = np.random.default_rng(8), [], []
    rows, q, dots, product = rng.normal(size=(20000, 16)), rng.normal(size=(300, 16)), nearest._dots, np.matmul
    monkeypatch.setattr(nearest, "_dots", lambda a, b: scored.append(0 if a is b else len(a)) or dots(a, b))
    monkeypatch.setattr(nearest.np, "matmul", lambda a, b, out: met.append(out.size) or product(a, b, out=out))
    unit = lambda m: m / np.sqrt((m * m).sum(1))[:, None]
    least = np.where(np.arange(300) % 2, 0.35, 0.8)
    want = (unit(q) @ unit(rows).T >= least[:, None]).sum(1)
    assert (nearest._hits(q, least, rows, 300, 9) == np.minimum(want, 300)).all()
    assert want.sum() > 200000 and sum(scored) < 1000 and sum(met) < 0.75 * rows.shape[0] * len(q)
