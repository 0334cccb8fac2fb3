"""Scenarios of the whole engine, written as inputs and what must come back."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.plans.config import EngineConfig
from gleaner.plans.engine import ConflictError, Engine, plan_queries
from gleaner.sources import schemas

NEW_YEAR = 1704067200000
CONFIG = EngineConfig(candidate_limit=100, max_output_tokens=8000, max_output_items=24)


def request(request_id, user, session, *said):
    return {"request_id": request_id, "user_id": user, "session_id": session, "messages": [{"role": r, "content": c, "timestamp": t} for r, c, t in said]}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), CONFIG)
    rows = [
        request("req-user-a", "user-a", "session-1", ("user", "My favorite drink is jasmine tea.", NEW_YEAR), ("assistant", "I will remember that you prefer jasmine tea.", NEW_YEAR + 60000)),
        request("r1", "iso-a", "s", ("user", "Alice moved to Kyoto.", None)),
        request("r1", "iso-b", "s", ("user", "Alice moved to Osaka.", None)),
        request("r1", "latest", "s1", ("user", "My favorite drink is coffee.", NEW_YEAR)),
        request("r2", "latest", "s2", ("user", "Actually, I changed my favorite drink to jasmine tea.", 1735689600000)),
        request("r1", "zephyr", "s1", ("user", "The launch code for project zephyr is alpha.", NEW_YEAR)),
        request("r2", "zephyr", "s2", ("user", "Correction: the launch code for project zephyr is beta.", 1735689600000)),
        request("eval:sample:chunk-1", "chunks", "s", ("user", "The second chapter covers sailing boats.", None)),
        request("eval:sample:chunk-0", "chunks", "s", ("user", "The first chapter covers mountain trains.", None)),
        request("r1", "hop", "s1", ("user", "Alice's mentor is Bob.", None)),
        request("r2", "hop", "s2", ("user", "Bob lives in Kyoto.", None)),
        request("r3", "hop", "s3", ("user", "Alice likes jazz music.", None)),
        request("r1", "cat", "s1", ("user", "我养猫", None)),
        request("r1", "day", "s1", ("user", "Team visited the museum.", NEW_YEAR)),
        request("r2", "day", "s2", ("user", "Team visited the museum.", NEW_YEAR + 86400000)),
    ]
    told = e.add(spark.createDataFrame(rows, schemas.REQUEST), created_at="2026-01-01T00:00:00+00:00").collect()
    assert {r.status for r in told} == {"new"}
    return e


#: Questions of the scenarios: (user, question, options, top_k), answered as one batch.
ASKED = {
    "drink": ("user-a", "What drink do I prefer?", None, 10),
    "kyoto": ("iso-a", "Where did Alice move?", None, 10),
    "osaka": ("iso-b", "Where did Alice move?", None, 10),
    "nobody": ("nobody", "Where did Alice move?", None, 10),
    "latest": ("latest", "What is my latest favorite drink?", None, 10),
    "first code": ("zephyr", "What was the first launch code for project zephyr?", None, 10),
    "code": ("zephyr", "What is the launch code for project zephyr?", None, 10),
    "chunks": ("chunks", "Which chapter covers sailing boats and mountain trains?", None, 10),
    "hop": ("hop", "Where does Alice's mentor live?", None, 2),
    "no term": ("user-a", "What is the authorization passphrase?", None, 10),
    "options": ("iso-a", "Which token is it?", ["Kyoto"], 10),
    "cat": ("cat", "猫", None, 10),
    "day": ("day", "What did the team do on 2024-01-01?", None, 10),
}


@pytest.fixture(scope="module")
def answers(engine, spark):
    rows = engine.search_batch(spark.createDataFrame([(name, *q) for name, q in ASKED.items()], schemas.QUERY)).collect()
    return {name: [r.asDict() for r in sorted(rows, key=lambda r: r.place) if r.query_id == name] for name in ASKED}


def told(items):
    return " ".join(i["content"] for i in items)


def test_add_then_search(engine, answers):
    found = engine.search("What drink do I prefer?", "user-a", 10)
    assert "jasmine tea" in found[0]["content"]
    assert 0 <= found[0]["score"] <= 1
    assert found == engine.search("What drink do I prefer?", "user-a", 10)  # from the cache
    assert [i["content"] for i in found] == [i["content"] for i in answers["drink"]]  # alone as in a batch


def test_same_request_again_and_changed(engine):
    same = request("req-user-a", "user-a", "session-1", ("user", "My favorite drink is jasmine tea.", NEW_YEAR), ("assistant", "I will remember that you prefer jasmine tea.", NEW_YEAR + 60000))
    before = engine.health()["memories"]
    assert engine.add_one(same) == "existing"
    assert engine.health()["memories"] == before
    with pytest.raises(ConflictError):
        engine.add_one(request("req-user-a", "user-a", "session-1", ("user", "Something else.", NEW_YEAR)))


def test_broken_rules_are_named_without_values(engine, spark):
    bad = [request("", "u", "s", ("robot", "x", 1)), request("ok", "u", "s", ("user", "x", 253402300800000))]
    told = engine.add(spark.createDataFrame(bad, schemas.REQUEST)).collect()
    assert {r.status for r in told} == {"invalid"}
    assert sorted(e for r in told for e in r.errors) == ["messages.[0].role:value", "messages.[0].timestamp:range", "request_id:length"]


def test_users_see_their_own(answers):
    assert "Kyoto" in answers["kyoto"][0]["content"]
    assert "Osaka" in answers["osaka"][0]["content"] and "Kyoto" not in told(answers["osaka"])
    assert answers["nobody"] == []


def test_latest_and_earliest(answers):
    assert "jasmine" in answers["latest"][0]["content"]
    assert "alpha" in answers["first code"][0]["content"]
    assert "beta" in told(answers["code"]) and "alpha" not in told(answers["code"])


def test_chunks_are_put_in_order(answers):
    first = answers["chunks"][0]["content"]
    assert first.index("mountain trains") < first.index("sailing boats")


def test_both_ends_of_a_relation(answers):
    assert "Bob." in told(answers["hop"]) and "Kyoto" in told(answers["hop"])


def test_no_term_no_result(answers):
    assert answers["no term"] == [] and answers["options"] == []


def test_single_cjk_character(answers):
    assert "我养猫" in answers["cat"][0]["content"]


def test_day(answers):
    assert "2024-01-01" in answers["day"][0]["content"]


def test_new_engine_on_the_same_store(engine, spark):
    again = Engine(spark, engine.store.path, CONFIG)
    assert again.search("What drink do I prefer?", "user-a", 10) == engine.search("What drink do I prefer?", "user-a", 10)
    a = again.rebuild_index().postings.orderBy("memory_id", "term").collect()
    assert a == engine.store.read("postings").select("user_id", "memory_id", "term", "tf").orderBy("memory_id", "term").collect()


def test_failed_batch_stays_invisible(engine, spark):
    before = engine.health()
    broken = Engine(spark, engine.store.path, EngineConfig(embedder=lambda texts: [[float("nan")] for _ in texts]))
    with pytest.raises(Exception):
        broken.add_one(request("r9", "user-z", "s", ("user", "Lost words.", None)))
    assert engine.health() == before
    assert engine.search("Lost words", "user-z") == []


def test_models_plug_in(spark, tmp_path):
    config = EngineConfig(
        embedder=lambda texts: [[1.0, 0.0] if "red" in t else [0.5, 0.866] for t in texts],
        annotator=lambda texts: [["crimson"] for _ in texts],
        analyzer=lambda q, options: {"terms": ["crimson"], "facets": [], "intent": "none"},
        reranker=lambda q, texts: [float(len(t)) for t in texts],
    )
    e = Engine(spark, str(tmp_path / "s"), config)
    e.add_one(request("r", "u", "s1", ("user", "red", None)))
    e.add_one(request("r2", "u", "s2", ("user", "red and longer", None)))
    found = e.search("colour?", "u")
    assert [i["content"].split("] ")[1] for i in found] == ["red and longer", "red"]


def test_vector_only_threshold(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), EngineConfig(embedder=lambda texts: [[1.0, 0.0] if "query" in t else [0.5, 0.866] for t in texts]))
    e.add_one(request("r", "u", "s1", ("user", "unrelated", None)))
    assert e.search("query words", "u") == []  # 0.5 is below 0.65


def test_stream(spark, tmp_path):
    from gleaner.streaming import ingest as stream

    source, e = tmp_path / "in", Engine(spark, str(tmp_path / "s"), CONFIG)
    source.mkdir()
    row = request("r", "u", "s", ("user", "The launch code is alpha.", None))
    frame = spark.createDataFrame([row], schemas.REQUEST)
    frame.coalesce(1).write.mode("append").json(str(source))
    run = lambda: stream.write_stream(e, stream.read_stream(spark, str(source)), str(tmp_path / "c")).awaitTermination()
    run()
    assert "alpha" in e.search("launch code", "u")[0]["content"]
    frame.withColumn("request_id", F.lit("r2")).coalesce(1).write.mode("append").json(str(source))
    run()
    assert e.revision("u") == 2


def test_questions_up_to_16000_characters_are_read_whole(spark):
    query = "alpha " + "filler " * 900 + "middle " + "filler " * 900 + "omega"
    assert 8000 < len(query) <= 16_000
    frame = spark.createDataFrame([(1, "u", query, None, 5)], "query_id bigint, user_id string, query string, options array<string>, top_k int")
    row = plan_queries(frame, EngineConfig()).select("bounded", "terms").collect()[0]
    assert row.bounded == query
    assert row.terms[0] == "alpha" and "middle" in row.terms
    assert frame.select(text.query_terms(F.col("query")).alias("t")).collect()[0].t == row.terms


def test_failed_reranker_is_not_remembered(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def broken(q, texts):
        (calls / str(len(list(calls.iterdir())))).touch()
        return [float("nan")] * len(texts)

    e = Engine(spark, str(tmp_path / "s"), EngineConfig(reranker=broken))
    e.add_one(request("r", "u", "s", ("user", "Alice moved to Kyoto.", None)))
    first = e.search("Where did Alice move?", "u")
    assert "Kyoto" in first[0]["content"] and "unranked" not in first[0]
    once = len(list(calls.iterdir()))
    assert e.search("Where did Alice move?", "u") == first and len(list(calls.iterdir())) > once


def test_stems_match_and_count(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), EngineConfig(embeddings=False))
    e.add_one(request("r", "u", "s", ("user", "She was relating her happiness about sailing.", None)))
    assert e.search("relates happily sail", "u")


def test_compatibility_characters(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), EngineConfig(exact_unicode=True, embeddings=False))
    e.add_one(request("r", "u", "s", ("user", "Ｋｙｏｔｏ is lovely.", None)))
    assert "Ｋｙｏｔｏ" in e.search("Kyoto?", "u")[0]["content"]
    e.add_one(request("r2", "u", "s2", ("user", "The team met.", NEW_YEAR)))
    assert "The team met." in told(e.search("What happened on ２０２４-０１-０１?", "u"))
