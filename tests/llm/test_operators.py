"""The training-data operators against brute force, round trips and held-out accuracy, on small tables with odd rows."""

import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import chat, decontaminate, extract, filters, jaccard, meet, packing, quality, sharding, substring, topk, toxicity
from gleaner.llm import queries as Q
from gleaner.llm.common import bit_filter, components, in_filter

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, near copies, shared passages, self-repeats."""
    base, passage = words("w", 120), words("p", 60)
    rows = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:60] + ["x"] + base[61:])), (4, None), (5, ""), (6, "  \n\t "), (7, "One two"), (8, "one TWO"),
        (9, " ".join(words("a", 50) + passage)), (10, " ".join(passage + words("b", 70))), (11, " ".join(words("c", 20) * 4)), (12, "é ü   nbsp"),
        (13, " ".join(words("long", 9000))), (14, " ".join(words("d", 34))), (15, " ".join(words("d", 34))), (16, " ".join(base)), (16, " ".join(base)), (None, "lonely null id"),
        (17, " ".join(base[:40])), (18, " ".join(words("a", 50) + words("e", 30))),
    ]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.createDataFrame(odd, DOC).repartition(3)


def shingle_set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_components(rows):
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    least = {g: min((rows[i][0] for i in own if rows[i][0] is not None), default=None) for g, own in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[top(i)]) for i in range(len(rows)))


def test_jaccard_against_brute_force(spark, docs, odd):
    clash = docs.withColumn("n", F.lit("clash")).withColumn("sig", F.lit("clash")).withColumn("component_id", F.lit("clash"))
    got = Counter(tuple(r) for r in jaccard.ngram_jaccard_join(clash).collect())
    assert got == brute_components([r[:2] for r in odd])


@pytest.mark.parametrize("rounds", [1, 2])
def test_jaccard_many_edits(spark, monkeypatch, rounds):
    """A large group of copies with random edits, and a passage that many short texts share."""
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(meet, "KEYS_A_PART", 50)
    monkeypatch.setattr(meet, "CHUNK_KEYS", 1000)
    monkeypatch.setattr(meet, "KEYS_A_ROW", 1)
    rng = np.random.default_rng(3)
    base, line = words("b", 90), words("line", 9)
    rows = []
    for i in range(220):
        own = list(base)
        for at in rng.choice(90, rng.integers(0, 7), replace=False):
            own[at] = f"edit{rng.integers(1 << 30)}"
        rows.append((i, " ".join(own)))
    for i in range(220, 420):
        rows.append((i, " ".join(line + [f"u{rng.integers(200)}" for _ in range(rng.integers(0, 14))])))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = Counter(tuple(r) for r in jaccard.ngram_jaccard_join(frame).collect())
    assert got == brute_components(rows)


def brute_repeats(rows, size=35):
    starts = Counter()
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in split:
        starts.update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = Counter()
    for i, w in split:
        gone = {p for k in range(len(w) - size + 1) if starts[tuple(w[k : k + size])] > 1 for p in range(k, k + size)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out[(i, len(w), len(gone), kept.decode())] += 1
    return out


def test_substring_against_brute_force(docs, odd):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs.withColumn("n_words", F.lit("clash"))).collect())
    assert got == brute_repeats([r[:2] for r in odd])


def test_substring_on_driver_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(d).collect())
    assert got == brute_repeats([(r.doc_id, r.text) for r in d.collect()])


def test_decontamination_against_brute_force(spark, docs, odd):
    items = [(1, " ".join(words("p", 60)[5:30])), (2, "TWO"), (3, None), (4, ""), (5, " ".join(words("w", 120)[:9])), (5, "one two"), (None, "lonely null"), (6, "absent words")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    own = lambda t: decontaminate.words_of((t or "").encode())
    windows = defaultdict(set)
    for i, t in items:
        w = own(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[a : a + k])].add("" if i is None else str(i))
    want = Counter()
    for i, t, *_ in odd:
        w, hit, found = own(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if names := windows.get(tuple(w[a : a + size])):
                    hit.update(range(a, a + size))
                    found |= names
        want[(i, len(w), len(hit), tuple(sorted(found)), bool(hit))] += 1
    for block in (decontaminate.BLOCK_WINDOWS, 7):  # one pass, several passes
        before, decontaminate.BLOCK_WINDOWS = decontaminate.BLOCK_WINDOWS, block
        try:
            rows = decontaminate.contamination(docs, bench).collect()
        finally:
            decontaminate.BLOCK_WINDOWS = before
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in rows) == want
    clash = docs.withColumn("n_hit", F.lit("clash")).withColumn("items", F.lit("clash")).withColumn("h1", F.lit("clash"))
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.contamination(clash, bench).collect()) == want
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    clean = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert not any(r.contaminated for r in clean) and len(clean) == len(odd)


def check_packed(rows, texts):
    encoder = packing.Encoder()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for i, t in texts:
        ids = np.array([*encoder.slow.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert pieces == want
    total = sum(r.length for r in rows)
    return len(by), -(-total // 1024)


def test_packing(spark, docs, odd):
    clash = docs.withColumn("piece", F.lit("clash")).withColumn("length", F.lit("clash")).withColumn("sequence_id", F.lit("clash"))
    check_packed(packing.pack(clash).collect(), [r[:2] for r in odd])
    special = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, None)], "doc_id bigint, text string")
    check_packed(packing.pack(special).collect(), [(1, "a<|endoftext|>b"), (2, None)])
    d = spark.read.parquet(f"{SF}/documents.parquet")
    used, least = check_packed(packing.pack(d).collect(), [(r.doc_id, r.text) for r in d.collect()])
    assert used <= least * 1.02 + 2


def test_packing_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_TASK", 40)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    used, least = check_packed(packing.pack(d).collect(), [(r.doc_id, r.text) for r in d.collect()])
    assert used <= least * 1.05 + 4


def test_packer_closes_the_fullest():
    packer = packing.Packer(10, 2)
    assert [*packer.put("a", 6), *packer.put("b", 7)] == []
    assert list(packer.put("c", 8)) == [(["b"], 7)]
    assert sorted(packer.rest()) == [(["a"], 6), (["c"], 8)]


def test_chat_round_trip(spark):
    nasty = ["", "plain", "### User: hi", "\\### Assistant: </turn> ok", "</turn>", "a\\", "\\\\</turn>\n", "#### User: x", "### Other(00): ", "\n</turn>\n### System: no", "é</turn> "]
    rows = [(1, i, ("user", "assistant", "system", "tool", None)[i % 5], t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", None), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (None, None, "assistant", "x"), (3, 0, "we:ird\n### User: ", "t")]
    found = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert [(t.role, t.text) for t in found[1].turns] == [(r, t) for _, _, r, t in rows[: len(nasty)]]
    assert [t.text for t in found[2].turns] == ["", "tie", "tie"] and set(found) == {1, 2, 3, None}
    for conv in found.values():
        spans = [conv.formatted[m.start : m.start + m.length] for m in conv["mask"]]
        assert spans == [t.raw for t in conv.turns if t.role == "assistant"]


def test_chat_plan_has_no_python(spark):
    plan = Q.op4_chat_formatting(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_sharding(spark, docs, odd):
    rows = sharding.shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in odd)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    keys = np.arange(200_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)
    assert set(b[a != b]) == {40} and abs((a != b).mean() - 1 / 41) < 0.002
    assert np.bincount(a).max() < 1.05 * len(keys) / 40
    assert sharding.jump_hash(np.array([1], np.uint64), 1).tolist() == [0]


def test_chat_long_and_empty(spark):
    long = ["\\" * 1_000_000, "\\" * 100_000 + "</turn>", "### Other(" + "0" * 300_000, "### User: " * 50_000]
    rows = [(i, 0, "assistant", t) for i, t in enumerate(long)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash")).withColumn("mask", F.lit("clash"))
    started = time.monotonic()
    found = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    assert time.monotonic() - started < 30
    assert [found[i].turns[0].text for i in range(len(long))] == long
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_jump_hash_against_its_definition(spark):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b

    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("clash").alias("shard"), F.lit("clash").alias("slot"))
    keys = {r.doc_id: r.h % 2**64 for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for r in sharding.shard_documents(docs).collect():
        assert (r.shard, r.grown_shard) == (jump(keys[r.doc_id], 40), jump(keys[r.doc_id], 41))


def test_top_k_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 6))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(300, [float(x) for x in base[300]])] * 2
    rows += [(500, None), (600, [1.0, None]), (700, [float("nan")] * 6), (800, [float("inf")] * 6), (900, []), (None, [0.5] * 6), (1000, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = Counter(tuple(r) for r in topk.exact_top_k(frame, F.col("vec_id") % 100 == 0).collect())
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for at, (q, v) in enumerate(good):
        if q is None or q % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), float("inf") if i is None else i, i) for k, (i, w) in enumerate(good) if k != at]
        for place, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:10], 1):
            want[(q, place, i, -s)] += 1
    assert got == want
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)  # several query blocks
    monkeypatch.setattr(topk, "ANNULUS", 7)
    clash = frame.withColumn("rank", F.lit("clash")).withColumn("id", F.lit("clash")).withColumn("v", F.lit("clash"))
    assert Counter(tuple(r) for r in topk.exact_top_k(clash, F.col("vec_id") % 100 == 0).collect()) == want
    assert topk.exact_top_k(frame.limit(0), F.lit(True)).count() == 0


PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li><a>%s</a></li><li>x</li></ul></nav>"
    "<div class='ad'>Buy %s</div><article><h1>Title %s</h1><p>One &amp; <b>two</b>\n  three<br>four<p>Five &lt;6&gt;<form>mail</form><div class='comments'><p>rude</p></div></article>"
    "<aside>side</aside><footer>&copy; %s</footer>"
)


def test_extraction(spark):
    pages = [(i, f"http://h{i % 2}.example.org/{i}", PAGE % ((i,) * 4)) for i in range(8)]
    pages += [(20, None, None), (21, "bad url", ""), (22, "http://alone.example.org/", "<p>Only <i>this</i></p><footer>no</footer>"), (23, "http://h0.example.org/9", "<article><p>cut off &nbsp; he")]
    rows = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    for i in range(8):
        assert rows[i] == f"Title {i}\nOne & two three four\nFive <6>"
    assert (rows[20], rows[21], rows[22], rows[23]) == ("", "", "Only this", "cut off he")


def test_marks_stay_with_their_own_elements(spark):
    """One marked or hidden block must not take unmarked ones of its class with it, on its page or its host's others."""
    plain = "<article><div class='block'>Story %s</div><p>More %s</p></article>"
    marked = "<article><div class='block'>Story %s</div><div class='block ad'>Buy</div><p>More %s</p><p hidden>Unseen</p></article>"
    pages = [(i, f"http://m.example.org/{i}", (marked if i == 3 else plain) % (i, i)) for i in range(6)]
    rows = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert rows == {i: f"Story {i}\nMore {i}" for i in range(6)}


def test_constants_of_a_host_are_not_main_text(spark):
    """Texts that all pages of a host share go, without any mark, outside an article and inside; slots stay."""
    menu = "<div class='x'><ul><li>Home</li><li>About us</li></ul></div>"
    open_ = menu + "<div class='y'>We value your privacy</div><div class='z'><p>Story %s</p><p>More %s</p></div>"
    framed = "<article><div>Read our magazine</div><h1>Title %s</h1><p>Body %s</p></article>"
    pages = [(i, f"http://open.example.org/{i}", open_ % (i, i)) for i in range(9)]
    pages += [(20 + i, f"http://framed.example.org/{i}", framed % (i, i)) for i in range(9)]
    pages += [(40 + i, f"http://copies.example.org/{i}", open_ % (1, 1)) for i in range(9)]  # nothing tells what varies
    pages += [(60 + i, f"http://two.example.org/{i}", open_ % (i, i)) for i in range(2)]
    # the eighth page alone differs: a constant of some pages is a slot of all
    pages += [(80 + i, f"http://late.example.org/{i}", f"<div class='y'>{'Other' if i == 7 else 'Usual'} news</div><p>Story {i}</p>") for i in range(9)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(4)
    rows = {r.page_id: r.text for r in extract.extract(frame).collect()}
    whole = "Home\nAbout us\nWe value your privacy\nStory {0}\nMore {0}"
    for i in range(9):
        assert rows[i] == f"Story {i}\nMore {i}"
        assert rows[20 + i] == f"Title {i}\nBody {i}"
        assert rows[40 + i] == whole.format(1)
        assert rows[80 + i] == f"{'Other' if i == 7 else 'Usual'} news\nStory {i}"
    assert [rows[60], rows[61]] == [whole.format(0), whole.format(1)]


def test_wrapper_expression(spark):
    pages = [(f"http://w.example.org/{i}", f"bare<ul><li>a{i}</li><li>b</li></ul>" + "<p>x</p>" * (i % 2)) for i in range(6)]
    wrapper = extract.wrappers(spark.createDataFrame(pages, "url string, html string").repartition(3))
    assert extract.expressions(wrapper).first().expression == "(<ul>(<li>#</li>)+</ul>)(<p>=</p>)?"  # text outside elements is not shown


def brute_constants(pages):
    """Paths by tag names of simple pages whose text is the same wherever it stands, on three different pages or more."""
    held, of = defaultdict(set), defaultdict(set)
    for page in pages:
        for path, told in page:
            held[path].add(told)
            of[path].add(page)
    return {p for p in held if len(held[p]) == 1 and len(of[p]) >= 3}


def test_wrappers_against_brute_force(spark, monkeypatch):
    """Random pages of unmarked blocks; verdicts by broadcast, and by join where they are many."""
    rng = np.random.default_rng(11)
    hosts = {f"h{h}.example.org": [tuple((f"c{chr(97 + k)}", f"text {rng.integers(1, 1 + rng.integers(1, 4))} of {k}") for k in range(5) if rng.random() < 0.8) for _ in range(rng.integers(1, 12))] for h in range(12)}
    rows, want = [], {}
    for host, pages in hosts.items():
        gone = brute_constants(pages)
        gone = gone if any(p not in gone for page in pages for p, _ in page) else set()
        for page in pages:
            want[len(rows)] = "\n".join(t for p, t in page if p not in gone)
            rows.append((len(rows), f"https://{host}/x?y", "".join(f"<div class={p}>{t}</div>" for p, t in page)))
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).repartition(5)
    for most in (extract.WRAPPER_BYTES, 0):
        monkeypatch.setattr(extract, "WRAPPER_BYTES", most)
        assert {r.page_id: r.text for r in extract.extract(frame).collect()} == want
    assert extract.extract(frame.limit(0)).count() == 0
    twice = extract.extract(frame.union(frame)).groupBy("page_id").count().collect()
    assert {r["count"] for r in twice} == {2}


def test_vague_names(spark):
    """A name that may mean anything rules text out only where the wrapper cannot tell; lists of links go."""
    page = "<article><h1 class='alert'>Title {0}</h1><div class='share-price'>Shares rose {0}</div><div class='related'>Found {0}</div><div class='related-links'><a>More {0}</a></div><p class='alert'>Take {0}</p></article>"
    pages = [(i, f"http://many.example.org/{i}", page.format(i)) for i in range(5)] + [(9, "http://one.example.org/", page.format(9))]
    rows = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert rows[9] == "Title 9\nShares rose 9\nTake 9"
    assert all(rows[i] == f"Title {i}\nShares rose {i}\nFound {i}\nTake {i}" for i in range(5))


@pytest.mark.parametrize(
    "page,told",
    [
        ("<article><p>a</p><svg/><p>b</p></article>", "a\nb"), ("<p>a<iframe/></p><p>b</p>", "a\nb"), ("<article><p>a</p><object><p>b</p></article>", "a\nb"), ("<p title='it's'>hello</p>", "hello"),
        ("<svg><svg><text>x</text></svg><text>leak</text></svg><p>ok</p>", "ok"), ("<form><article>in</article></form>", "in"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"), ("<p>x < y &amp;&lt;</p>", "x < y &<"),
        ("<article>" + "<div>" * 10_000 + "x" + "</div>" * 10_000, "x"), ("<article>" + "<b>" * 10_000 + "x", "x"), ("<b><div></i></div>" * 10_000 + "x", "x"), ("<script>" * 10_000 + "x", "x"), ("<p a" + " " * 200_000 + ">x", "x"),
        ("<p " + "a= " * 100_000 + ">x", "x"), ("<" * 100_000, "<" * 100_000), ("".join(f"<p>{i}" for i in range(30_000)), "\n".join(map(str, range(30_000)))), ("<ul>" * 5_000 + "<li>" * 10_000 + "x", "x"),
    ],
)
def test_hostile_pages(page, told):
    started = time.monotonic()
    assert extract.main_text(page) == told
    assert time.monotonic() - started < 10


def auc(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.85), ("op10_quality", "quality", 0.95)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = Q.queries()[name](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    both = got[got.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert auc(both.score.to_numpy(), both[label].to_numpy()) >= least
    assert ((both.predicted == 1) & (both[label] == 0)).sum() <= 3


def weak_rows(rng, n=600):
    """Texts in which toxic ones hold lexicon words or words of a slang of their own, with true labels."""
    y = rng.random(n) < 0.2
    rows = []
    for toxic in y:
        own = [f"word{rng.integers(300)}" for _ in range(20)]
        if toxic:
            own += list(rng.choice(["idiot", "moron", "scum", "trash"] if rng.random() < 0.5 else [f"slang{k}" for k in range(6)], 3))
        rows.append(toxicity.features(" ".join(own).encode()))
    return rows, y.astype(int)


def test_labels_are_no_votes():
    rows, y = weak_rows(np.random.default_rng(1))
    shuffled = np.random.default_rng(2).permutation(y)
    one, two = (toxicity.fit(rows, labels, steps=5, mine=False)["label_model"]["posterior"] for labels in (y, shuffled))
    assert np.array_equal(one, two)
    x, hits = toxicity.Sparse(rows), toxicity._hits(rows)
    named = toxicity.named_by_others(x, hits, y)
    for i in np.flatnonzero(y)[:5]:  # a row's own label does not name what votes on it
        flipped = y.copy()
        flipped[i] = 0
        other = toxicity.named_by_others(x, hits, flipped)
        assert all(np.array_equal(a, b) for a, b in zip(named[i % toxicity.PARTS], other[i % toxicity.PARTS], strict=True))
    found = toxicity.fit(rows, y, steps=5)["label_model"]["posterior"] > 0.5
    assert (found == y).mean() > 0.95 and (one[y == 1] > 0.5).mean() < 0.7 < (found[y == 1]).mean()


def test_label_model_against_enumeration():
    """Independent voters with known rates: the rates come back, and the posterior is Bayes' rule over both classes."""
    rng = np.random.default_rng(4)
    toxic, clean = np.array([0.7, 0.6, 0.5, 0.5, 0.05]), np.array([0.02, 0.05, 0.02, 0.1, 0.8])
    y = rng.random(6000) < 0.25
    votes = (rng.random((6000, 5)) < np.where(y[:, None], toxic, clean)).astype(float)
    model = toxicity.label_model(votes, 0.25)
    assert np.abs(model["toxic"] - toxic).max() < 0.05 and np.abs(model["clean"] - clean).max() < 0.05
    assert abs(model["posterior"].mean() - 0.25) < 1e-3
    each = {tuple(row): p for row, p in zip(votes, model["posterior"], strict=True)}
    for row, got in each.items():  # every pattern of votes, both classes spelled out
        both = [p * np.prod([r if fires else 1 - r for r, fires in zip(rates, row, strict=True)]) for p, rates in ((0.25, toxic), (0.75, clean))]
        assert abs(both[0] / sum(both) - got) < 0.2
    assert ((model["posterior"] > 0.5) == y).mean() > 0.95


def test_packed_exchange_against_counting(spark, monkeypatch):
    """Hits by brute force, at part numbers beyond 16 bits and with single-entry rows."""
    monkeypatch.setattr(meet, "KEYS_A_PART", 1)
    monkeypatch.setattr(meet, "CHUNK_KEYS", 500)
    monkeypatch.setattr(meet, "MOST_KEYS", 500)
    rng = np.random.default_rng(9)
    rows = [(i, -i, " ".join(f"w{rng.zipf(1.3) % 400}" for _ in range(rng.integers(1, 60)))) for i in range(200)]

    def entries(text):
        w = text.split()
        h = np.array([zlib.crc32(x) << 32 | zlib.crc32(b"y" + x) for x in w], np.uint64)
        return h, np.arange(len(w), dtype=np.uint32) // 3, np.array([x.endswith((b"1", b"2")) for x in w]), -(-len(w) // 3)

    count, marked = Counter(w for *_, t in rows for w in t.split()), lambda w: w.endswith(("1", "2"))
    want = {}
    for h1, _, t in rows:
        if units := sorted({k // 3 for k, w in enumerate(t.split()) if count[w] > 1 and marked(w)}):
            want[h1] = units
    frame = spark.createDataFrame(rows, "h1 bigint, h2 bigint, text string").repartition(4)
    for exact in (True, False):
        got = meet.shared_units(frame, entries, 200_000, exact).collect()
        assert {r.h1: np.frombuffer(r.units, np.uint32).tolist() for r in got} == want


def test_classifiers_on_odd_rows(spark, docs, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for run in (quality.score_quality, toxicity.score_toxicity):
        for own in (labels, labels.limit(0)):
            rows = run(docs.withColumn("score", F.lit("clash")), own).collect()
            assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
        assert run(docs.limit(0), labels).count() == 0


def test_empty_tables(docs):
    none = docs.limit(0)
    assert jaccard.ngram_jaccard_join(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert packing.pack(none).count() == 0
    assert sharding.shard_documents(none).count() == 0


def test_filters(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (3, "d")], "doc_id bigint, text string")
    ids = spark.createDataFrame([(1,), (None,)], "doc_id bigint")
    assert sorted(r.doc_id for r in filters.without(docs, ids).collect()) == [2, 2, 3]
    linked = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (2, 1, 1), (None, 1, None), (3, 1, 3)], "doc_id bigint, n_shingles bigint, component_id bigint")
    assert sorted((r.doc_id or 0) for r in filters.one_of_each(docs, linked).collect()) == [0, 1, 3]


def test_components_and_filter(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (12, 12), (11, 10), (5, 4)], "a bigint, b bigint")
    assert {r.node: r.root for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10}
    keys = spark.range(-50, 50).withColumn("h", F.xxhash64("id"))
    bits = bit_filter(keys, F.col("h"))
    assert in_filter(bits, np.array([r.h for r in keys.collect()])).all()


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        before = kept
        kept = spark.createDataFrame(stage(spark, before, SF).toArrow())
        assert kept.columns == docs.columns, name
        rows, had = [(r.doc_id, r.text) for r in kept.collect()], [(r.doc_id, r.text) for r in before.collect()]
        if name == "ngram_jaccard_join":
            assert {i for i, _ in rows} == {c if n else i for (i, n, c), _ in brute_components(had).items()}
        elif name == "substring_dedup":
            want = {i: (k, n) for i, _, n, k in brute_repeats(had)}
            assert {i: t for i, t in rows} == {i: (want[i][0] if want[i][1] else t) for i, t in had}
        else:
            assert {i for i, _ in rows} <= {i for i, _ in had}
    check_packed(P.STAGES[-1][1](spark, kept, SF).collect(), [(r.doc_id, r.text) for r in kept.collect()])


def test_pipeline_judges_rows_not_ids(spark, tmp_path):
    """A verdict on one row of a null or repeated doc_id leaves its other rows alone."""
    import corpus_pipeline as P

    copy, leak = " ".join(words("w", 60)), " ".join(words("item", 20))
    clean = [" ".join(words(f"own{i}_", 40)) for i in range(4)]
    rows = [(1, copy), (None, copy), (None, clean[0]), (None, clean[1]), (2, copy + " end"), (2, clean[2]), (None, leak), (3, leak + " more"), (3, clean[3]), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC).repartition(3)
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    told = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    one = P.keep_one_of_near_copies(spark, docs, str(tmp_path))
    # two near copies and, of the leaks (16 of 17 shingles shared), the one without an id
    assert told(one) == Counter(r for r in rows if r not in [(None, copy), (2, copy + " end"), (None, leak)])
    assert told(P.drop_contaminated(spark, docs, str(tmp_path))) == Counter(r for r in rows if r not in [(None, leak), (3, leak + " more")])


def test_pipeline_run(spark, tmp_path):
    """run() itself on odd rows: nulls, repeats, near copies, items, further columns by clashing names; and on none."""
    import os

    import corpus_pipeline as P

    copy, leak, toxic = " ".join(words("w", 60)), " ".join(words("item", 20)), "you idiot scum moron trash " * 3
    rows = [(1, copy), (2, copy + " end"), (None, None), (None, None), (3, ""), (4, leak + " more"), (5, toxic), (6, "clean text of its own"), (6, "clean text of its own")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], DOC + ", h1 string, score int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(100 + i, 1, int(i % 3 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in got.collect()) - Counter({5: 1}) == Counter({None: 1, 1: 1, 3: 1, 6: 1})
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
    left = {x for x in os.listdir(got.settled_at.removeprefix("file:").rsplit("/", 1)[0])}
    assert os.path.basename(got.settled_at) in left


def test_passes_over_texts_share_a_worker(spark):
    """distinct_texts, a filter and a function after it: one MapInArrow, hence one Python worker a task; same rows."""
    import pyarrow as pa

    from gleaner.llm import common

    texts = ["a b", "c", "a b", None, "", "d e f", "c", "g"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    distinct = common.distinct_texts(docs, common.copied_texts(docs))
    assert sorted(r.text or "" for r in distinct.collect()) == ["", "a b", "c", "d e f", "g"]
    every = spark.sparkContext.broadcast(np.full(1 << 14, -1, np.int64))
    upper = common.in_batches(common.maybe_among(distinct, every), lambda batches: (pa.RecordBatch.from_arrays([pa.array([(t or "").upper() for t in b["text"].to_pylist()])], ["t"]) for b in batches), "t string")
    assert sorted(r.t for r in upper.collect()) == ["", "A B", "C", "D E F", "G"]
    assert upper._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_written_tables_get_small_batches(spark):
    """Python is given at most STEP rows at once by the JVM itself, and the session keeps its setting."""
    import pyarrow as pa

    from gleaner.llm import common

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    frame = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n bigint")
    assert sorted(r.n for r in common.settle(frame).collect()) == [common.STEP] * 5
    assert spark.conf.get(name) == before


def test_executors_hand_back_memory_once_an_operator_is_done(spark, monkeypatch):
    from gleaner.llm import common

    calls, hand_back = [], common.hand_back
    monkeypatch.setattr(common, "hand_back", lambda s: calls.append(1) or hand_back(s))
    with common.scratch(spark):
        with common.scratch(spark):
            pass
        assert not calls
    assert len(calls) == 1


def test_the_tokenizer_is_only_loaded_for_special_tokens():
    from gleaner.llm.packing import Encoder

    encoder = Encoder()
    encoder.ids("plain words")
    assert "slow" not in vars(encoder)
    assert set(encoder.special) == {t.content for t in encoder.slow.get_added_tokens_decoder().values()}
