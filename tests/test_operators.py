import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.operators import analysis, chat, fold, store
from lexquarry.operators import grounding as G
from lexquarry.operators import retrieval as R
from lexquarry.operators.machines import BargeIn, EventParser, RateLimit, Sentences, SessionTouch, VoiceActivity, configured

CLAUSE = "The tenant shall pay a refundable security deposit of Rs. 50,000 before moving in. Either party may terminate with 30 days written notice."


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([(1, CLAUSE), (2, "The landlord may enter with one day of notice.")], "source_id long, text string")


@pytest.mark.parametrize(
    "quote,status,coverage,source",
    [
        ("refundable security deposit", "verified", 1.0, 1),
        ("tenant shall keep three cats and a dog", "unverified", None, None),
        ("THE TENANT SHALL PAY, a refundable security deposit of Rs 50,000 before moving OUT", "verified", None, 1),
        ("tenant shall pay a refundable cash deposit of Rs. 50,000 before moving in. Either party may", "partial", None, 1),
        ("Either party may terminate with 60 days written notice", "unverified", None, None),
        ("", "none", 0.0, None),
    ],
)
def test_quotes(spark, sources, quote, status, coverage, source):
    got = G.check(spark.createDataFrame([(7, quote)], "quote_id long, quote string"), sources).first()
    assert (got.status, got.source_id) == (status, source)
    assert coverage is None or got.coverage == coverage


def test_elided_quote(spark, sources):
    quotes = spark.createDataFrame([(1, "tenant shall pay ... 30 days written notice"), (2, "tenant shall pay ... all the cats and dogs")], "quote_id long, quote string")
    got = {r.quote_id: r.status for r in G.check_elided(quotes, sources).collect()}
    assert got == {1: "verified", 2: "unverified"}


def test_verdicts(spark):
    rows = [([], [], []), (["S1"], [], ["verified"]), (["S9"], ["S9"], []), (["S1"], [], ["partial", "verified"]), (["S1"], [], ["unverified"])]
    df = spark.createDataFrame(rows, "cited array<string>, invalid array<string>, statuses array<string>")
    assert [r[0] for r in df.select(G.verdict(F.col("cited"), F.col("invalid"), F.col("statuses"))).collect()] == ["general_knowledge", "grounded", "unverified", "partially_grounded", "unverified"]


def test_fusion_and_diversification(spark):
    a = spark.createDataFrame([(0, "x", 0), (0, "y", 1), (0, "z", 2)], "query_id int, item string, rank int")
    b = spark.createDataFrame([(0, "z", 0), (0, "w", 1)], "query_id int, item string, rank int")
    got = {r["item"]: r.score for r in R.fuse([a, b]).collect()}
    assert got["x"] == pytest.approx(1 / 61) and got["z"] == pytest.approx(1 / 63 + 1 / 61)
    docs = spark.createDataFrame([("x", "A"), ("y", "A"), ("z", "A"), ("w", "B")], "item string, document string")
    kept = {r["item"] for r in R.select(R.fuse([a, b]).join(docs, "item"), 2, "document").collect()}
    assert "w" in kept and len(kept) == 3


def test_messages(spark):
    turns = [("assistant", "hi"), ("user", "a"), ("user", "b"), ("assistant", "c"), ("user", "d"), ("assistant", " "), ("user", "e")]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv int, turn int, role string, text string")
    got = [(r.role, r.text) for r in chat.normalise(df, "conv", "turn", "role", "text").orderBy("n").collect()]
    assert got == [("user", "a\n\nb"), ("model", "c")]


def test_limiter_and_sessions():
    limit = configured(RateLimit, limit=2, window=10.0)()
    assert [limit.take({"at": t})[0] for t in (0.0, 0.0, 0.0)] == [(True, None), (True, None), (False, 10)]
    assert limit.take({"at": 10.5})[0] == (True, None)
    touch = configured(SessionTouch, ttl=3600.0)()
    assert [touch.take({"at": t})[0][0] for t in (1000.0, 1001.0, 1400.0, 5001.0)] == ["missing", "fresh", "refreshed", "missing"]


def test_voice_activity():
    machine, out = VoiceActivity(), []
    for t in range(0, 2500, 50):
        out += [(t, s) for (s,) in machine.take({"ms": t, "level": 0.2 if 500 <= t < 1500 else 0.004})]
    assert [s for _, s in out] == ["start", "end"] and out[0][0] == 700


def test_barge_in():
    """Levels up to the echo's do not count; one clearly above it for long enough does."""
    machine, out = BargeIn(), []
    for t in range(0, 3000, 50):
        level = 0.05 if t < 700 else 0.12 if t < 1500 else 0.4
        out += [(t, s) for (s,) in machine.take({"ms": t, "level": level})]
    assert out == [(1850, "start")]


def test_replies(spark):
    from lexquarry.operators import replies

    def chunk(parts, queries=None, web=None):
        meta = {"web_search_queries": queries, "grounding_chunks": [{"web": w} for w in web] if web is not None else None} if queries or web else None
        return json.dumps({"candidates": [{"content": {"parts": parts}, "grounding_metadata": meta}]})

    u = lambda uri, title=None, domain=None: {"uri": uri, "title": title, "domain": domain}
    rows = [
        (1, 2, chunk([{"text": " world"}], ["b", "a"], [u("x", "later"), u("y", None, "y.org"), u("", "none"), None])), (1, 1, chunk([{"text": "thinking", "thought": True}, {"text": "Hello", "thought": False}, {}], ["a"], [u("x", "X")])),
        (1, 3, "no json"), (1, 4, None), (1, 5, '{"candidates": null}'), (1, 6, '{"candidates": [{"content": null}]}'), (2, 1, chunk([], [f"q{i % 8}" for i in range(20)], [u(f"u{i}") for i in range(20)])),
    ]
    got = {r.answer_id: r for r in replies.answers(spark.createDataFrame(rows, "answer_id int, seq int, chunk string")).collect()}
    assert got[1].answer == "Hello world" and got[1].search_queries == ["a", "b"] and [tuple(s) for s in got[1].web_sources] == [("X", "x"), ("y.org", "y")]
    assert got[2].answer == "" and got[2].search_queries == [f"q{i}" for i in range(5)] and [tuple(s) for s in got[2].web_sources] == [("Source", f"u{i}") for i in range(8)]


def test_stream_parsers():
    parser = EventParser()
    assert parser.take({"piece": "event: delta\r\ndata: {\"a\""}) == []
    assert parser.take({"piece": ":1}\r\n\r\n: comment\n\ndata: x\ndata: y\n\nda"}) == [("delta", '{"a":1}'), ("message", "x\ny")]
    cutter = Sentences()
    got = [s for p in ("This is the first full sen", "tence here [S1]. Ok. And the next one is", " also long enough!\n") for (s,) in cutter.take({"piece": p})]
    assert got == ["This is the first full sentence here [S1].", "Ok. And the next one is also long enough!"]


def test_admission_is_a_fold(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([60, 50, 40, 1])], "session string, id int, chars int")
    added = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("reason", T.StringType())])
    got = [(r.ok, r.reason) for r in fold.ordered_fold(df, "session", ["id"], added, fold.admission(3, 100, "chars")).orderBy("id").collect()]
    assert got == [(True, None), (False, "library_full"), (True, None), (False, "library_full")]


def test_analysis(spark, sources):
    report = '{"overall_risk":"high","risk_score":80,"verdict":"v","clauses":[{"title":"t","risk":"low","quote":"refundable security deposit"},{"title":"u","risk":"high","quote":"no such words at all here"}],"red_flags":[{"issue":"i","quote":""}]}'
    df = analysis.parsed(spark.createDataFrame([(1, report), (2, "no json")], "id int, report string"))
    assert [r.valid for r in df.orderBy("id").collect()] == [True, False]
    held = sources.crossJoin(df.select("id"))
    got = {r.id: r for r in analysis.annotated(df, held, "id", "report").collect()}
    assert (got[1].verified, got[1].partial, got[1].unverified) == (1, 0, 1) and got[2].result is None
    assert df.where("valid").select(analysis.score_fits(F.col("parsed.risk_score"), F.col("parsed.overall_risk"))).first()[0]
    cache = spark.createDataFrame([("k", 1, "old")], "cache_key string, at int, payload string")
    new = spark.createDataFrame([("k", 2, "new"), ("l", 2, "x")], "cache_key string, at int, payload string")
    assert {(r.cache_key, r.payload) for r in analysis.upsert(cache, new, "cache_key", "at").collect()} == {("k", "new"), ("l", "x")}
    assert [r.cache_key for r in analysis.misses(new, cache).collect()] == ["l"]


def test_store(spark):
    conv = spark.createDataFrame([("a", 1), ("b", 2)], "id string, updated_at int")
    said = spark.createDataFrame([("a", i, f"m{i}") for i in range(6)], "conversation_id string, n int, content string")
    assert [(r.id, r.n_messages) for r in store.summaries(conv, said).collect()] == [("b", 0), ("a", 6)]
    assert sorted(r.content for r in store.recent(said, "conversation_id", "n", 4).collect()) == ["m2", "m3", "m4", "m5"]
    left, children = store.deleted(conv, said, spark.createDataFrame([("a",)], "id string"), "id", "conversation_id")
    assert left.count() == 1 and children.count() == 0
    assert store.expired(spark.createDataFrame([("a", 1000.0), ("b", 4000.0)], "id string, last_seen double"), 4601.0, 3600.0).count() == 1
