from pyspark.sql import types as T

from lexquarry.operators import chat
from lexquarry.operators.machines import EventParser, RateLimit, Sentences, SessionTouch, Utterances, configured
from lexquarry.streaming import stateful


def run(spark, tmp_path, rows, schema, fields, kind, order, late=None):
    """One file a micro-batch; called again it goes on from the checkpoint."""
    have = len(list((tmp_path / "in").glob("*"))) if (tmp_path / "in").exists() else 0
    for i, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"{have + i:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in" / "*"))
    out = stateful.run_machine(stream, "key", order, fields, kind, late)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()


def test_rate_limit(spark, tmp_path):
    fields = T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("wait", T.LongType())])
    rows = [[("k", 0.0), ("k", 1.0), ("k", 2.0), ("l", 2.0)], [("k", 10.5)]]
    got = run(spark, tmp_path, rows, "key string, at double", fields, configured(RateLimit, limit=2, window=10.0), "at")
    assert sorted((r.key, r.at, r.allowed) for r in got) == [("k", 0.0, True), ("k", 1.0, True), ("k", 2.0, False), ("k", 10.5, True), ("l", 2.0, True)]


def test_events_over_batches(spark, tmp_path):
    fields = T.StructType([T.StructField("event", T.StringType()), T.StructField("data", T.StringType())])
    rows = [[("k", 0, "event: a\nda")], [("k", 1, "ta: 1\n\nda")], [("k", 2, "ta: 2\n\n")]]
    got = run(spark, tmp_path, rows, "key string, n int, piece string", fields, EventParser, "n")
    assert sorted((r.n, r.event, r.data) for r in got) == [(1, "a", "1"), (2, "message", "2")]


def test_sentences_over_batches(spark, tmp_path):
    fields = T.StructType([T.StructField("sentence", T.StringType())])
    rows = [[("k", 0, "A sentence that is split over ")], [("k", 1, "two batches. And a rest")]]
    got = run(spark, tmp_path, rows, "key string, n int, piece string", fields, Sentences, "n")
    assert [r.sentence for r in got] == ["A sentence that is split over two batches."]


def kept(spark, tmp_path):
    """The keys that have state."""
    return {r.key.key for r in spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "state").load().collect()}


def test_idle_state_goes(spark, tmp_path):
    """After its window a silent key has no state; a restart goes on with the state of the others."""
    fields = T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("wait", T.LongType())])
    limit = configured(RateLimit, limit=2, window=10.0)
    got = run(spark, tmp_path, [[("k", 1000.0), ("k", 1001.0), ("l", 1001.0)], [("m", 1005.0)]], "key string, at double", fields, limit, "at", "1 second")
    assert sorted((r.key, r.at, r.allowed) for r in got) == [("k", 1000.0, True), ("k", 1001.0, True), ("l", 1001.0, True), ("m", 1005.0, True)] and kept(spark, tmp_path) == {"k", "l", "m"}
    got = run(spark, tmp_path, [[("k", 1006.0)], [("m", 1013.0)], [("m", 1030.0)], [("m", 1031.0)]], "key string, at double", fields, limit, "at", "1 second")
    assert sorted((r.key, r.at, r.allowed, r.wait) for r in got if r.at > 1005) == [("k", 1006.0, False, 4), ("m", 1013.0, True, None), ("m", 1030.0, True, None), ("m", 1031.0, True, None)]
    assert kept(spark, tmp_path) == {"m"}


def test_sessions_expire(spark, tmp_path):
    fields = T.StructType([T.StructField("outcome", T.StringType())])
    touch = configured(SessionTouch, ttl=3600.0)
    got = run(spark, tmp_path, [[("a", 1000.0), ("a", 1100.0), ("b", 1000.0)], [("a", 1500.0)], [("b", 4600.0)], [("a", 9000.0)], [("c", 9001.0)]], "key string, at double", fields, touch, "at", "1 second")
    assert sorted((r.key, r.at, r.outcome) for r in got) == [("a", 1000.0, "missing"), ("a", 1100.0, "fresh"), ("a", 1500.0, "refreshed"), ("a", 9000.0, "missing"), ("b", 1000.0, "missing"), ("b", 4600.0, "refreshed"), ("c", 9001.0, "missing")]
    assert kept(spark, tmp_path) == {"a", "c"}


def test_utterances_batch_equals_stream(spark, tmp_path):
    """A result restarts the wait, however long the one before had asked for."""
    rows = [
        [("s", 100.0, None, "the de"), ("s", 101.7, "the deposit", ""), ("t", 100.0, "", "")], [("s", 102.7, "", "is re")], [("s", 104.4, "is refunded", None)],
        [("s", 105.5, "soon", "")], [("t", 110.0, "", "un")], [("t", 112.5, " ", "")], [("u", 130.0, "end", "")], [("u", 140.0, "", "")],
    ]
    fields = T.StructType([T.StructField("due", T.DoubleType()), T.StructField("text", T.StringType())])
    got = run(spark, tmp_path, rows, "key string, at double, final string, interim string", fields, Utterances, "at", "0 seconds")
    batch = chat.utterances(spark.createDataFrame([r for some in rows for r in some], "key string, at double, final string, interim string"), "key", "at", "final", "interim").collect()
    want = [("s", 105.5, "the deposit is refunded"), ("s", 106.6, "soon"), ("t", 111.8, "un"), ("u", 131.1, "end")]
    assert sorted((r.key, round(r.due, 6), r.text) for r in got) == sorted((r.key, round(r.due, 6), r.text) for r in batch) == want


def test_results_of_one_time(spark):
    """They are taken in the order of the column that tells them apart, and the last one says what is open and how long."""
    rows = [("s", 2, 10.0, "click", None), ("s", 1, 10.0, "view", None), ("t", 1, 10.0, None, "un"), ("t", 2, 10.0, "done", None), ("u", 2, 10.0, None, "un"), ("u", 1, 10.0, "done", None)]
    results = spark.createDataFrame(rows, "key string, n int, at double, final string, interim string").repartition(3)
    got = chat.utterances(results, "key", "at", "final", "interim", tie="n").collect()
    assert sorted((r.key, round(r.due, 6), r.text) for r in got) == [("s", 11.1, "view click"), ("t", 11.1, "done"), ("u", 11.8, "done un")]


def test_utterances_are_rounded_as_in_sql(spark, tmp_path):
    """A time a hair below a half, as a double holds it, is a half once it is scaled."""
    import duckdb

    from lexquarry.plans import catalog

    spark.sql("SELECT 500 * id + 4 - id % 9 AS event_id, timestamp_ntz'2024-01-02 08:26:07' AS ts, id AS user_id, 'view' AS event_type, 1.0D AS value FROM range(20000)").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, catalog.queries()["utterances"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.sql(catalog.oracle_sql()["utterances"]).fetchall())


def test_event_sessions(spark, tmp_path):
    spark.sql("SELECT 'u' AS user_id, timestamp_ntz'2024-01-01 00:00:00' AS ts UNION ALL SELECT 'u', timestamp_ntz'2024-01-01 00:30:00' UNION ALL SELECT 'u', timestamp_ntz'2024-01-01 05:00:00'").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id string, ts timestamp_ntz").parquet(str(tmp_path / "e"))
    q = stateful.event_sessions(stream, "user_id", "ts").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.n for r in spark.sql("SELECT n FROM sessions").collect()] == [2]
