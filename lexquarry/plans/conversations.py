"""Queries over conversations and event streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.functions import audio
from lexquarry.functions import text as X
from lexquarry.operators import chat, fold, replies, store
from lexquarry.operators.machines import BargeIn, RateLimit, SessionTouch, VoiceActivity, configured
from lexquarry.plans.registry import query, table


def _said(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))


@query("""SELECT c.conv_id, count(m.turn) AS n_messages, max(m.turn) AS updated FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT * FROM conversations WHERE role IN ('user', 'assistant')) m USING (conv_id)
 GROUP BY c.conv_id ORDER BY updated DESC NULLS LAST, conv_id LIMIT 200""")
def conversation_summaries(spark, sf_dir):
    heads = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    counted = _said(spark, sf_dir).groupBy("conv_id").agg(F.count("turn").alias("n_messages"), F.max("turn").alias("updated"))
    joined = heads.join(counted, "conv_id", "left").select("conv_id", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), "updated")
    return joined.orderBy(F.desc_nulls_last("updated"), "conv_id").limit(200)


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS n, length(text) AS n_chars FROM conversations WHERE role IN ('user', 'assistant')")
def conversation_detail(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return _said(spark, sf_dir).select("conv_id", "turn", "role", n.alias("n"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT conv_id, turn, role, sha256(substr(text, 1, 8000)) AS content_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')) WHERE r <= 4")
def recent_turns(spark, sf_dir):
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return _said(spark, sf_dir).withColumn("r", last).where("r <= 4").select("conv_id", "turn", "role", F.sha2(F.substring("text", 1, 8000), 256).alias("content_sha256"))


@query(r"""SELECT conv_id, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 57)) || '...' END AS title FROM (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)""")
def conversation_title(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", X.title(F.col("t")).alias("title"))


@query(r"""SELECT conv_id, turn, sha256(CASE WHEN len(regexp_extract_all(text, '\S+')) >= 7 THEN text ELSE trim(coalesce(prev, '') || chr(10) || text, ' ' || chr(10)) END) AS query_sha256 FROM (
  SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role = 'user')""")
def retrieval_query_rewrite(spark, sf_dir):
    previous = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("prev", previous)
    return asked.select("conv_id", "turn", F.sha2(chat.retrieval_query(F.col("text"), F.col("prev")), 256).alias("query_sha256"))


@query(r"""WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role, trim(text, ' ' || chr(10)) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, ' ' || chr(10)) <> ''),
 a AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS f, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM m), b AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM a WHERE turn >= f),
 c AS (SELECT conv_id, g, any_value(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM b GROUP BY conv_id, g), d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY g) AS n, max(g) OVER (PARTITION BY conv_id) AS last FROM c)
 SELECT conv_id, CAST(n AS INT) AS n, role, sha256(text) AS text_sha256 FROM d WHERE NOT (g = last AND role = 'user')""")
def message_normalise(spark, sf_dir):
    """Histories as alternating messages."""
    return chat.normalise(_said(spark, sf_dir), "conv_id", "turn", "role", "text").select("conv_id", "n", "role", F.sha2("text", 256).alias("text_sha256"))


@query()
def sentence_chunks(spark, sf_dir):
    """Assistant texts cut into speakable sentences."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return said.select("conv_id", "turn", F.posexplode(chat.sentences("text")).alias("n", "sentence")).select("conv_id", "turn", "n", F.length("sentence").alias("n_chars"))


SPOKEN_SQL = "text"
for _pattern, _by in X.SPOKEN:
    SPOKEN_SQL = "regexp_replace({}, '{}', '{}', 'g')".format(SPOKEN_SQL, _pattern, _by.replace("$", "\\"))


@query(f"SELECT conv_id, turn, sha256(trim({SPOKEN_SQL}, ' ')) AS spoken_sha256 FROM conversations WHERE role = 'assistant'")
def speakable_text(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return said.select("conv_id", "turn", F.sha2(X.speakable(F.col("text")), 256).alias("spoken_sha256"))


@query("""SELECT conv_id, turn, sha256('event: delta' || chr(10) || 'data: {"n":' || length(text) || ',"role":"' || role || '"}' || chr(10) || chr(10)) AS event_sha256 FROM conversations""")
def sse_events(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    data = F.to_json(F.struct(F.length("text").alias("n"), "role"))
    return said.select("conv_id", "turn", F.sha2(F.concat(F.lit("event: delta\ndata: "), data, F.lit("\n\n")), 256).alias("event_sha256"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def result_from_json(spark, sf_dir):
    parsed = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_id", "event_type", parsed["k"].alias("k"))


@query("""WITH g AS (SELECT user_id, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap, event_id FROM events), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
 SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_touches, CAST(max(epoch(ts)) - min(epoch(ts)) AS BIGINT) AS seconds FROM s GROUP BY user_id, session""")
def session_expiry(spark, sf_dir):
    """Sessions that expire after a day without a touch."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    touched = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    gap = F.col("ts") - F.lag("ts").over(order)
    marked = touched.withColumn("new", F.when(gap.isNull() | (gap > 86400), 1).otherwise(0)).withColumn("session", F.sum("new").over(order))
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n_touches"), F.round(F.max("ts") - F.min("ts"), 0).cast("long").alias("seconds"))


def _hits(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"))


#: Each user's events in order, for rules that need the decision before: a user's n-th event meets what the first n - 1 left.
EVENTS_SQL = "e AS (SELECT user_id, event_id, floor(epoch(ts))::DOUBLE AS sec, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events)"


@query(f"""WITH RECURSIVE {EVENTS_SQL}, f AS (SELECT user_id, event_id, n, sec AS a, NULL::DOUBLE AS b, true AS allowed, NULL::DOUBLE AS wait FROM e WHERE n = 1
 UNION ALL SELECT user_id, event_id, n, CASE WHEN a IS NULL THEN coalesce(b, sec) ELSE a END, CASE WHEN a IS NULL THEN CASE WHEN b IS NOT NULL THEN sec END ELSE coalesce(b, sec) END, a IS NULL OR b IS NULL, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(1, ceil(21600 - (sec - a))) END
  FROM (SELECT e.*, CASE WHEN f.a > e.sec - 21600 THEN f.a END AS a, CASE WHEN f.b > e.sec - 21600 THEN f.b END AS b FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
 SELECT user_id, event_id, allowed, wait::BIGINT AS wait FROM f""")
def rate_limit_decisions(spark, sf_dir):
    """A sliding limit of two hits in six hours for each user; denied hits do not count."""
    added = T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("wait", T.LongType())])
    return fold.ordered_fold(_hits(spark, sf_dir), "user_id", ["at", "event_id"], added, fold.each(configured(RateLimit, limit=2, window=6 * 3600.0), (None, None))).select("user_id", "event_id", "allowed", "wait")


@query(f"""WITH RECURSIVE {EVENTS_SQL}, f AS (SELECT user_id, event_id, n, sec AS seen, 'missing' AS outcome FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.sec - f.seen < 43200 THEN f.seen ELSE e.sec END, CASE WHEN f.seen < e.sec - 259200 THEN 'missing' WHEN e.sec - f.seen < 43200 THEN 'fresh' ELSE 'refreshed' END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
 SELECT user_id, event_id, outcome FROM f""")
def session_touches(spark, sf_dir):
    """Each touch of a session that lives three days: missing, fresh within half a day of the last one written, or refreshed."""
    added = T.StructType([T.StructField("outcome", T.StringType())])
    touch = configured(SessionTouch, ttl=259200.0, interval=43200.0)
    return fold.ordered_fold(_hits(spark, sf_dir), "user_id", ["at", "event_id"], added, fold.each(touch, (None,))).select("user_id", "event_id", "outcome")


@query("""WITH e AS (SELECT user_id, floor(epoch(ts))::DOUBLE + event_id / 1e7 AS sec, CASE WHEN value < 50 THEN event_type ELSE '' END AS fin, CASE WHEN value >= 50 THEN event_type ELSE '' END AS interim FROM events),
 d AS (SELECT *, sec + 21600 + CASE WHEN interim <> '' THEN 14400 ELSE 0 END AS due FROM e), g AS (SELECT *, CASE WHEN sec >= lag(due) OVER (PARTITION BY user_id ORDER BY sec) THEN 1 ELSE 0 END AS b FROM d),
 u AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY sec) AS u FROM g)
 SELECT user_id, round(arg_max(due, sec), 3) AS due, trim(string_agg(CASE WHEN fin <> '' THEN fin || ' ' ELSE '' END, '' ORDER BY sec) || arg_max(interim, sec)) AS text FROM u GROUP BY user_id, u""")
def utterances(spark, sf_dir):
    """Events as results of recognition, whose text stays or may change by their value; a pause of six hours ends an utterance, of
    ten while its text may change. Ids of one second that are neighbours can give one time, as a double holds it; they keep
    their order. Times are rounded as DuckDB does it, scaled first."""
    at = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double") + F.col("event_id") / 1e7
    results = table(spark, sf_dir, "events").select("user_id", "event_id", at.alias("at"), F.when(F.col("value") < 50, F.col("event_type")).alias("final"), F.when(F.col("value") >= 50, F.col("event_type")).alias("interim"))
    return chat.utterances(results, "user_id", "at", "final", "interim", 21600.0, 14400.0, "event_id").select("user_id", (F.round(F.col("due") * 1000) / 1000).alias("due"), "text")


@query("""SELECT event_id, user_id, n, n > 2 AS unstable FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 43200 PRECEDING AND CURRENT ROW) AS n FROM events)""")
def restart_storm(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    n = F.count("*").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(-43200, 0))
    return hits.withColumn("n", n).select("event_id", "user_id", "n", (F.col("n") > 2).alias("unstable"))


#: Voice activity over events as loudness frames: in each step what a frame does to the state, then what the state signals.
VAD_RULE = """ e AS (SELECT user_id, event_id, value / 1000 AS level, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 f(user_id, event_id, n, noise, ripe, quiet, latest, signal) AS (SELECT DISTINCT user_id, NULL::BIGINT, 0::BIGINT, 0.005::DOUBLE, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM events
 UNION ALL SELECT user_id, event_id, n, noise, CASE WHEN signal = 'end' THEN NULL ELSE ripe END, CASE WHEN signal = 'start' THEN ms + {silence} ELSE quiet END, CASE signal WHEN 'start' THEN ripe - {start} + 30000 WHEN 'end' THEN NULL ELSE latest END, signal FROM (
  SELECT *, CASE WHEN latest IS NULL AND ripe IS NOT NULL AND ms >= ripe THEN 'start' WHEN latest IS NOT NULL AND ms >= least(quiet, latest) THEN 'end' END AS signal FROM (
   SELECT user_id, event_id, n, ms, CASE WHEN ms < 500 + {warm} THEN greatest(noise, level) WHEN NOT loud AND latest IS NULL THEN least(0.2::DOUBLE, noise + 0.05::DOUBLE * (level - noise)) ELSE noise END AS noise,
    CASE WHEN loud AND latest IS NULL THEN coalesce(ripe, ms + {start}) WHEN NOT loud AND latest IS NULL THEN NULL ELSE ripe END AS ripe, CASE WHEN loud AND latest IS NOT NULL THEN ms + {silence} ELSE quiet END AS quiet, latest FROM (
    SELECT e.*, e.n * 500 AS ms, f.noise, f.ripe, f.quiet, f.latest, e.n * 500 >= 500 + {warm} AND e.level > {least}::DOUBLE AND e.level > {ratio}::DOUBLE * f.noise AS loud FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))))"""
VAD_SQL = VAD_RULE.format(ratio=2.5, least=0.012, start=180, silence=900, warm=0)
BARGE_SQL = VAD_RULE.format(ratio=3.2, least=0.03, start=320, silence=900, warm=700)


def _frames(spark, sf_dir, kind=VoiceActivity):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    frames = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 1000).alias("level"), n.cast("long").alias("n")).withColumn("ms", F.col("n") * 500)
    added = T.StructType([T.StructField("signal", T.StringType())])
    return frames, fold.ordered_fold(frames, "user_id", ["ms"], added, fold.each(kind, (None,))).where("signal IS NOT NULL")


@query(f"WITH RECURSIVE {VAD_SQL} SELECT user_id, event_id, n * 500 AS ms, signal FROM f WHERE signal IS NOT NULL")
def vad_sessions(spark, sf_dir):
    """Speech starts and ends over events taken as loudness frames, half a second apart."""
    return _frames(spark, sf_dir)[1].select("user_id", "event_id", "ms", "signal")


@query(f"WITH RECURSIVE {BARGE_SQL} SELECT user_id, event_id, n * 500 AS ms FROM f WHERE signal = 'start'")
def barge_ins(spark, sf_dir):
    """Where someone speaks over a voice, whose echo the first frames of a stream hold."""
    return _frames(spark, sf_dir, BargeIn)[1].select("user_id", "event_id", "ms")


@query(f"""WITH RECURSIVE {VAD_SQL}, s AS (SELECT user_id, n, signal, lead(signal) OVER w AS then_, lead(n) OVER w AS last FROM f WHERE signal IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY n)),
 u AS (SELECT s.user_id, s.n AS began, s.last AS ended, count(*) AS frames, round(sum(e.level), 6) AS loudness, string_agg(CAST(e.event_id AS VARCHAR), ',' ORDER BY e.n) AS events FROM s JOIN e ON e.user_id = s.user_id AND e.n BETWEEN s.n - 9 AND s.last WHERE s.signal = 'start' AND s.then_ = 'end' GROUP BY ALL)
 SELECT user_id, began, ended, frames, loudness, 44 + 2 * 2 * frames AS wav_bytes FROM u WHERE frames >= 12""")
def speech_utterances(spark, sf_dir):
    """Utterances of at least six seconds with their pre-roll, from frames of two samples, as WAV files."""
    frames, signals = _frames(spark, sf_dir)
    pairs = frames.withColumn("samples", F.array("level", F.lit(0.0)))
    said = audio.spoken(pairs, signals.select("user_id", "n", "signal"), "user_id", "n", "samples", rate=4, least=6.0)
    size = F.octet_length(audio.wav(F.col("samples"), F.lit(4))).cast("long")
    return said.select("user_id", F.col("start").alias("began"), F.col("end").alias("ended"), F.floor(F.size("samples") / 2).alias("frames"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("loudness"), size.alias("wav_bytes"))


@query("""WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
 SELECT user_id, epoch_us(min(ts)) AS began, count(*) AS n FROM s GROUP BY user_id, i""")
def session_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = events.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.unix_micros("w.start").alias("began"), "n")


#: The log of a store: each user's events are operations on their own conversations, some of other sessions, in order of ids.
LOG_SQL = """
 lg AS (SELECT event_id AS seq, CASE WHEN event_id % 13 = 0 THEN 'u0' ELSE 'u' || user_id END AS session, CASE WHEN event_type = 'error' AND value > 250 THEN NULL ELSE 'c' || user_id || '-' || (event_id % 7) END AS conv,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'message' WHEN 'click' THEN 'message' WHEN 'purchase' THEN 'rename' ELSE CASE WHEN value > 250 THEN 'clear' ELSE 'delete' END END AS op,
  CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' END AS role, repeat(event_type || ' ' || event_id || ' ', 6) AS text FROM events WHERE NOT (event_type = 'error' AND value BETWEEN 60 AND 250))"""


@query(f"""WITH {LOG_SQL}, cr AS (SELECT conv, min(seq) AS since, arg_min(session, seq) AS owner FROM lg WHERE op = 'create' GROUP BY conv),
 ow AS (SELECT lg.*, since FROM lg JOIN cr ON cr.conv = lg.conv AND session = owner AND seq > since WHERE op NOT IN ('create', 'clear')),
 lf AS (SELECT * FROM cr WHERE conv NOT IN (SELECT conv FROM ow WHERE op = 'delete') AND NOT EXISTS (SELECT 1 FROM lg WHERE op = 'clear' AND session = owner AND seq > since)),
 kn AS (SELECT conv, count(*) FILTER (op = 'message') AS n_messages, max(seq) AS last_seq, arg_max(text, seq) FILTER (op = 'rename') AS named, trim(arg_min(text, seq) FILTER (op = 'message' AND role = 'user')) AS opening,
  string_agg(seq || role, ',' ORDER BY seq) FILTER (op = 'message') AS said FROM ow GROUP BY conv)
 SELECT conv, owner AS session, coalesce(named, CASE WHEN length(opening) <= 60 THEN opening ELSE rtrim(substr(opening, 1, 57)) || '...' END, '') AS title, coalesce(n_messages, 0) AS n_messages, coalesce(last_seq, since) AS updated, coalesce(said, '') AS said FROM lf LEFT JOIN kn USING (conv)""")
def conversation_store(spark, sf_dir):
    """What is left of conversations after a log of creations, messages, renamings and deletions by their sessions and others."""
    kind, value, number = F.col("event_type"), F.col("value"), F.col("event_id").cast("string")
    events = table(spark, sf_dir, "events").where(~((kind == "error") & value.between(60, 250)))
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    log = events.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 13 == 0, "u0").otherwise(user).alias("session"), F.when((kind == "error") & (value > 250), None).otherwise(F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 7).cast("string"))).alias("conv"),
        F.when(kind == "signup", "create").when(kind.isin("view", "click"), "message").when(kind == "purchase", "rename").when(value > 250, "clear").otherwise("delete").alias("op"),
        F.when(kind == "view", "user").when(kind == "click", "assistant").alias("role"), F.repeat(F.concat(kind, F.lit(" "), number, F.lit(" ")), F.lit(6)).alias("text"),
    )
    said = F.coalesce(F.array_join(F.transform("messages", lambda m: F.concat(m["seq"].cast("string"), m["role"])), ","), F.lit(""))
    return store.conversations_after(log).select("conv", "session", "title", "n_messages", "updated", said.alias("said"))


@query(r"""WITH t AS (SELECT conv_id, turn, string_split(regexp_replace(text, '[\s"\\]+', ' ', 'g'), ' ') AS w FROM conversations WHERE role = 'assistant'),
 c AS (SELECT conv_id, turn, array_to_string(w[1:4], ' ') || ' ' || array_to_string(w[5:8], ' ') AS text, list_filter(['https://a.example/' || (turn % 3), 'https://b.example/' || w[1], CASE WHEN turn % 2 = 0 THEN '' ELSE 'https://c.example/' END], lambda u: u <> '') AS uris FROM t),
 u AS (SELECT conv_id, turn, unnest(uris) AS uri, unnest(range(len(uris))) AS pos FROM c), f AS (SELECT conv_id, uri, min(turn * 10 + pos) AS place FROM u GROUP BY conv_id, uri), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS n FROM f),
 q AS (SELECT conv_id, 'what of ' || (turn % 7) AS query, min(turn) AS place FROM t GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS n FROM q)
 SELECT a.conv_id, sha256(answer) AS answer_sha256, sources, queries FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS answer FROM c GROUP BY conv_id) a
  LEFT JOIN (SELECT conv_id, string_agg(uri, ' ' ORDER BY n) AS sources FROM r WHERE n <= 8 GROUP BY conv_id) USING (conv_id) LEFT JOIN (SELECT conv_id, string_agg(query, '|' ORDER BY n) AS queries FROM p WHERE n <= 5 GROUP BY conv_id) USING (conv_id)""")
def streamed_answers(spark, sf_dir):
    """Each conversation's assistant turns as chunks of one streamed reply, with thoughts, searches and web sources."""
    w = F.split(F.regexp_replace("text", r'[\s"\\]+', " "), " ")
    part = lambda text, thought: F.struct(text.alias("text"), F.lit(thought).alias("thought"))
    parts = F.array(part(F.array_join(F.slice(w, 1, 4), " "), False), part(F.lit(" a thought "), True), part(F.concat(F.lit(" "), F.array_join(F.slice(w, 5, 4), " ")), False))
    turn = F.col("turn")
    uris = F.array(F.concat(F.lit("https://a.example/"), (turn % 3).cast("string")), F.concat(F.lit("https://b.example/"), F.get(w, F.lit(0))), F.when(turn % 2 != 0, "https://c.example/").otherwise(""))
    found = F.struct(F.array(F.concat(F.lit("what of "), (turn % 7).cast("string"))).alias("web_search_queries"), F.transform(uris, lambda u: F.struct(F.struct(u.alias("uri")).alias("web"))).alias("grounding_chunks"))
    chunk = F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"), found.alias("grounding_metadata"))).alias("candidates")))
    chunks = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("answer_id"), turn.alias("seq"), chunk.alias("chunk"))
    rows = replies.answers(chunks)
    return rows.select(F.col("answer_id").alias("conv_id"), F.sha2("answer", 256).alias("answer_sha256"), F.array_join(F.transform("web_sources", lambda s: s["uri"]), " ").alias("sources"), F.array_join("search_queries", "|").alias("queries"))
