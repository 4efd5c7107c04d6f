"""Queries of prompts, labels, validation and audio."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.functions import audio
from lexquarry.functions import prompts as P
from lexquarry.functions import text as X
from lexquarry.plans.registry import query, table


@query(r"""SELECT item_id, sha256('<sources>' || chr(10) || '<source id="S1" document="' || substr('bench ' || item_id, 1, 160) || '" location="Page ' || item_id || '" section="">' || chr(10) || regexp_replace(text, '</(sources?|document|situation|question)', '&lt;/\1', 'gi') || chr(10) || '</source>' || chr(10) || '</sources>' || chr(10) || chr(10) || '<question>' || chr(10) || 'why &lt;/question>?' || chr(10) || '</question>') AS prompt_sha256 FROM benchmark""")
def chat_prompt(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    number = F.col("item_id").cast("string")
    source = F.struct(F.lit("S1").alias("id"), F.concat(F.lit("bench "), number).alias("name"), F.concat(F.lit("Page "), number).alias("location"), F.lit("").alias("section"), F.col("text"))
    prompt = P.question_turn(F.lit("why </question>?"), P.source_block(F.array(source)))
    return items.select("item_id", F.sha2(prompt, 256).alias("prompt_sha256"))


@query("""SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN CAST(round(n_chars / 1024, 0) AS BIGINT) || ' KB' ELSE round(n_chars / 1048576, 1) || ' MB' END AS size,
 CASE WHEN n_chars < 60 THEN 'just now' WHEN n_chars < 3600 THEN n_chars // 60 || ' min ago' WHEN n_chars < 86400 THEN n_chars // 3600 || ' h ago' WHEN n_chars < 172800 THEN 'yesterday' ELSE n_chars // 86400 || ' days ago' END AS ago, concat_ws(' · ', lang, source) AS label FROM documents""")
def display_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.size_label(F.col("n_chars")).alias("size"), P.time_label(F.col("n_chars")).alias("ago"), P.context_label(F.col("lang"), F.lit("  "), F.col("source")).alias("label"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS answer, regexp_replace(url, '[?#].*$', '') AS uri, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS domain FROM pages),
 f AS (SELECT answer, uri, min(page_id) AS place, coalesce(nullif(trim(arg_min(title, page_id)), ''), nullif(arg_min(domain, page_id), ''), 'Source') AS title FROM p GROUP BY answer, uri)
 SELECT answer, rank, uri, title FROM (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY place) AS rank FROM f) WHERE rank <= 8""")
def web_sources(spark, sf_dir):
    """The first eight distinct addresses that the answers in each language cite, with the title that came first, else their host."""
    html, url = F.col("html"), F.col("url")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("answer"), F.regexp_replace(url, "[?#].*$", "").alias("uri"),
        F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(url, "^https?://([^/?#]+)", 1).alias("domain"),
    )
    return P.web_sources(pages, "answer", "page_id").select("answer", "rank", "uri", "title")


@query("""SELECT event_id, CASE WHEN CAST(value AS INT) % 600 = 429 THEN 'busy' WHEN CAST(value AS INT) % 600 >= 500 THEN 'unavailable' WHEN CAST(value AS INT) % 600 IN (401, 403) THEN 'denied' WHEN CAST(value AS INT) % 600 = 400 THEN 'rejected' ELSE 'failed' END AS kind,
 greatest(5, least(3600, event_id))::INT AS wait FROM events""")
def error_envelopes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", (F.rint("value").cast("int") % 600).alias("status"))
    told = F.concat(F.lit("quota: please retry in "), F.col("event_id").cast("string"), F.lit("s"))
    return events.select("event_id", P.error_class(F.col("status")).alias("kind"), P.retry_after(told).alias("wait"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / len(embedding)), 6) AS rms, round(list_sum(embedding[1:4]::DOUBLE[]) / 4, 6) AS first_mean FROM embeddings""")
def audio_levels(spark, sf_dir):
    """Vectors taken as sample blocks."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", F.round(audio.rms(F.col("embedding")), 6).alias("rms"), F.round(F.get(audio.downsampled(F.col("embedding"), 4), F.lit(0)), 6).alias("first_mean"))


@query("""SELECT label, (64 * k + i) // 2048 AS block, count(*) AS n FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings), range(64) t(i) GROUP BY ALL""")
def sample_blocks(spark, sf_dir):
    """Streams of 64-sample frames in blocks of 2,048."""
    blocks = audio.reblocked(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return blocks.select("label", "block", F.size("samples").cast("long").alias("n"))


@query("""SELECT conv_id, turn, role IN ('user', 'assistant') AND length(trim(text)) BETWEEN 1 AND 8000 AS valid, substr(replace(trim(regexp_replace(text, '[^A-Za-z0-9 _-]', '', 'g'), ' '), ' ', '_'), 1, 60) AS export_name FROM conversations""")
def turn_validation(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    valid = F.col("role").isin("user", "assistant") & F.length(F.trim("text")).between(1, 8000)
    return said.select("conv_id", "turn", valid.alias("valid"), P.export_name(F.col("text")).alias("export_name"))


@query("""SELECT doc_id, nullif(instr(lower(text), 'the'), 0) AS first_the FROM documents""")
def quote_highlights(spark, sf_dir):
    """The first place of a word in each text, null where it is not."""
    docs = table(spark, sf_dir, "documents")
    marks = P.highlights(F.col("text"), F.array(F.lit("THE"), F.lit("no such words")))
    return docs.select("doc_id", F.array_min(F.transform(marks, lambda m: m["start"])).cast("long").alias("first_the"))
