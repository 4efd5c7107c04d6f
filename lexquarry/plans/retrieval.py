"""Queries of retrieval and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.functions import text as X
from lexquarry.operators import analysis
from lexquarry.operators import grounding as G
from lexquarry.operators import retrieval as R
from lexquarry.plans.documents import tokens_sql
from lexquarry.plans.registry import query, table

#: The questions are eight words of every document whose id is divisible by 20, from its third on; of every third such document they
#: are a word that nobody wrote.
QUESTION_SQL = r"SELECT doc_id AS query_id, CASE WHEN doc_id % 60 = 40 THEN 'qzxw' || doc_id ELSE array_to_string(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')[3:10], ' ') END AS question FROM documents WHERE doc_id % 20 = 0"


def questions(spark, sf_dir):
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    asked = F.when(F.col("doc_id") % 60 == 40, F.concat(F.lit("qzxw"), F.col("doc_id").cast("string"))).otherwise(F.array_join(F.slice(words, 3, 8), " "))
    return table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), asked.alias("question"))


INDEX_SQL = f"""
 q AS ({QUESTION_SQL}), qt AS (SELECT DISTINCT query_id, unnest({tokens_sql('question')}) AS term FROM q),
 t AS (SELECT doc_id AS item, {tokens_sql('text')} AS tokens FROM documents), st AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM t),
 p AS (SELECT item, len(tokens) AS length, unnest(tokens) AS term FROM t), posts AS (SELECT term, item, length, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
 scored AS (SELECT query_id, item, sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score
   FROM posts JOIN df USING (term) JOIN qt USING (term), st GROUP BY query_id, item)"""


@query(f"""WITH {INDEX_SQL} SELECT term, df, round(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, st""")
def bm25_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = R.frequencies(R.postings(docs, "doc_id"))
    return counts.crossJoin(F.broadcast(R.statistics(docs))).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"""WITH {INDEX_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) - 1 AS rank FROM scored)
 SELECT query_id, item AS doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank, 'S' || row_number() OVER (PARTITION BY query_id ORDER BY item) AS source_id FROM r WHERE rank < 8""")
def bm25_topk(spark, sf_dir):
    """The flagship: questions over the whole corpus, the best eight passages of each as numbered sources."""
    scores = R.lexical(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 8, "doc_id")
    top = R.numbered(R.best(scores, 8, "item"), "item")
    return top.select("query_id", F.col("item").alias("doc_id"), F.round("score", 6).alias("score"), "rank", "source_id")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / CASE WHEN list_dot_product(v, v) = 0 THEN 1 ELSE sqrt(list_dot_product(v, v)) END) AS v FROM v),
 s AS (SELECT q.vec_id AS query_id, u.vec_id AS item, list_dot_product(q.v, u.v) AS score FROM u, u q WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) - 1 AS rank FROM s)
 SELECT query_id, item, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank < 8""")
def dense_topk(spark, sf_dir):
    """The best eight vectors for each query, which are those with ids divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return R.best(R.dense(vectors, asked, 8, "vec_id", "embedding"), 8, "item").select("query_id", "item", F.round("score", 6).alias("score"), "rank")


EMBED_SQL = "CAST('0x' || right(md5({}), 2) AS INT) % 64"


@query(f"""WITH t AS (SELECT doc_id, {EMBED_SQL.format('term')} AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY ALL),
 s AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM t GROUP BY doc_id) SELECT doc_id, CAST(bucket AS INT) AS bucket, round(n / norm, 6) AS weight FROM t JOIN s USING (doc_id)""")
def hash_embedding(spark, sf_dir):
    """The non-zero entries of each text's bag-of-words vector, from token counts rather than a dense fold."""
    counted = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(X.tokenize(F.col("text")), lambda t: X.hash_bucket(t))).alias("bucket")).groupBy("doc_id", "bucket").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    norm = F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double")).over(Window.partitionBy("doc_id")))
    return counted.select("doc_id", "bucket", F.round(F.col("n") / norm, 6).alias("weight"))


#: The index of embedding texts: name (here the source) and section (the language) before the text; vectors by the document's id.
HYBRID_SQL = INDEX_SQL.replace(tokens_sql("text") + " AS tokens FROM documents", tokens_sql("source || CASE WHEN coalesce(lang, '') <> '' THEN ' / ' || lang ELSE '' END || chr(10) || text") + " AS tokens FROM documents")
FUSED_SQL = f"""{HYBRID_SQL}, v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / CASE WHEN list_dot_product(v, v) = 0 THEN 1 ELSE sqrt(list_dot_product(v, v)) END) AS v FROM v),
 l AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) - 1 AS rank FROM scored),
 c AS (SELECT q.query_id, d.doc_id AS item, row_number() OVER (PARTITION BY q.query_id ORDER BY round(coalesce(list_dot_product(a.v, b.v), 0), 9) DESC, d.doc_id) - 1 AS rank FROM q JOIN u a ON a.vec_id = q.query_id, documents d LEFT JOIN u b ON b.vec_id = d.doc_id),
 a AS (SELECT query_id, item, 0 AS source, rank FROM l WHERE rank < 40 UNION ALL SELECT query_id, item, 1, rank FROM c WHERE rank < 40),
 f AS (SELECT query_id, item, sum(1.0::DOUBLE / (60 + rank + 1)) AS score, min(source * 1000 + rank) AS place FROM a GROUP BY query_id, item)"""


def _hybrid(spark, sf_dir):
    """Documents as items, the questions with their vectors (some have none), and the items' vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), R.embedding_text(F.col("source"), F.col("lang"), F.col("text")).alias("text"), F.col("source").alias("document"))
    asked = questions(spark, sf_dir)
    return items, R.with_vectors(asked, vectors.select(F.col("item").alias("query_id"), F.col("vector").alias("query_vector")), "query_id", "query_vector"), vectors


@query(f"WITH {FUSED_SQL} SELECT query_id, item, round(score, 6) AS score FROM f")
def rrf_fusion(spark, sf_dir):
    """Ranks by BM25 and by vectors, fused."""
    items, asked, vectors = _hybrid(spark, sf_dir)
    return R.fuse(R.legs(items, asked, 40, vectors)).select("query_id", "item", F.round("score", 6).alias("score"))


@query(f"""WITH {FUSED_SQL}, o AS (SELECT query_id, item, score, place FROM f UNION ALL SELECT q.query_id, d.doc_id, 0, d.place FROM q, (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents ORDER BY doc_id LIMIT 8) d WHERE q.query_id NOT IN (SELECT query_id FROM f)),
 r AS (SELECT o.*, d.source AS document, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, place) AS rank FROM o JOIN documents d ON d.doc_id = o.item),
 i AS (SELECT *, row_number() OVER (PARTITION BY query_id, document ORDER BY rank) AS in_doc FROM r), s AS (SELECT * FROM i WHERE rank <= 8 OR in_doc = 1)
 SELECT query_id, item, document, CAST(rank AS INT) AS rank, round(score, 6) AS score, 'S' || row_number() OVER (PARTITION BY query_id ORDER BY document, item) AS source_id FROM s""")
def hybrid_diversified(spark, sf_dir):
    """The whole search: both legs over embedding texts, fused, a fallback for questions without an answer, every source served."""
    items, asked, vectors = _hybrid(spark, sf_dir)
    chosen = R.search(items, asked, 8, 40, "document", vectors)
    return R.numbered(chosen, "document", "item").select("query_id", "item", "document", "rank", F.round("score", 6).alias("score"), "source_id")


WORDS_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}\p{{M}}_]+')"
GROUND_SQL = f"""
 b AS (SELECT item_id AS quote_id, {WORDS_SQL.format('text')} AS w FROM benchmark), d AS (SELECT doc_id AS source_id, {WORDS_SQL.format('text')} AS w FROM documents),
 dj AS (SELECT source_id, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM d), bj AS (SELECT quote_id, ' ' || array_to_string(w, ' ') || ' ' AS needle FROM b),
 ex AS (SELECT quote_id, min(source_id) AS source_id FROM bj JOIN dj ON contains(joined, needle) GROUP BY quote_id),
 bg AS (SELECT DISTINCT quote_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM b), bn AS (SELECT quote_id, count(*) AS total FROM bg GROUP BY quote_id),
 dg AS (SELECT DISTINCT source_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM d),
 cv AS (SELECT quote_id, source_id, count(*)::DOUBLE / any_value(total) AS c FROM bg JOIN dg USING (gram) JOIN bn USING (quote_id) GROUP BY quote_id, source_id),
 mx AS (SELECT quote_id, max(c) AS coverage, arg_min(source_id, (-c, source_id)) AS source_id FROM cv GROUP BY quote_id)"""


def _quotes(spark, sf_dir):
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return quotes, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")


@query(f"WITH {GROUND_SQL} SELECT quote_id, source_id FROM ex")
def quote_exact(spark, sf_dir):
    return G.exact(*_quotes(spark, sf_dir))


@query(f"WITH {GROUND_SQL} SELECT quote_id, source_id, round(coverage, 6) AS coverage FROM mx")
def quote_coverage(spark, sf_dir):
    return G.coverage(*_quotes(spark, sf_dir)).select("quote_id", "source_id", F.round("coverage", 6).alias("coverage"))


CHECK_SQL = f"""{GROUND_SQL}, ck AS (SELECT b.quote_id, CASE WHEN ex.source_id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(coverage, 0) END AS share, coalesce(ex.source_id, mx.source_id) AS s FROM b LEFT JOIN ex USING (quote_id) LEFT JOIN mx USING (quote_id)),
 st AS (SELECT quote_id, CASE WHEN share >= 0.9 THEN 'verified' WHEN share >= 0.6 THEN 'partial' ELSE 'unverified' END AS status, round_even(share, 2) AS coverage, CASE WHEN share >= 0.6 THEN s END AS source_id FROM ck)"""


@query(f"WITH {CHECK_SQL} SELECT quote_id, status, coverage, source_id FROM st")
def quote_check(spark, sf_dir):
    return G.check(*_quotes(spark, sf_dir))


#: The fragments of each shortened passage in the place of the passages, numbered within them.
ELIDED_SQL = CHECK_SQL.replace(
    f"b AS (SELECT item_id AS quote_id, {WORDS_SQL.format('text')} AS w FROM benchmark)",
    f"""z AS (SELECT item_id, array_to_string(p[1:8], ' ') || ' ... ' || array_to_string(p[greatest(len(p) - 7, 1):greatest(len(p) - 7, 1) + 7], ' ') AS quote FROM (SELECT item_id, string_split(text, ' ') AS p FROM benchmark)),
 y AS (SELECT item_id, quote, list_filter(string_split_regex(quote, '\\.{{3,}}|\\[\\.\\.\\.\\]|…'), lambda x: len({WORDS_SQL.format('x')}) >= 3) AS parts FROM z),
 x AS (SELECT item_id, CASE WHEN len(parts) >= 2 THEN parts ELSE [quote] END AS parts FROM y), b AS (SELECT item_id * 1000 + no AS quote_id, {WORDS_SQL.format('part')} AS w FROM (SELECT item_id, unnest(range(len(parts))) AS no, unnest(parts) AS part FROM x))""",
)


@query(f"""WITH {ELIDED_SQL}, rk AS (SELECT quote_id // 1000 AS quote_id, row_number() OVER (PARTITION BY quote_id // 1000 ORDER BY CASE status WHEN 'unverified' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, coverage, st.quote_id) AS n, status, coverage, source_id FROM st)
 SELECT quote_id, status, coverage, source_id FROM rk WHERE n = 1""")
def elided_quote(spark, sf_dir):
    """Benchmark passages with their middle left out: each must hold fragment by fragment."""
    quotes, sources = _quotes(spark, sf_dir)
    words = F.split("quote", " ")
    cut = F.concat(F.array_join(F.slice(words, 1, 8), " "), F.lit(" ... "), F.array_join(F.slice(words, F.greatest(F.size(words) - 7, F.lit(1)), 8), " "))
    return G.check_elided(quotes.select("quote_id", cut.alias("quote")), sources)


ANSWER_SQL = "('By [S' || (item_id % 3 + 1) || ', S2] and [S' || (item_id % 7) || ']; see [S2].')"


@query(rf"SELECT item_id, array_to_string(list_distinct_ordered, ',') AS cited FROM (SELECT item_id, list_filter(c, lambda x, i: list_position(c, x) = i) AS list_distinct_ordered FROM (SELECT item_id, regexp_extract_all({ANSWER_SQL}, 'S\d+') AS c FROM benchmark))")
def citation_extract(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.citations(_answer()), ",").alias("cited"))


def _answer():
    return F.concat(F.lit("By [S"), (F.col("item_id") % 3 + 1).cast("string"), F.lit(", S2] and [S"), (F.col("item_id") % 7).cast("string"), F.lit("]; see [S2]."))


@query(f"""WITH {CHECK_SQL} SELECT quote_id, CASE WHEN quote_id % 7 = 0 OR quote_id % 7 > 5 OR status = 'unverified' THEN 'unverified' WHEN status = 'partial' THEN 'partially_grounded' ELSE 'grounded' END AS verdict FROM st""")
def grounding_verdict(spark, sf_dir):
    """Answers that quote a passage and cite sources S1 to S5."""
    quotes, sources = _quotes(spark, sf_dir)
    cited = X.citations(F.concat(F.lit("By [S"), (F.col("quote_id") % 3 + 1).cast("string"), F.lit(", S2] and [S"), (F.col("quote_id") % 7).cast("string"), F.lit("]; see [S2].")))
    known = F.array(*[F.lit(f"S{i}") for i in range(1, 6)])
    return G.check(quotes, sources).select("quote_id", G.verdict(cited, F.array_except(cited, known), F.array("status")).alias("verdict"))


#: Answers to every assistant turn, each with three documents as its sources S1 to S3: quotes taken from them word by word, one
#: with its last words changed, a short one, one that is in none, and citations near, far and of no source.
ANSWER_SOURCES_SQL = """
 n AS (SELECT count(*) AS docs FROM documents), turns AS (SELECT conv_id, turn, conv_id * 1000 + turn AS answer_id, text FROM conversations WHERE role = 'assistant'),
 src AS (SELECT answer_id, no AS source_id, d.text FROM turns, n, (SELECT unnest([1, 2, 3]) AS no) JOIN documents d ON d.doc_id = (conv_id * 31 + turn * 7 + no * 13) % docs),
 w AS (SELECT answer_id, source_id, string_split(regexp_replace(text, '["“”\\s]+', ' ', 'g'), ' ') AS w FROM src),
 ans AS (SELECT answer_id, text || ' It says "' || coalesce(array_to_string(w1.w[3:12], ' '), '') || '" [S1]. And “' || coalesce(array_to_string(w2.w[2:14], ' '), '') || ' never ever” (see [S2, S7]); "'
   || coalesce(array_to_string(w1.w[2:4], ' '), '') || '" "' || coalesce(array_to_string(w3.w[5:10], ' '), '') || '" or "words that nobody has written anywhere" ' || CASE WHEN answer_id % 3 = 0 THEN '[S1]' ELSE 'as they say' END AS answer
  FROM turns LEFT JOIN w w1 USING (answer_id) LEFT JOIN w w2 USING (answer_id) LEFT JOIN w w3 USING (answer_id) WHERE coalesce(w1.source_id, 1) = 1 AND coalesce(w2.source_id, 2) = 2 AND coalesce(w3.source_id, 3) = 3)"""


def _answers(spark, sf_dir):
    docs, said = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    turns = said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "turn", "text")
    wanted = turns.select("answer_id", "conv_id", "turn", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("source_id")).crossJoin(docs.agg(F.count("*").alias("docs")))  # one row
    wanted = wanted.select("answer_id", "source_id", ((F.col("conv_id") * 31 + F.col("turn") * 7 + F.col("source_id") * 13) % F.col("docs")).alias("doc_id"))
    sources = wanted.join(docs.select("doc_id", "text"), "doc_id").select("answer_id", "source_id", "text")
    words = F.split(F.regexp_replace("text", r'["“”\s]+', " "), " ")
    parts = sources.groupBy("answer_id").agg(*[F.max(F.when(F.col("source_id") == no, F.array_join(F.slice(words, a, n), " "))).alias(name) for no, a, n, name in ((1, 3, 10, "q1"), (2, 2, 13, "q2"), (1, 2, 3, "q3"), (3, 5, 6, "q4"))])
    q = [F.coalesce(c, F.lit("")) for c in ("q1", "q2", "q3", "q4")]
    end = F.when(F.col("answer_id") % 3 == 0, "[S1]").otherwise("as they say")
    answer = F.concat("text", F.lit(' It says "'), q[0], F.lit('" [S1]. And “'), q[1], F.lit(' never ever” (see [S2, S7]); "'), q[2], F.lit('" "'), q[3], F.lit('" or "words that nobody has written anywhere" '), end)
    return turns.join(parts, "answer_id", "left").select("answer_id", answer.alias("answer")), sources


#: The scan of an answer for quotes: each is the leftmost after the one before, so its place is the first of its text there.
SPANS_SQL = """
 found AS (SELECT answer_id, answer, regexp_extract_all(answer, '"[^"\n]{1,600}"|“[^”\n]{1,600}”') AS s FROM ans),
 scan(answer_id, k, quote, rest) AS (SELECT answer_id, 0, '', answer FROM found
  UNION ALL SELECT f.answer_id, k + 1, f.s[k + 1], substr(rest, instr(rest, f.s[k + 1]) + length(f.s[k + 1])) FROM scan JOIN found f USING (answer_id) WHERE k < len(f.s)),
 sp AS (SELECT answer_id, k, trim(substr(quote, 2, length(quote) - 2)) AS quote, left(rest, 80) AS after FROM scan WHERE k > 0),
 sq AS (SELECT *, list_transform(regexp_extract_all(after, '\\[\\s*S\\d+(?:\\s*[,;]\\s*S\\d+)*\\s*\\]'), lambda c: regexp_extract_all(c, 'S\\d+')) AS near FROM sp WHERE len(list_filter(string_split(quote, ' '), lambda x: x <> '')) >= 4),
 qw AS (SELECT *, regexp_extract_all(lower(quote), '[\\p{L}\\p{N}\\p{M}_]+') AS w FROM sq), sw AS (SELECT answer_id, source_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+') AS w FROM src),
 qg AS (SELECT *, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM qw),
 sg AS (SELECT *, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM sw),
 ck AS (SELECT qg.answer_id, k, any_value(quote) AS quote, any_value(near) AS near, max(CASE WHEN contains(' ' || array_to_string(sg.w, ' ') || ' ', ' ' || array_to_string(qg.w, ' ') || ' ') THEN 1.0::DOUBLE WHEN len(qg.g) > 0 THEN len(list_intersect(qg.g, sg.g))::DOUBLE / len(qg.g) ELSE 0 END) AS share
   FROM qg LEFT JOIN sg USING (answer_id) GROUP BY qg.answer_id, k),
 kn AS (SELECT answer_id, list(DISTINCT 'S' || source_id) AS known FROM src GROUP BY answer_id),
 st AS (SELECT *, CASE WHEN coalesce(share, 0) >= 0.9 THEN 'verified' WHEN share >= 0.6 THEN 'partial' ELSE 'unverified' END AS status FROM ck LEFT JOIN kn USING (answer_id)),
 kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY k) AS n FROM st WHERE status = 'verified' OR coalesce(len(list_intersect(flatten(near), known)), 0) > 0) WHERE n <= 12),
 ct AS (SELECT answer_id, list_filter(c, lambda x, i: list_position(c, x) = i) AS cited FROM (SELECT answer_id, flatten(list_transform(regexp_extract_all(answer, '\\[\\s*S\\d+(?:\\s*[,;]\\s*S\\d+)*\\s*\\]'), lambda c: regexp_extract_all(c, 'S\\d+'))) AS c FROM ans)),
 ag AS (SELECT answer_id, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'unverified') AS unverified, string_agg(quote, '|' ORDER BY n) FILTER (status = 'unverified') AS unmatched FROM kp GROUP BY answer_id),
 rp AS (SELECT answer_id, cited, list_filter(cited, lambda c: NOT list_contains(coalesce(known, []), c)) AS invalid, coalesce(verified, 0) AS verified, coalesce(partial, 0) AS partial, coalesce(unverified, 0) AS unverified, coalesce(unmatched, '') AS unmatched
   FROM ct LEFT JOIN kn USING (answer_id) LEFT JOIN ag USING (answer_id))"""


@query(f"""WITH RECURSIVE {ANSWER_SOURCES_SQL}, {SPANS_SQL}
 SELECT answer_id, array_to_string(cited, ',') AS cited, array_to_string(invalid, ',') AS invalid, verified, partial, unverified, verified || '/' || (verified + partial + unverified) AS badge,
  CASE WHEN unverified > 0 THEN 'unverified' WHEN partial > 0 THEN 'partial' WHEN verified > 0 THEN 'verified' ELSE 'none' END AS tone, unmatched,
  CASE WHEN len(cited) = 0 AND verified + partial + unverified = 0 THEN 'general_knowledge' WHEN len(invalid) > 0 OR unverified > 0 THEN 'unverified' WHEN partial > 0 THEN 'partially_grounded' ELSE 'grounded' END AS verdict FROM rp""")
def answer_reports(spark, sf_dir):
    """Grounding reports of answers to every assistant turn, each against its own three documents."""
    rows = G.report(*_answers(spark, sf_dir))
    return rows.select("answer_id", F.array_join("cited", ",").alias("cited"), F.array_join("invalid", ",").alias("invalid"), "verified", "partial", "unverified", "badge", "tone", F.array_join("unmatched", "|").alias("unmatched"), "verdict")


@query(f"WITH RECURSIVE {ANSWER_SOURCES_SQL}, {SPANS_SQL} SELECT answer_id, n, quote, status, round_even(coalesce(share, 0), 2) AS coverage FROM kp")
def answer_quotes(spark, sf_dir):
    """The quotes of those answers that must hold up, in order, with what they were found to be."""
    return G.answer_quotes(*_answers(spark, sf_dir)).select("answer_id", F.col("n").cast("long").alias("n"), "quote", "status", "coverage")


#: A result for every document, with quotes taken from it at two depths: as they are, lengthened, blank, and of nobody.
FINDINGS_SQL = """
 t AS (SELECT doc_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS p, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+') AS w FROM documents),
 f AS (SELECT doc_id, w, unnest([0, 1, 2, 3]) AS no, unnest([array_to_string(p[3:12], ' '), array_to_string(p[2:11], ' ') || ' never ever', array_to_string(p[5:14], ' '), 'words nobody has written']) AS quote FROM t),
 g AS (SELECT *, regexp_extract_all(lower(quote), '[\\p{L}\\p{N}\\p{M}_]+') AS q FROM f),
 h AS (SELECT *, list_distinct(list_transform(range(1, len(q) - 1), lambda i: q[i] || ' ' || q[i + 1] || ' ' || q[i + 2])) AS qg, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS wg FROM g),
 i AS (SELECT *, CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ') THEN 1.0::DOUBLE WHEN len(qg) > 0 THEN len(list_intersect(qg, wg))::DOUBLE / len(qg) ELSE 0 END AS share FROM h),
 k AS (SELECT doc_id, no, CASE WHEN len(q) = 0 THEN 'none' WHEN share >= 0.9 THEN 'verified' WHEN share >= 0.6 THEN 'partial' ELSE 'unverified' END AS status FROM i)"""


@query(f"""WITH {FINDINGS_SQL} SELECT doc_id, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'unverified') AS unverified,
 max(CASE WHEN no = 0 THEN status END) AS first_status, max(CASE WHEN no = 1 THEN status END) AS longer_status, 'none' AS blank_status, max(CASE WHEN no = 2 THEN status END) AS nested_status FROM k GROUP BY doc_id""")
def finding_statuses(spark, sf_dir):
    """Results of an analysis of every document, as JSON, with each of their quotes marked in place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    words = lambda a, n: F.array_join(F.slice(part, a, n), " ")
    clause = lambda quote: F.struct(quote.alias("quote"))
    pair = F.struct(words(5, 10).alias("quote"), F.lit("words nobody has written").alias("conflicting_quote"))
    result = F.struct(F.array(clause(words(3, 10)), clause(F.concat(words(2, 10), F.lit(" never ever"))), clause(F.lit(" "))).alias("clauses"), F.struct(F.array(pair).alias("inconsistencies")).alias("more"))
    rows = analysis.annotated(docs.select("doc_id", F.to_json(result).alias("result")), docs.withColumn("source_id", F.col("doc_id")), "doc_id", "result")
    paths = {"first_status": "$.clauses[0].quote_status", "longer_status": "$.clauses[1].quote_status", "blank_status": "$.clauses[2].quote_status", "nested_status": "$.more.inconsistencies[0].quote_status"}
    return rows.select("doc_id", *analysis.COUNTED, *[F.get_json_object("result", path).alias(name) for name, path in paths.items()])
