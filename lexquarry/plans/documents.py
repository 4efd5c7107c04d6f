"""Queries over documents: tokens, headings, segments, libraries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.functions import text as X
from lexquarry.operators import fold, store
from lexquarry.operators.chunking import chunk_documents
from lexquarry.plans.registry import query, table
from lexquarry.sources.html import html_text

STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
SUFFIX = "|".join(X.SUFFIXES)


def stem_sql(w: str) -> str:
    return rf"regexp_replace(regexp_replace({w}, '^(.{{4,}}?)(?:{SUFFIX})$', '\1'), '^(.{{4,}})e$', '\1')"


def tokens_sql(text: str) -> str:
    return rf"list_transform(list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: w NOT IN ({STOP})), lambda w: {stem_sql('w')})"


@query(f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokenize_terms(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@query(rf"SELECT word, {stem_sql('word')} AS stem, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+')) AS word FROM documents) GROUP BY word)")
def stem_vocabulary(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(X.words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return found.select("word", X.stem(F.col("word")).alias("stem"), "n")


HEADING_SQL = r"""
  coalesce(l <> '' AND NOT (length(l) > 90 OR len(string_split(l, ' ')) > 12) AND NOT (regexp_matches(l, '[,;]$') OR (ends_with(l, '.') AND len(string_split(l, ' ')) > 6))
  AND (regexp_matches(l, '(?i)^(?:article|section|clause|schedule|annex(?:ure)?|appendix|part|chapter|exhibit)(?:[^\p{L}\p{N}_]|$)')
    OR regexp_matches(l, '^(?:\d{1,3}(?:\.\d{1,3}){0,3}\.?|[IVXLC]{1,6}\.|\([a-z]\))\s+\S')
    OR (len(regexp_extract_all(l, '\p{L}')) >= 3 AND len(regexp_extract_all(l, '\p{L}')) = len(regexp_extract_all(l, '\p{Lu}')))), false)"""


@query(rf"""SELECT doc_id, CAST(line_no AS INT) AS line_no, l AS heading FROM (
  SELECT doc_id, line_no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS l FROM (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))
  WHERE {HEADING_SQL}""")
def heading_detect(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(X.is_heading(F.col("line"))).select("doc_id", "line_no", X.squeeze(F.col("line")).alias("heading"))


CLEAN_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"


@query(f"SELECT doc_id, length({CLEAN_SQL.format('text')}) AS n_clean, sha256({CLEAN_SQL.format('text')}) AS clean_sha256 FROM documents")
def clean_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.clean_text(F.col("text")).alias("c"))
    return docs.select("doc_id", F.length("c").cast("long").alias("n_clean"), F.sha2("c", 256).alias("clean_sha256"))


@query(f"""SELECT doc_id, 'Lines ' || (60 * b + 1) || '-' || least(60 * b + 60, n) AS location, CAST(length(trim(body, ' ' || chr(10))) AS INT) AS n_chars FROM (
  SELECT doc_id, b, max(n) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM (
    SELECT doc_id, len(p) AS n, unnest(range(len(p))) AS i, unnest(p) AS line, unnest(range(len(p))) // 60 AS b FROM (SELECT doc_id, string_split({CLEAN_SQL.format('text')}, chr(10)) AS p FROM documents)) GROUP BY doc_id, b)
  WHERE trim(body, ' ' || chr(10)) <> ''""")
def line_segments(spark, sf_dir):
    return _segmented(spark, sf_dir).select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.location", F.length("s.text").alias("n_chars"))


def _segmented(spark, sf_dir):
    """(doc_id, segments): each document's segments of 60 lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split(X.clean_text(F.col("text")), "\n").alias("p"))
    n = F.size("p")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 60).cast("int")), lambda b: F.struct(F.concat(F.lit("Lines "), (b * 60 + 1).cast("string"), F.lit("-"), F.least(b * 60 + 60, n).cast("string")).alias("location"), X.strip(F.array_join(F.slice("p", b * 60 + 1, 60), "\n")).alias("text")))
    return lines.select("doc_id", F.filter(blocks, lambda s: s["text"] != "").alias("segments"))


@query()
def chunk_segments(spark, sf_dir):
    chunks = chunk_documents(table(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "index", "section", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


SEGMENT_SQL = f"""
 sl AS (SELECT doc_id, len(p) AS n, unnest(range(len(p))) AS i, unnest(p) AS line, unnest(range(len(p))) // 60 AS b FROM (SELECT doc_id, string_split({CLEAN_SQL.format('text')}, chr(10)) AS p FROM documents)),
 seg AS (SELECT * FROM (SELECT doc_id, b, 'Lines ' || (60 * b + 1) || '-' || least(60 * b + 60, max(n)) AS location, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10)) AS body FROM sl GROUP BY doc_id, b) WHERE body <> '')"""
MARK_LIMIT, PREVIEW_LIMIT = 3000, 6000


@query(f"""WITH {SEGMENT_SQL}, k AS (SELECT doc_id, b, '[' || location || ']' || chr(10) || body AS block FROM seg), u AS (SELECT *, coalesce(sum(length(block) + 2) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM k),
 x AS (SELECT *, min(CASE WHEN used + length(block) > {MARK_LIMIT} THEN b END) OVER (PARTITION BY doc_id) AS cut FROM u),
 m AS (SELECT doc_id, string_agg(CASE WHEN cut IS NULL OR b < cut THEN block WHEN b = cut AND {MARK_LIMIT} - used > 200 THEN substr(block, 1, ({MARK_LIMIT} - used)::BIGINT) END, chr(10) || chr(10) ORDER BY b) AS text, bool_or(cut IS NOT NULL) AS truncated FROM x GROUP BY doc_id)
 SELECT doc_id, length(coalesce(m.text, '')) AS n_chars, sha256(coalesce(m.text, '')) AS text_sha256, coalesce(truncated, false) AS truncated FROM documents LEFT JOIN m USING (doc_id)""")
def marked_text_cut(spark, sf_dir):
    """Each document as a prompt shows it: segments with their places, up to a budget, the last one cut."""
    from lexquarry.functions import prompts as P

    shown = _segmented(spark, sf_dir).select("doc_id", P.marked_text(F.col("segments"), MARK_LIMIT).alias("m"))
    return shown.select("doc_id", F.length("m.text").cast("long").alias("n_chars"), F.sha2("m.text", 256).alias("text_sha256"), "m.truncated")


@query(f"""WITH {SEGMENT_SQL}, u AS (SELECT *, sum(length(body)) OVER (PARTITION BY doc_id ORDER BY b) AS upto FROM seg), p AS (SELECT doc_id, count(*) FILTER (upto <= {PREVIEW_LIMIT}) AS shown, count(*) AS n,
  string_agg(replace(replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;'), chr(10) ORDER BY b) FILTER (upto <= {PREVIEW_LIMIT}) AS html FROM u GROUP BY doc_id)
 SELECT doc_id, coalesce(shown, 0) AS shown, coalesce(shown < n, false) AS truncated, sha256(coalesce(html, '')) AS html_sha256 FROM documents LEFT JOIN p USING (doc_id)""")
def document_previews(spark, sf_dir):
    """The first whole segments of each document within a budget, escaped for a page."""
    from lexquarry.functions import prompts as P

    shown = _segmented(spark, sf_dir).select("doc_id", P.preview(F.col("segments"), PREVIEW_LIMIT).alias("p"))
    html = F.array_join(F.transform("p.segments", lambda s: P.escape_html(s["text"])), "\n")
    return shown.select("doc_id", F.size("p.segments").cast("long").alias("shown"), "p.truncated", F.sha2(html, 256).alias("html_sha256"))


@query("""SELECT s.source, l.lang, count(d.doc_id) AS n_docs, coalesce(sum(length(text)), 0)::BIGINT AS chars, CASE WHEN count(d.doc_id) = 0 THEN 'none' WHEN sum(length(text)) <= 40000 THEN 'full' ELSE 'retrieval' END AS mode, (350000 // greatest(count(d.doc_id), 1))::BIGINT AS budget
 FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT DISTINCT lang FROM documents UNION SELECT 'xx') l LEFT JOIN documents d ON d.source = s.source AND d.lang = l.lang GROUP BY ALL""")
def context_mode(spark, sf_dir):
    """How a library of one language goes into a prompt: whole, by retrieval, or not at all, where a source has nothing in it."""
    docs = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("chars"))
    langs = docs.agg(F.array_union(F.collect_set("lang"), F.array(F.lit("xx"))).alias("langs"))  # one row, a few languages
    libraries = docs.select("source").distinct().crossJoin(F.broadcast(langs)).select("source", F.explode("langs").alias("lang"))
    rows = libraries.join(docs, ["source", "lang"], "left").select("source", "lang", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("chars", F.lit(0)).alias("chars"))
    mode = F.when(F.col("n_docs") == 0, "none").when(F.col("chars") <= 40000, "full").otherwise("retrieval")
    return rows.withColumn("mode", mode).withColumn("budget", F.floor(350000 / F.greatest("n_docs", F.lit(1))))


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE source = 'src1'")
def doc_list_infos(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("source") == "src1").select("doc_id", "source", "lang", "n_chars").orderBy("doc_id")


@query("SELECT source, sha, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT source, doc_id, sha256(text) AS sha FROM documents) GROUP BY source, sha")
def dedupe_by_sha(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("sha"))
    return hashed.groupBy("source", "sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT source, count(*) AS n_docs, coalesce(sum(n_chars), 0)::BIGINT AS characters, count(DISTINCT lang) AS n_langs FROM documents GROUP BY source")
def library_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("characters"), F.countDistinct("lang").alias("n_langs"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def doc_scope_semijoin(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(wanted, "doc_id", "left_semi").select("doc_id", "source", "n_chars").orderBy("doc_id")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
 f AS (SELECT source, doc_id, i, (n_chars <= 30000) AS accepted, CASE WHEN n_chars <= 30000 THEN 1 ELSE 0 END AS n, CASE WHEN n_chars <= 30000 THEN n_chars ELSE 0 END AS chars, CASE WHEN n_chars > 30000 THEN 'library_full' END AS reason FROM o WHERE i = 1
  UNION ALL SELECT o.source, o.doc_id, o.i, f.n < 20 AND f.chars + o.n_chars <= 30000, f.n + CASE WHEN f.n < 20 AND f.chars + o.n_chars <= 30000 THEN 1 ELSE 0 END, f.chars + CASE WHEN f.n < 20 AND f.chars + o.n_chars <= 30000 THEN o.n_chars ELSE 0 END,
   CASE WHEN f.n >= 20 THEN 'too_many_documents' WHEN f.chars + o.n_chars > 30000 THEN 'library_full' END FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)
 SELECT source, doc_id, n_chars, accepted, reason FROM f JOIN documents USING (source, doc_id)""")
def capacity_admission(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    added = T.StructType([T.StructField("accepted", T.BooleanType()), T.StructField("reason", T.StringType())])
    return fold.ordered_fold(docs, "source", ["doc_id"], added, fold.admission(20, 30000, "n_chars"))


@query()
def html_to_text(spark, sf_dir):
    return html_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "html").select("page_id", "url", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("""WITH l AS (SELECT o_orderstatus AS sheet, concat_ws(' | ', o_orderkey::VARCHAR, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey::VARCHAR END, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END) AS line, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i FROM orders),
 k AS (SELECT *, (i - 1) // 50 AS b FROM (SELECT sheet, CASE WHEN i % 60 IN (0, 1) AND i > 40 THEN '' ELSE line END AS line, i FROM l) WHERE i <= 5000), h AS (SELECT sheet, arg_min(line, i) AS header FROM k WHERE line <> '' GROUP BY sheet)
 SELECT sheet, b, 'Sheet ' || chr(39) || sheet || chr(39) || ' rows ' || (50 * b + 1) || '-' || (50 * b + count(*)) AS location, count(*) FILTER (line <> '') AS n_rows,
  sha256(CASE WHEN b > 0 THEN '(Columns: ' || any_value(header) || ')' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY i) FILTER (line <> '')) AS text_sha256 FROM k JOIN h USING (sheet) GROUP BY sheet, b HAVING count(*) FILTER (line <> '') > 0""")
def row_segments(spark, sf_dir):
    """Spreadsheet rows as text segments of 50 rows each, the first 5,000 of a sheet, with the header told again in all but the
    first; some cells and rows are empty."""
    key = F.col("o_orderkey")
    line = F.concat_ws(" | ", key.cast("string"), F.when(key % 5 != 0, F.col("o_custkey").cast("string")), F.when(key % 7 != 0, F.col("o_orderpriority")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("sheet"), line.alias("line"), "o_orderkey")
    # Spark itself limits the rows of a window before the shuffle up to 1,000 only
    first = X.first_rows(rows, "sheet", "o_orderkey", 5000)
    placed = first.withColumn("i", F.row_number().over(Window.partitionBy("sheet").orderBy("o_orderkey"))).where(F.col("i") <= 5000)
    lines = placed.withColumn("line", F.when((F.col("i") % 60).isin(0, 1) & (F.col("i") > 40), "").otherwise(F.col("line")))
    return X.row_groups(lines, "sheet", "i", "line").select("sheet", "b", "location", "n_rows", F.sha2("text", 256).alias("text_sha256"))


@query(r"""SELECT doc_id, sha256(regexp_replace(text || '</Source> </sources></question>', '(?i)</(sources?|document|situation|question)', '&lt;/\1', 'g')) AS escaped_sha256, substr(translate(left(text, 200), '"' || chr(10), ''' '), 1, 160) AS attribute FROM documents""")
def escape_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(X.escape_tags(F.concat("text", F.lit("</Source> </sources></question>"))), 256).alias("escaped_sha256"), X.attribute(F.substring("text", 1, 200)).alias("attribute"))


@query("""SELECT source, risk, count(*) AS n, CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS place FROM (
  SELECT source, CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'low' END AS risk FROM documents JOIN labels USING (doc_id)) GROUP BY source, risk""")
def risk_rollup(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low").alias("risk"))
    place = F.when(F.col("risk") == "high", 0).when(F.col("risk") == "medium", 1).otherwise(2)
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id").groupBy("source", "risk").agg(F.count("*").alias("n")).withColumn("place", place)


@query("""SELECT source, lang, sha256('{"docs":"' || string_agg(sha, ',' ORDER BY block) || '","lang":"' || lang || '","task":"risks"}') AS cache_key, sum(n)::BIGINT AS n_docs FROM (
  SELECT source, lang, doc_id // 1000 AS block, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS sha, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source, lang""")
def analysis_cache_key(spark, sf_dir):
    """The key under which an analysis of a library's documents in one language is kept. Hashes of up to 1,000 neighbouring ids
    are hashed together first, so that a large library's key is made of few."""
    hashed = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.floor(F.col("doc_id") / 1000).alias("block"), F.sha2("text", 256).alias("sha"))

    def joined(ordered):
        return F.array_join(F.transform(F.array_sort(ordered), lambda x: x["sha"]), ",")

    blocks = hashed.groupBy("source", "lang", "block").agg(F.sha2(joined(F.collect_list(F.struct("doc_id", "sha"))), 256).alias("sha"), F.count("*").alias("n"))
    scope = blocks.groupBy("source", "lang").agg(joined(F.collect_list(F.struct("block", "sha"))).alias("docs"), F.sum("n").alias("n_docs"))
    return scope.select("source", "lang", F.sha2(F.concat(F.lit('{"docs":"'), "docs", F.lit('","lang":"'), "lang", F.lit('","task":"risks"}')), 256).alias("cache_key"), "n_docs")


@query("SELECT sha256(text) AS cache_key, max(doc_id) AS doc_id, arg_max(source, doc_id) AS payload FROM documents GROUP BY sha256(text)")
def analysis_upsert(spark, sf_dir):
    """The last write of each key stays."""
    writes = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("cache_key"), "doc_id", "source")
    return writes.groupBy("cache_key").agg(F.max("doc_id").alias("doc_id"), F.max_by("source", "doc_id").alias("payload"))


@query("SELECT l.doc_id, l.quality FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def cascade_delete(spark, sf_dir):
    """Children left after their parents in a scope are deleted."""
    gone = table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id")
    return table(spark, sf_dir, "labels").join(gone, "doc_id", "left_anti").select("doc_id", "quality")


@query("""SELECT 'duplicate_key' AS rule, count(*) AS n FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
 UNION ALL SELECT 'orphan', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
 UNION ALL SELECT 'role_check', count(*) FROM conversations WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT 'not_null', count(*) FROM documents WHERE text IS NULL OR source IS NULL""")
def constraint_violations(spark, sf_dir):
    docs, labels, said = (table(spark, sf_dir, t) for t in ("documents", "labels", "conversations"))
    rules = {
        "duplicate_key": docs.groupBy("doc_id").count().where("count > 1"),
        "orphan": labels.join(docs.select("doc_id"), "doc_id", "left_anti"),
        "role_check": said.where(~F.col("role").isin("user", "assistant")),
        "not_null": docs.where("text IS NULL OR source IS NULL"),
    }
    rows = [d.agg(F.count("*").alias("n")).select(F.lit(r).alias("rule"), "n") for r, d in rules.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(r"""WITH p AS (SELECT doc_id AS seq, source AS session, CASE WHEN trim(coalesce(n, '')) = '' THEN 'Pasted text' ELSE trim(n) END AS name, text FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN lang || '.md' WHEN 2 THEN lang END AS n FROM documents)),
 r AS (SELECT session, seq, CASE WHEN regexp_matches(lower(name), '\.(txt|md)$') THEN name ELSE name || '.txt' END AS name, sha256(text) AS sha, CASE WHEN length(text) < 200 THEN 'too_short' WHEN length(text) > 20000 THEN 'too_long' END AS refused FROM p),
 i AS (SELECT *, substr(sha256(session || '|' || seq || '|' || sha), 1, 16) AS doc_id FROM r), f AS (SELECT session, sha, arg_min(doc_id, seq) AS first_id FROM i WHERE refused IS NULL GROUP BY session, sha)
 SELECT session, seq, name, doc_id, refused, CASE WHEN refused IS NULL AND first_id <> doc_id THEN first_id END AS duplicate_of FROM i LEFT JOIN f USING (session, sha)""")
def pasted_texts(spark, sf_dir):
    """Documents as texts pasted into the sessions of their sources."""
    named = F.when(F.col("doc_id") % 4 == 0, " ").when(F.col("doc_id") % 4 == 1, F.concat("lang", F.lit(".md"))).when(F.col("doc_id") % 4 == 2, F.col("lang"))
    texts = table(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("seq"), named.alias("name"), "text")
    return store.pasted(texts, 200, 20000).select("session", "seq", "name", "doc_id", "refused", "duplicate_of")


@query(r"""WITH p AS (SELECT doc_id, lang, source, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS w FROM documents),
 k AS (SELECT *, w[1:3 + doc_id % 3] AS facts, CASE WHEN doc_id % 2 = 0 THEN w[5:6] ELSE [] END AS issues, array_to_string(w[7:9], ' ') AS question, array_to_string(w[10:11], ' ') AS why FROM p)
 SELECT doc_id, sha256('## Case summary' || chr(10) || chr(10) || source || chr(10) || chr(10) || '**Goal:** ' || coalesce(lang, '') || chr(10) || chr(10) || '## Timeline' || chr(10) || chr(10) || '- **' || doc_id || '**: ' || source || chr(10) || chr(10)
  || '## Key facts' || chr(10) || chr(10) || array_to_string(list_transform(facts, lambda x: '- ' || x), chr(10)) || chr(10) || chr(10)
  || CASE WHEN len(issues) > 0 THEN '## Legal issues' || chr(10) || chr(10) || array_to_string(list_transform(issues, lambda x: '- ' || x), chr(10)) || chr(10) ELSE '' END || chr(10)
  || '## Questions to ask' || chr(10) || chr(10) || '1. **' || question || '** (' || why || ')' || chr(10) || '2. **why?** ()' || chr(10) || chr(10) || chr(10)) AS report_sha256 FROM k""")
def brief_reports(spark, sf_dir):
    """A brief for each document, made of its words, as Markdown with its empty sections left out."""
    from lexquarry.functions import reports

    w = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    empty = F.array().cast("array<string>")
    asked = F.array(F.struct(F.array_join(F.slice(w, 7, 3), " ").alias("question"), F.array_join(F.slice(w, 10, 2), " ").alias("why")), F.struct(F.lit("why?").alias("question"), F.lit(None).cast("string").alias("why")))
    result = F.struct(
        F.col("source").alias("case_summary"), F.col("lang").alias("goal"), F.array(F.struct(F.col("doc_id").alias("date"), F.col("source").alias("event"))).alias("timeline"), F.slice(w, F.lit(1), (F.col("doc_id") % 3 + 3).cast("int")).alias("key_facts"),
        F.when(F.col("doc_id") % 2 == 0, F.slice(w, 5, 2)).otherwise(empty).alias("legal_issues"), asked.alias("questions_to_ask"), empty.alias("documents_to_bring"), empty.alias("open_points"),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", result.alias("r"))
    return rows.select("doc_id", F.sha2(reports.report("lawyer_brief", F.col("r")), 256).alias("report_sha256"))
