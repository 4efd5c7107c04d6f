"""A model's streamed replies as rows: the text, searches and web sources of each chunk, and the answers that they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions.prompts import web_sources

#: Fixed value: the part of a chunk that is read.
CHUNK = "candidates array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>,grounding_metadata:struct<web_search_queries:array<string>,grounding_chunks:array<struct<web:struct<uri:string,title:string,domain:string>>>>>>"


def _none(value: Column, kind: str) -> Column:
    return F.coalesce(value, F.array().cast(f"array<{kind}>"))


def extracted(chunks: DataFrame, chunk: str = "chunk") -> DataFrame:
    """chunks with text (thoughts left out), queries and sources (uri, title, domain; those without an address left out) in the place
    of the chunk's JSON. What is no JSON of that shape has an empty text and none of the others."""
    candidates = F.filter(_none(F.from_json(chunk, CHUNK)["candidates"], CHUNK.removeprefix("candidates array<").removesuffix(">")), lambda c: c.isNotNull())
    part = "struct<text:string,thought:boolean>"
    said = F.flatten(F.transform(candidates, lambda c: F.transform(F.filter(_none(c["content"]["parts"], part), lambda p: ~F.coalesce(p["thought"], F.lit(False))), lambda p: F.coalesce(p["text"], F.lit("")))))
    asked = F.flatten(F.transform(candidates, lambda c: F.filter(_none(c["grounding_metadata"]["web_search_queries"], "string"), lambda q: q.isNotNull())))
    web = F.flatten(F.transform(candidates, lambda c: F.transform(_none(c["grounding_metadata"]["grounding_chunks"], "struct<web:struct<uri:string,title:string,domain:string>>"), lambda g: g["web"])))
    rest = [c for c in chunks.columns if c != chunk]
    return chunks.select(*rest, F.array_join(said, "").alias("text"), asked.alias("queries"), F.filter(web, lambda w: F.coalesce(w["uri"], F.lit("")) != "").alias("sources"))


def answers(chunks: DataFrame, most_sources: int = 8, most_queries: int = 5) -> DataFrame:
    """(answer_id, answer, web_sources, search_queries) from chunks (answer_id, seq, chunk): the texts in order, the first distinct
    addresses with their titles, and the first distinct searches."""
    read = extracted(chunks)
    texts = read.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"]), "").alias("answer"))
    cited = read.select("answer_id", "seq", F.posexplode("sources").alias("pos", "s")).select("answer_id", F.struct("seq", "pos").alias("place"), "s.uri", "s.title", "s.domain")
    ranked = web_sources(cited, "answer_id", "place", most_sources)
    sources = ranked.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "uri", "title"))), lambda s: F.struct(s["title"].alias("title"), s["uri"].alias("uri"))).alias("web_sources"))
    asked = read.select("answer_id", "seq", F.posexplode("queries").alias("pos", "query")).groupBy("answer_id", "query").agg(F.min(F.struct("seq", "pos")).alias("place"))
    n = F.row_number().over(Window.partitionBy("answer_id").orderBy("place"))
    first = asked.withColumn("n", n).where(F.col("n") <= most_queries).groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "query"))), lambda q: q["query"]).alias("search_queries"))
    joined = texts.join(sources, "answer_id", "left").join(first, "answer_id", "left")
    return joined.select("answer_id", "answer", _none(F.col("web_sources"), "struct<title:string,uri:string>").alias("web_sources"), _none(F.col("search_queries"), "string").alias("search_queries"))
