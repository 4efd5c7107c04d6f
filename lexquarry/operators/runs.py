"""Analyses of documents as a batch: what is cached is not asked again, replies are written before they are used.

A request names an analysis, documents in order and options. Requests of one meaning have one key, whoever sends them, and a key
is asked once. A model is any object with `generate_json`, made once in each task by a function that Spark can send.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.functions import prompts as P
from lexquarry.functions.text import strip
from lexquarry.operators import analysis

#: The fields of each analysis' result.
SCHEMAS = {
    "simplify": "document_type string, one_line_summary string, parties array<struct<name string, role string>>, plain_summary string, key_points array<struct<point string, quote string, location string>>, sections array<struct<heading string, explanation string, location string>>, terms_explained array<struct<term string, meaning string>>",
    "risks": "overall_risk string, risk_score int, verdict string, favours string, clauses array<struct<category string, title string, risk string, explanation string, quote string, location string, suggestion string>>, obligations array<struct<party string, obligation string, deadline string, quote string>>, key_dates array<struct<date string, event string, quote string>>, red_flags array<struct<issue string, why_it_matters string, quote string>>, inconsistencies array<struct<issue string, quote string, conflicting_quote string>>, missing_clauses array<struct<clause string, why_it_matters string>>",
    "compare": "summary string, better_for_user string, reason string, differences array<struct<topic string, doc_a string, doc_b string, quote_a string, quote_b string, impact string, favours string, severity string>>, only_in_a array<struct<clause string, quote string, impact string>>, only_in_b array<struct<clause string, quote string, impact string>>, negotiation_points array<string>",
    "action_plan": "situation_summary string, legal_position string, legal_basis array<struct<law string, relevance string>>, options array<struct<option string, pros array<string>, cons array<string>, effort string, best_when string>>, checklist array<struct<task string, why string, deadline string, priority string, quote string>>, deadlines array<struct<date string, what string, consequence string, quote string>>, documents_to_gather array<string>",
    "lawyer_brief": "case_summary string, goal string, timeline array<struct<date string, event string, quote string>>, key_facts array<string>, legal_issues array<string>, questions_to_ask array<struct<question string, why string>>, documents_to_bring array<string>, open_points array<string>",
}
#: Fixed value: the characters that the documents of a request share.
BUDGET = 350_000

REQUEST = "request_id string, name string, doc_ids array<string>, situation string, options string"
CACHED = "cache_key string, result string, verified long, partial long, unverified long, truncated boolean"
REPLY = "cache_key string, name string, truncated boolean, reply string"


class ModelClient(Protocol):
    """What answers prompts: one JSON text each, null or anything else where it fails."""

    def generate_json(self, name: str, prompts: list[str]) -> list[str | None]: ...


def parsed(name: Column, reply: Column) -> Column:
    """Whether a reply is an object of its analysis' shape, with every field of the first level there."""
    ok = F.lit(False)
    for kind, ddl in SCHEMAS.items():
        value = F.from_json(reply, ddl, {"mode": "PERMISSIVE"})
        fields = [f.name for f in T._parse_datatype_string(ddl)]
        whole = F.lit(True)
        for f in fields:
            whole = whole & value[f].isNotNull()
        ok = F.when(name == kind, F.coalesce(whole, F.lit(False))).otherwise(ok)
    return ok


def accepted(requests: DataFrame) -> DataFrame:
    """requests with refused, a reason or null: an unknown analysis, fewer or more documents than it takes (no two of them alike
    to compare), or neither documents nor a situation."""
    n, blank = F.size(F.coalesce("doc_ids", F.array().cast("array<string>"))), strip(F.coalesce("situation", F.lit(""))) == ""
    one, two = F.col("name").isin("simplify", "risks"), F.col("name") == "compare"
    reason = (
        F.when(~F.coalesce(F.col("name").isin(*SCHEMAS), F.lit(False)), "unknown_analysis").when(n > 20, "too_many_documents").when(one & (n != 1), "one_document")
        .when(two & ((n != 2) | (F.size(F.array_distinct("doc_ids")) != 2)), "two_documents").when(~one & ~two & (n == 0) & blank, "nothing_given")
    )
    return requests.withColumn("refused", reason)


def keyed(requests: DataFrame, documents: DataFrame, model: str) -> DataFrame:
    """requests with cache_key and docs: their documents (no, doc_id, doc_name, sha) in order. A document that is not there makes
    a request refused."""
    held = requests.select("request_id", F.posexplode("doc_ids").alias("no", "doc_id")).join(documents.select("doc_id", F.col("name").alias("doc_name"), "sha"), "doc_id")
    docs = held.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("no", "doc_id", "doc_name", "sha"))).alias("docs"))
    rows = requests.join(docs, "request_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<struct<no:int,doc_id:string,doc_name:string,sha:string>>")))
    missing = F.size("docs") < F.size(F.coalesce("doc_ids", F.array().cast("array<string>")))
    rows = rows.withColumn("refused", F.coalesce("refused", F.when(missing, "unknown_document")))
    told = {"docs": F.transform("docs", lambda d: d["sha"]), "model": F.lit(model), "name": F.col("name"), "options": F.coalesce("options", F.lit("")), "situation": strip(F.coalesce("situation", F.lit("")))}
    return rows.withColumn("cache_key", F.when(F.col("refused").isNull(), F.sha2(F.to_json(F.struct(*[told[k].alias(k) for k in sorted(told)])), 256)))


def prompted(wanted: DataFrame, documents: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(cache_key, name, truncated, prompt) of keyed requests: their documents, marked with places and cut to their share of the
    budget, labelled A and B if they are compared, else 1, 2, ..."""
    share = F.floor(F.lit(budget) / F.greatest(F.size("docs"), F.lit(1))).cast("int")
    each = wanted.select("cache_key", "name", "situation", share.alias("share"), F.explode_outer("docs").alias("d")).select("*", "d.no", "d.doc_id", "d.doc_name")
    cut = P.marked_text(F.col("segments"), F.col("share"))
    label = F.when(F.col("name") == "compare", F.element_at(F.array(F.lit("A"), F.lit("B")), F.col("no") + 1)).otherwise((F.col("no") + 1).cast("string"))
    texts = each.join(documents.select("doc_id", "segments"), "doc_id", "left").withColumn("cut", F.when(F.col("segments").isNotNull(), cut))
    block = F.when(F.col("segments").isNotNull(), F.struct("no", P.document_block(label, F.col("doc_name"), F.col("cut.text")).alias("block")))
    wrapped = texts.groupBy("cache_key", "name", "situation").agg(F.array_sort(F.collect_list(block)).alias("blocks"), F.coalesce(F.bool_or("cut.truncated"), F.lit(False)).alias("truncated"))
    prompt = P.analysis_prompt(F.col("name"), F.col("situation"), F.transform("blocks", lambda b: b["block"]))
    return wrapped.select("cache_key", "name", "truncated", prompt.alias("prompt"))


def asked(prompts: DataFrame, start: Callable[[], ModelClient]) -> DataFrame:
    """(cache_key, name, truncated, reply): prompts answered in the batches in which they come, by one client for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = start()
        for batch in batches:
            names, texts, replies = batch.column(1).to_pylist(), batch.column(3).to_pylist(), [None] * batch.num_rows
            for name in sorted(set(names)):
                own = [i for i, n in enumerate(names) if n == name]
                for i, reply in zip(own, client.generate_json(name, [texts[i] for i in own])):
                    replies[i] = reply
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(replies, pa.string())], names=["cache_key", "name", "truncated", "reply"])

    return prompts.select("cache_key", "name", "truncated", "prompt").mapInArrow(run, REPLY)


def verified(replies: DataFrame, wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the cache from replies of the right shape: quotes marked, those of a comparison against their own side alone."""
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "\n")
    held = wanted.select("cache_key", F.explode("docs").alias("d")).select("cache_key", F.col("d.no").alias("source_id"), F.col("d.doc_id").alias("doc_id"))
    sources = held.join(documents.select("doc_id", text.alias("text")), "doc_id").select("cache_key", "source_id", "text", F.when(F.col("source_id") == 0, "a").otherwise("b").alias("side"))
    good = replies.where(parsed(F.col("name"), F.col("reply")))
    parts = [(good.where("name = 'compare'"), analysis.COMPARED), (good.where("name <> 'compare'"), analysis.QUOTES)]
    rows = None
    for part, rules in parts:
        one = analysis.annotated(part, sources, "cache_key", "reply", rules).join(part.select("cache_key", "truncated"), "cache_key")
        rows = one if rows is None else rows.unionByName(one)
    return rows.select([f.name for f in T._parse_datatype_string(CACHED)])


@dataclass
class AnalysisSink:
    """For foreachBatch: answers batches of requests, with a cache of results below `path` in a folder that all executors share.

    `replies`, `cache` and `answers` have a folder for each batch. A batch that comes again reads the replies that it wrote and
    writes the same results over its own; it does not see its own cache. documents: (doc_id, name, sha, segments).
    """

    path: str
    documents: DataFrame
    start: Callable[[], ModelClient]
    model: str = "model"
    budget: int = BUDGET

    def read(self, spark: SparkSession, part: str, schema: str) -> DataFrame:
        try:
            found = spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}")
            found.limit(0).collect()
            return found
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], f"{schema}, batch long")

    def __call__(self, requests: DataFrame, batch: int) -> None:
        spark = requests.sparkSession
        rows = keyed(accepted(requests), self.documents, self.model)
        cache = self.read(spark, "cache", CACHED).where(F.col("batch") != batch).drop("batch")
        first = Window.partitionBy("cache_key").orderBy("request_id")
        wanted = rows.where("cache_key IS NOT NULL").join(cache.select("cache_key"), "cache_key", "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        known = self.read(spark, "replies", REPLY).where(F.col("batch") == batch).drop("batch")
        if known.isEmpty():
            asked(prompted(wanted, self.documents, self.budget), self.start).write.mode("overwrite").parquet(f"{self.path}/replies/batch={batch}")
        replies = self.read(spark, "replies", REPLY).where(F.col("batch") == batch).drop("batch")
        verified(replies, wanted, self.documents).write.mode("overwrite").parquet(f"{self.path}/cache/batch={batch}")
        new = self.read(spark, "cache", CACHED).where(F.col("batch") == batch).drop("batch")
        relabelled(rows, cache.withColumn("cached", F.lit(True)).unionByName(new.withColumn("cached", F.lit(False)))).write.mode("overwrite").parquet(f"{self.path}/answers/batch={batch}")


def relabelled(rows: DataFrame, results: DataFrame) -> DataFrame:
    """(request_id, status, cached, result, verified, partial, unverified, truncated, documents): each request with the result of
    its key and the ids and names that its own documents have now. status: ok, failed (no fit reply), or why it was refused."""
    found = rows.join(results, "cache_key", "left")
    documents = F.transform("docs", lambda d: F.struct(d["doc_id"].alias("id"), d["doc_name"].alias("name")))
    status = F.coalesce("refused", F.when(F.col("result").isNull(), "failed"), F.lit("ok"))
    return found.select("request_id", status.alias("status"), F.coalesce("cached", F.lit(False)).alias("cached"), "result", *analysis.COUNTED, "truncated", documents.alias("documents"))
