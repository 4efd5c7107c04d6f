"""Structured analyses: results checked against their sources, cached by content, rendered as Markdown."""

from __future__ import annotations

from json import dumps, loads

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.operators import grounding as G
from lexquarry.operators.kept import stored

#: The part of a risk report that its queries use.
RISK_REPORT = "overall_risk string, risk_score int, verdict string, clauses array<struct<category string, title string, risk string, quote string, location string>>, red_flags array<struct<issue string, quote string>>"


def parsed(reports: DataFrame, column: str = "report", schema: str = RISK_REPORT) -> DataFrame:
    """reports with the JSON column as a struct, and valid (false where it is no JSON of that shape)."""
    return reports.withColumn("parsed", F.from_json(column, schema)).withColumn("valid", F.col("parsed").isNotNull() & F.col("parsed.verdict").isNotNull())


def score_fits(score: Column, label: Column) -> Column:
    """Whether a score between 0 and 100 lies in its label's third."""
    return F.when(score < 34, label == "low").when(score < 67, label == "medium").otherwise(label == "high")


#: Rules (first key or None for any, field, side): which fields of a result are quotes, and which side's sources they must be in.
ANY_SIDE = "all"
QUOTES = [(None, "quote", ANY_SIDE), (None, "conflicting_quote", ANY_SIDE)]
COMPARED = [("differences", "quote_a", "a"), ("differences", "quote_b", "b"), ("only_in_a", "quote", "a"), ("only_in_b", "quote", "b")]


def nesting(results: DataFrame, json: str) -> int:
    """How deep the values of a JSON column lie at most: the most brackets open at once, outside of strings."""
    brackets = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda sign: F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0)
    deep = F.aggregate(F.split(brackets, ""), start, lambda a, s: F.struct((a["now"] + step(s)).alias("now"), F.greatest(a["most"], a["now"] + step(s)).alias("most")))
    return results.where(F.try_parse_json(json).isNotNull()).select(F.max(deep["most"])).first()[0] or 0


def leaves(results: DataFrame, id: str, json: str, depth: int | None = None) -> DataFrame:
    """(id, path, value): every value of the JSON column that holds no others, as VARIANT, with its path: an array of structs
    (key, pos), key being null in arrays. Text that is no JSON has none.

    Each step opens what still holds values, in place, so the plan is one chain of `depth` steps (found from the column, if it
    is not given) without a shuffle.
    """
    spark = results.sparkSession
    rows = results.select(id, F.array().cast("array<struct<key:string,pos:int>>").alias("path"), F.try_parse_json(json).alias("value")).where("value IS NOT NULL")
    for _ in range(nesting(results, json) if depth is None else depth):
        opened = spark.tvf.variant_explode_outer(F.when(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)<"), F.col("value")).outer())
        step = rows.lateralJoin(opened.select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value")))
        rows = step.select(id, F.when(F.col("_pos").isNull(), F.col("path")).otherwise(F.array_append("path", F.struct(F.col("_key").alias("key"), F.col("_pos").alias("pos")))).alias("path"), F.coalesce("_value", "value").alias("value"))
    return rows


def quotes_of(results: DataFrame, id: str, json: str, rules: list[tuple] = QUOTES, depth: int | None = None) -> DataFrame:
    """(id, path, side, quote): the strings of results that are quotes by the rules, wherever they lie."""
    field = F.try_element_at("path", F.lit(-1))["key"]
    side = F.coalesce(*[F.when((field == name) & (F.lit(True) if top is None else F.get("path", F.lit(0))["key"] == top), of) for top, name, of in rules])
    found = leaves(results, id, json, depth).where(F.size("path") > 0).withColumn("side", side).where("side IS NOT NULL")
    return found.where(F.schema_of_variant("value") == "STRING").select(id, "path", "side", F.try_variant_get("value", "$", "string").alias("quote"))


@F.arrow_udf(T.StringType())
def _with_statuses(texts: pa.Array, paths: pa.Array, statuses: pa.Array) -> pa.Array:
    """Each JSON text with <field>_status beside the field at each path."""
    out = []
    for text, places, found in zip(texts.to_pylist(), paths.to_pylist(), statuses.to_pylist()):
        whole = loads(text) if text is not None else None
        for path, status in zip(places or [], found or []):
            node = whole
            for step in path[:-1]:
                node = node[step["pos"]] if step["key"] is None else node[step["key"]]
            node[f"{path[-1]['key']}_status"] = status
        out.append(None if whole is None else dumps(whole, ensure_ascii=False))
    return pa.array(out, pa.string())


COUNTED = ["verified", "partial", "unverified"]


def annotated(results: DataFrame, sources: DataFrame, id: str, json: str, rules: list[tuple] = QUOTES, depth: int | None = None) -> DataFrame:
    """(id, result, verified, partial, unverified): each JSON result with the status of every quote beside it, and their counts.

    sources: (id, source_id, text[, side]) are those of each result. A blank quote has status none and is not counted; a field of
    a quote's name that holds no string is looked into as any other. A text that is no JSON has no result and zeros. Results and
    their quotes are each made once and kept in the shared folder, as several steps read them.
    """
    results = stored(results.select(id, json))
    held = sources if "side" in sources.columns else sources.withColumn("side", F.lit(ANY_SIDE))
    held = held.select(id, "source_id", "text", F.explode(F.array_distinct(F.array("side", F.lit(ANY_SIDE)))).alias("side"))
    quotes = stored(quotes_of(results, id, json, rules, depth).withColumnRenamed("path", "quote_id"))
    checked = G.check_elided(quotes, held, [id, "side"]).groupBy(id).agg(
        F.collect_list("quote_id").alias("paths"), F.collect_list("status").alias("statuses"), *[F.count_if(F.col("status") == s).alias(s) for s in COUNTED]
    )
    rows = results.select(id, F.col(json).alias("_json")).join(checked, id, "left")
    text = F.when(F.try_parse_json("_json").isNotNull(), F.col("_json"))
    return rows.select(id, _with_statuses(text, F.col("paths"), F.col("statuses")).alias("result"), *[F.coalesce(s, F.lit(0)).alias(s) for s in COUNTED])


def cache_key(task: str, model: str, hashes: Column, **options: str) -> Column:
    """sha256 of what decides an analysis, as JSON with its keys in order."""
    named = {"docs": hashes, "model": F.lit(model), "task": F.lit(task)} | {k: F.lit(v) for k, v in options.items()}
    return F.sha2(F.to_json(F.struct(*[named[k].alias(k) for k in sorted(named)])), 256)


def misses(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """What is wanted and not cached: only this goes to a model."""
    return wanted.join(cache.select(key), key, "left_anti")


def upsert(cache: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The last write of each key; equal times go to the new rows."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rows = F.struct(*[c for c in cache.columns])
    return both.groupBy(key).agg(F.max_by(rows, F.struct(at, "_new")).alias("r")).select("r.*")
