"""Filter interaction audit: what each of five filters takes out after any others, for every order of the five.

A set of filters is a bit mask. After the filters of a set, the next one is an edge of the lattice of sets: five filters
have 80 edges, and each of the 120 orders is a path over five of them. Documents are counted on edges, once; the 600 steps
of the orders look their edge up.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
BITS = {letter: 1 << i for i, letter in enumerate(LETTERS)}
#: ASCII blanks part words.
WORD = r"[^\x20\x09-\x0D]+"
NUMBERS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def own_failures(text: Column) -> Column:
    """The mask of the four filters that look at one text: A short, B repetitive, C capitals, D signs."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    short, signs = F.lit(50), F.lit("[#$%&*|]")
    fails = {
        "A": F.size(words) < short,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": F.regexp_like(text, signs),
    }
    mask = F.lit(0)
    for letter, failed in fails.items():
        mask = mask + F.when(failed, BITS[letter]).otherwise(0)
    return mask


def judged(docs: DataFrame, labels: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """(part, fails, n, good, toxic): how many documents of a part fail which filters, and how many of them have a label.

    Texts are known by their SHA-256 from here on. Copies of one text in one part become one row before they meet the text's
    smallest id, and rows without an id are spread by their texts, so neither a text nor an id that many rows have is one task's work.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("sha"), own_failures(body).alias("own"))
    rows = rows.groupBy("_id", "sha", "part", "own").agg(F.count("*").alias("n"))
    marks = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("_label")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    salt = F.when(F.col("_id").isNull(), F.xxhash64("sha")).otherwise(0)  # rows without an id meet no label, each where its text lies
    marks = marks.withColumn("_salt", F.lit(0).cast("long"))
    named = rows.withColumn("salt", salt).join(marks, (F.col("_id") == F.col("_label")) & (F.col("salt") == F.col("_salt")), "left")
    named = named.select("_id", "sha", "part", "own", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    # of the rows of one text that are alike: how many, how many have an id, and the smallest id with its number of rows
    first = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n")))
    alike = named.groupBy("sha", "part", "own", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_id").isNotNull(), F.col("n")).otherwise(0)).alias("with_id"), first.alias("first"))
    alike = alike.withColumn("least", F.min("first._id").over(Window.partitionBy("sha")))  # a text has a few rows for each part here
    copies = F.when(F.col("first._id") == F.col("least"), F.col("with_id") - F.col("first.n")).otherwise(F.col("with_id"))
    sides = F.array(F.struct(F.lit(BITS["E"]).alias("e"), copies.alias("n")), F.struct(F.lit(0).alias("e"), (F.col("n") - copies).alias("n")))
    told = alike.select("part", "own", "good", "toxic", F.explode(sides).alias("s")).where("s.n > 0")
    n = F.col("s.n")
    return told.groupBy("part", (F.col("own") + F.col("s.e")).alias("fails")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def edges(counts: DataFrame) -> DataFrame:
    """(part, applied, next, kept, removed, redundant, unique_fails, good_lost, toxic_lost): all 80 edges of every part."""
    lattice = F.array(*[F.struct(F.lit(applied).alias("applied"), F.lit(bit).alias("next")) for applied in range(32) for bit in BITS.values() if not applied & bit])
    passed = F.col("fails").bitwiseAND(F.col("applied")) == 0
    failed = F.col("fails").bitwiseAND(F.col("next")) != 0

    def total(which: Column, of: str = "n") -> Column:
        return F.sum(F.when(which, F.col(of)).otherwise(0))

    met = counts.withColumn("edge", F.explode(lattice)).select("*", "edge.applied", "edge.next")  # a part has at most 32 rows here
    return met.groupBy("part", "applied", "next").agg(
        total(passed & ~failed).alias("kept"), total(passed & failed).alias("removed"), total(~passed & failed).alias("redundant"),
        total(F.col("fails") == F.col("next")).alias("unique_fails"), total(passed & failed, "good").alias("good_lost"), total(passed & failed, "toxic").alias("toxic_lost"),
    )


def steps(spark) -> DataFrame:
    """(filter_order, step, applied, next): the 600 steps of the 120 orders."""
    rows = []
    for order in permutations(LETTERS):
        applied = 0
        for i, letter in enumerate(order):
            rows.append(("".join(order), i + 1, applied, BITS[letter]))
            applied |= BITS[letter]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    Null texts are empty (and copies of one another), null parts are the empty string. A row is a copy if a row with a smaller
    id has its text anywhere in the table; rows of one id are not copies of each other, and rows without an id are never
    copies nor make others so. Several labels of one id count if any says so. shapley is removed, summed over all orders.
    An empty table has no parts and gives no rows; other columns, whatever their names, are not read.
    """
    found = edges(judged(docs, labels, id, text, part))
    size = F.bit_count("applied").cast("int")
    # an edge lies on as many orders as its set has orders before it and the rest has after it
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(LETTERS) - 1 - k)) for k in range(len(LETTERS))]), size + 1)
    valued = found.withColumn("shapley", F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "next")))
    return valued.join(F.broadcast(steps(docs.sparkSession)), ["applied", "next"]).select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in NUMBERS])


def oracle() -> str:
    """The same for DuckDB, step by step over the documents of each order rather than over the lattice."""
    pick = " ".join(f"WHEN '{letter}' THEN {bit}" for letter, bit in BITS.items())
    return rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
 w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d), l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS fails FROM w),
 c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 s AS (SELECT filter_order, step, CASE filter_order[step] {pick} END AS bit, list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda y: CASE y {pick} ELSE 0 END))::INT AS applied FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
 r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (fails & applied = 0 AND fails & bit = 0) AS kept, sum(n) FILTER (fails & applied = 0 AND fails & bit > 0) AS removed, sum(n) FILTER (fails & applied > 0 AND fails & bit > 0) AS redundant,
  sum(n) FILTER (fails = bit) AS unique_fails, sum(good) FILTER (fails & applied = 0 AND fails & bit > 0) AS good_lost, sum(toxic) FILTER (fails & applied = 0 AND fails & bit > 0) AS toxic_lost FROM c, s GROUP BY ALL)
 SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r"""
