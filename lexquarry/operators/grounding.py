"""Grounding: quotes and citations checked against source texts with joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as X
from lexquarry.operators.kept import stored

VERIFIED, PARTIAL = 0.9, 0.6


def _hash(words: Column, i: Column, n: int) -> Column:
    """Of the n words from place i on; those that are not there count for nothing."""
    return F.xxhash64(*[F.get(words, i + k) for k in range(n)])


def _runs(words: Column, sizes: tuple[int, ...], wanted: Column | None = None) -> Column:
    """Structs (i, gram): every run of so many neighbouring words with the place of its first, or only those whose hash is wanted."""

    def of(n: int) -> Column:
        run = lambda i: F.struct(i.alias("i"), F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]).alias("gram"))
        places = F.sequence(F.lit(0), F.size(words) - n)
        if wanted is not None:  # most runs go before they are made
            places = F.filter(places, lambda i: F.array_contains(wanted, _hash(words, i, n)))
        return F.when(F.size(words) >= n, F.transform(places, run)).otherwise(F.array().cast("array<struct<i:int,gram:string>>"))

    return F.flatten(F.array(*map(of, sizes)))


def found(quotes: DataFrame, sources: DataFrame, scope: list[str] = []) -> DataFrame:
    """(*scope, quote_id, source_id, exact, coverage): the sources that share a run of three words with a quote (or hold one of
    fewer words), whether they hold its words in a row, and which share of its distinct runs they hold.

    Quotes (quote_id, quote) meet sources (source_id, text) of the same scope only. Sources are read once: runs that no quote
    has go before runs are shuffled, the others meet quotes by equality, and a quote is held in a row where all its runs are
    at places that differ from theirs by one number. Work grows with the shared runs, not with the pairs. With a scope, quotes
    of one key have a number, and their runs too, so what is grouped by quote and source holds numbers, no ids or texts.
    """
    w, key = F.col("w"), [*scope, "quote_id", "places", "total"]
    runs_of = lambda w: F.when(F.size(w) >= 3, _runs(w, (3,))).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.array_join(w, " ").alias("gram"))))
    asked = quotes.select(*scope, "quote_id", X.normal_words(X.nfkc(F.col("quote"))).alias("w")).where(F.size(w) > 0).withColumn("runs", runs_of(w))
    distinct = F.size(F.array_distinct(F.transform("runs", lambda r: r["gram"])))
    asked = asked.select(*scope, "quote_id", "w", F.size("runs").alias("places"), distinct.alias("total"), "runs")
    if scope:  # every scope has quotes of its own, so they may be as many as the sources
        alike = asked.groupBy(*key).agg(F.collect_list("w").alias("ws"))
        numbered = stored(alike.select(*key, F.monotonically_increasing_id().alias("_number"), F.exists("ws", lambda w: F.size(w) < 3).alias("short"), F.flatten(F.transform("ws", runs_of)).alias("runs")))
        of_quote = F.transform("runs", lambda r: F.struct(r["i"], r["gram"], F.array_position(F.col("runs")["gram"], r["gram"]).cast("int")))
        asked = numbered.select(*scope, "_number", "short", F.inline(of_quote).alias("i", "gram", "_run"))
    else:
        short = asked.agg(F.bool_or(F.size("w") < 3).alias("short"))  # one row
        asked = asked.select(*key, F.inline("runs").alias("i", "gram"))
    words = X.normal_words(X.nfkc(F.col("text"))).alias("w")
    if scope:  # a source meets the few runs of its scope in its own row, so texts are shuffled, not their runs
        wanted = asked.groupBy(*scope).agg(F.collect_set(_hash(F.split("gram", " "), F.lit(0), 3)).alias("wanted"), F.bool_or("short").alias("short"))
        rows = sources.join(wanted, scope).select(*scope, "source_id", "wanted", "short", words)
        runs = F.when(F.col("short"), _runs(w, (1, 2, 3), F.col("wanted"))).otherwise(_runs(w, (3,), F.col("wanted")))
        held = rows.select(*scope, "source_id", F.inline(runs).alias("at", "gram"))
    else:
        rows = sources.select("source_id", words).crossJoin(F.broadcast(short))  # runs of one and two words are made if a quote is as short
        runs = F.when(F.col("short"), _runs(w, (1, 2, 3))).otherwise(_runs(w, (3,)))
        held = rows.select("source_id", F.inline(runs).alias("at", "gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    pair, run = (["_number", "source_id"], "_run") if scope else ([*key, "source_id"], "gram")
    shifted = asked.join(held, [*scope, "gram"]).groupBy(*pair, (F.col("at") - F.col("i")).alias("shift")).agg(F.count("*").alias("n"), F.collect_set(run).alias("held"))
    met = shifted.groupBy(*pair).agg(F.max("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("shared"))
    if scope:
        met = met.join(numbered.select("_number", *key), "_number")
    return met.select(*scope, "quote_id", "source_id", (F.col("n") == F.col("places")).alias("exact"), (F.col("shared") / F.col("total")).alias("coverage"))


def exact(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(quote_id, source_id): the first source that holds a quote's words in a row."""
    return found(quotes, sources).where("exact").groupBy("quote_id").agg(F.min("source_id").alias("source_id"))


def coverage(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(quote_id, source_id, coverage): for each quote of three words or more the source that holds the largest share of its
    distinct three-word runs, the first of equals. Quotes that share none are missing."""
    long = quotes.where(F.size(X.normal_words(X.nfkc(F.col("quote")))) >= 3)
    best = F.min(F.struct((-F.col("coverage")).alias("c"), "source_id")).alias("m")
    return found(long, sources).groupBy("quote_id").agg(best).select("quote_id", "m.source_id", (-F.col("m.c")).alias("coverage"))


def status(share: Column) -> Column:
    return F.when(share >= VERIFIED, "verified").when(share >= PARTIAL, "partial").otherwise("unverified")


def check(quotes: DataFrame, sources: DataFrame, scope: list[str] = []) -> DataFrame:
    """(*scope, quote_id, status, coverage, source_id) for each row of quotes (quote_id, quote) against the sources (source_id,
    text) of its scope. The source is the first that holds the quote in a row, else the first of those with the best share."""
    best = F.min(F.struct((~F.col("exact")).alias("apart"), (-F.col("coverage")).alias("c"), "source_id")).alias("m")
    met = found(quotes, sources, scope).groupBy(*scope, "quote_id").agg(best)
    share = F.when(~F.col("m.apart"), 1.0).otherwise(F.coalesce(-F.col("m.c"), F.lit(0.0)))
    empty = F.col("_empty")
    rows = quotes.select(*scope, "quote_id", (F.size(X.normal_words(F.col("quote"))) == 0).alias("_empty"))
    out = rows.join(met, [*scope, "quote_id"], "left").withColumn("share", share).withColumn("status", F.when(empty, "none").otherwise(status(F.col("share"))))
    named = F.when(F.col("status").isin("verified", "partial"), F.col("m.source_id"))
    return out.select(*scope, "quote_id", "status", F.when(empty, 0.0).otherwise(F.bround("share", 2)).alias("coverage"), named.alias("source_id"))


def check_elided(quotes: DataFrame, sources: DataFrame, scope: list[str] = []) -> DataFrame:
    """As check(), but a quote with an ellipsis between runs of three words or more counts as the worst of these."""
    ellipsis = r"\.{3,}|\[\.\.\.\]|…"
    parts = F.filter(F.split("quote", ellipsis), lambda p: F.size(X.normal_words(p)) >= 3)
    cut = F.when(F.col("quote").rlike(ellipsis) & (F.size(parts) >= 2), parts).otherwise(F.array("quote"))
    pieces = quotes.select(*scope, "quote_id", F.posexplode(cut).alias("no", "quote"))
    checked = check(pieces.select(*scope, F.struct("quote_id", "no").alias("quote_id"), "quote"), sources, scope)
    rank = F.when(F.col("status") == "unverified", 0).when(F.col("status") == "partial", 1).when(F.col("status") == "verified", 2).otherwise(3)
    worst = F.min(F.struct(rank.alias("r"), F.col("coverage").alias("coverage"), F.col("quote_id.no").alias("no"), F.col("status").alias("status"), F.col("source_id").alias("source_id")))
    return checked.groupBy(*scope, F.col("quote_id.quote_id").alias("quote_id")).agg(worst.alias("w")).select(*scope, "quote_id", "w.status", "w.coverage", "w.source_id")


def verdict(cited: Column, invalid: Column, statuses: Column) -> Column:
    """Of an answer: arrays of cited ids, of those that are no source, and of its quotes' statuses."""
    return (
        F.when((F.size(cited) == 0) & (F.size(statuses) == 0), "general_knowledge")
        .when((F.size(invalid) > 0) | F.array_contains(statuses, "unverified"), "unverified")
        .when(F.array_contains(statuses, "partial"), "partially_grounded")
        .otherwise("grounded")
    )


def answer_quotes(answers: DataFrame, sources: DataFrame, most: int = 12, least_words: int = 4) -> DataFrame:
    """(answer_id, n, quote, status, coverage, source_id): the quotes of each answer that must hold up, in order.

    A quote counts if it has enough words and a source of the answer is cited in the 80 characters after it, or if it is found in
    one. The scan of an answer ends with its `most`-th quote that counts; what follows is not judged. sources (answer_id,
    source_id, text) number each answer's sources 1, 2, ..., which answers (answer_id, answer) cite as S1, S2, ...
    """
    spans = answers.select("answer_id", F.posexplode(X.quoted_spans(F.col("answer"))).alias("at", "s")).select("answer_id", "at", "s.quote", X.citations(F.col("s.after")).alias("near"))
    spans = spans.where(F.size(F.filter(F.split("quote", f"{X.BLANK}+"), lambda w: w != "")) >= least_words)
    checked = check_elided(spans.select("answer_id", F.col("at").alias("quote_id"), "quote"), sources, ["answer_id"]).withColumnRenamed("quote_id", "at")
    judged = spans.join(_known(sources), "answer_id", "left").join(checked, ["answer_id", "at"])
    counts = judged.where(F.coalesce(F.arrays_overlap("near", "known"), F.lit(False)) | (F.col("status") == "verified"))
    n = F.row_number().over(Window.partitionBy("answer_id").orderBy("at"))
    return counts.withColumn("n", n).where(F.col("n") <= most).select("answer_id", "n", "quote", "status", "coverage", "source_id")


def _known(sources: DataFrame) -> DataFrame:
    return sources.groupBy("answer_id").agg(F.collect_set(F.concat(F.lit("S"), F.col("source_id").cast("string"))).alias("known"))


def report(answers: DataFrame, sources: DataFrame, most: int = 12) -> DataFrame:
    """A row for each answer: cited and invalid source ids, how many quotes are verified, partial and unverified, their total, the
    badge (verified/total), its tone (the worst status), the quotes not found, and the verdict."""
    count = lambda s: F.coalesce(F.count_if(F.col("status") == s), F.lit(0)).alias(s)
    quotes = answer_quotes(answers, sources, most).groupBy("answer_id").agg(
        F.collect_list("status").alias("statuses"), *map(count, ("verified", "partial", "unverified")),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "unverified", F.struct("n", "quote")))), lambda q: q["quote"]).alias("unmatched"),
    )
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    rows = answers.select("answer_id", X.citations(F.coalesce("answer", F.lit(""))).alias("cited")).join(_known(sources), "answer_id", "left").join(quotes, "answer_id", "left")
    rows = rows.withColumn("invalid", F.array_except("cited", none(F.col("known"), "string"))).withColumn("statuses", none(F.col("statuses"), "string")).withColumn("total", F.size("statuses"))
    tone = F.when(F.col("unverified") > 0, "unverified").when(F.col("partial") > 0, "partial").when(F.col("total") > 0, "verified").otherwise("none")
    badge = F.concat(F.coalesce("verified", F.lit(0)).cast("string"), F.lit("/"), F.col("total").cast("string"))
    return rows.select(
        "answer_id", "cited", "invalid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("verified", "partial", "unverified")], "total", badge.alias("badge"), tone.alias("tone"),
        none(F.col("unmatched"), "string").alias("unmatched"), verdict(F.col("cited"), F.col("invalid"), F.col("statuses")).alias("verdict"),
    )
