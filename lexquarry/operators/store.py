"""The relational store as functions of DataFrames: cascades, expiry, recent rows, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as X


def deleted(parents: DataFrame, children: DataFrame, scope: DataFrame, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents without those in scope (a column `key`), and children without theirs."""
    return parents.join(scope, key, "left_anti"), children.join(scope.withColumnRenamed(key, parent_key), parent_key, "left_anti")


def expired(sessions: DataFrame, now: float, ttl: float) -> DataFrame:
    return sessions.where(F.col("last_seen") < now - ttl).select("id")


def recent(messages: DataFrame, conv: str, order: str, most: int) -> DataFrame:
    """The last rows of every conversation, in order. The limit is applied before the shuffle, by the optimiser."""
    last = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(order)))
    return messages.withColumn("_r", last).where(F.col("_r") <= most).drop("_r")


def summaries(conversations: DataFrame, messages: DataFrame, most: int = 200) -> DataFrame:
    """Conversations with their number of messages (0 for none), the latest first."""
    counted = messages.groupBy("conversation_id").agg(F.count("*").alias("n_messages"))
    joined = conversations.join(counted, conversations["id"] == counted["conversation_id"], "left").drop("conversation_id")
    return joined.withColumn("n_messages", F.coalesce("n_messages", F.lit(0))).orderBy(F.desc("updated_at"), "id").limit(most)


def nested(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their chunks as an array in order, and vectors only if every chunk has one."""
    own = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "location", "section"))).alias("chunks"), F.every(F.col("embedding").isNotNull()).alias("has_vectors"))
    return documents.join(own, documents["id"] == own["doc_id"], "left").drop("doc_id")


def conversations_after(log: DataFrame, most_title: int = 60) -> DataFrame:
    """(conv, session, title, n_messages, updated, messages): the conversations that are left after a log of operations.

    log: (seq, session, conv, op, role, text), with op one of create, message, rename, delete (all of one conversation) and clear
    (all of a session, conv null). The first create of a conversation names its session; operations of other sessions, before
    it, or from its deletion on, do nothing. The title is that of the last rename, else made from the user's first message.
    messages are structs (seq, role, text) in order. Everything is grouped, nothing replayed, so a long log is many tasks' work.
    """
    created = log.where("op = 'create'").groupBy("conv").agg(F.min(F.struct("seq", "session")).alias("c")).select("conv", F.col("c.seq").alias("since"), F.col("c.session").alias("owner"))
    clears = log.where("op = 'clear'").groupBy(F.col("session").alias("owner")).agg(F.max("seq").alias("cleared"))
    cleared = created.join(clears, "owner").where("cleared > since").select("conv")
    own = log.where("op <> 'create' AND op <> 'clear'").join(created, "conv").where((F.col("session") == F.col("owner")) & (F.col("seq") > F.col("since")))
    gone = own.where("op = 'delete'").select("conv").distinct()
    left = created.join(cleared, "conv", "left_anti").join(gone, "conv", "left_anti")
    said = own.select("conv", "seq", "op", "role", "text").join(left.select("conv"), "conv", "left_semi")
    message = F.col("op") == "message"
    known = said.groupBy("conv").agg(
        F.count_if(message).alias("n_messages"), F.max("seq").alias("_last"), F.max(F.when(F.col("op") == "rename", F.struct("seq", "text")))["text"].alias("_named"),
        F.min(F.when(message & (F.col("role") == "user"), F.struct("seq", "text")))["text"].alias("_first"), F.array_sort(F.collect_list(F.when(message, F.struct("seq", "role", "text")))).alias("messages"),
    )
    rows = left.join(known, "conv", "left")
    return rows.select("conv", F.col("owner").alias("session"), F.coalesce("_named", X.title(F.col("_first"), most_title), F.lit("")).alias("title"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"), F.coalesce("_last", "since").alias("updated"), "messages")


def pasted(texts: DataFrame, least: int = 20, most: int = 500_000, name: str = "Pasted text") -> DataFrame:
    """texts (session, seq, name, text) with doc_id, sha, refused and duplicate_of: texts that are given in place of a file.

    A blank name gets the default, any but .txt and .md files the ending .txt. Texts out of bounds are refused. doc_id is made of
    session and place, so that a retried job gives the same; a text that its session has is a duplicate of the first.
    """
    given = X.strip(F.coalesce("name", F.lit("")))
    named = F.when(given == "", name).otherwise(given)
    rows = texts.withColumn("name", F.when(F.lower(named).rlike(r"\.(txt|md)$"), named).otherwise(F.concat(named, F.lit(".txt")))).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    size = F.length(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("refused", F.when(size < least, "too_short").when(size > most, "too_long"))
    rows = rows.withColumn("doc_id", F.substring(F.sha2(F.concat_ws("|", "session", F.col("seq").cast("string"), "sha"), 256), 1, 16))
    first = rows.where("refused IS NULL").groupBy("session", "sha").agg(F.min(F.struct("seq", "doc_id")).alias("f")).select("session", "sha", F.col("f.doc_id").alias("_first"))
    joined = rows.join(first, ["session", "sha"], "left")
    return joined.withColumn("duplicate_of", F.when(F.col("refused").isNull() & (F.col("_first") != F.col("doc_id")), F.col("_first"))).drop("_first")
