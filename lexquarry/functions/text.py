"""Text algebra as Column expressions; all but Unicode normalisation of non-ASCII texts stays in the JVM."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry no meaning of their own for ranking.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "with"]
#: Endings taken off a word that keeps at least four characters.
SUFFIXES = ["ational", "ations", "ation", "ating", "ated", "ates", "ate", "ments", "ment", "ings", "ing", "ies", "ed", "es", "s"]

WORD = r"[\p{L}\p{N}\p{M}_]+"
STEM = "^(.{4,}?)(?:" + "|".join(SUFFIXES) + ")$"
#: Blanks as Python's split() and strip() know them.
BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"
HEADING_WORD = r"(?i)^(?:article|section|clause|schedule|annex(?:ure)?|appendix|part|chapter|exhibit)(?![\p{L}\p{N}_])"
HEADING_NUMBER = r"^(?:\d{1,3}(?:\.\d{1,3}){0,3}\.?|[IVXLC]{1,6}\.|\([a-z]\))\s+\S"
CITATION = r"\[\s*(S\d+(?:\s*[,;]\s*S\d+)*)\s*\]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def stem(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, STEM, "$1"), "^(.{4,})e$", "$1")


def tokenize(text: Column) -> Column:
    """Lower-cased words, stop words dropped before stemming."""
    kept = F.filter(words(F.lower(text)), lambda w: ~w.isin(STOPWORDS))
    return F.transform(kept, stem)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{BLANK}+", " "))


def clean_text(text: Column) -> Column:
    """Line ends unified, control characters dropped, blanks before line ends and empty lines beyond one dropped."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return strip(F.regexp_replace(F.regexp_replace(lines, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


def is_heading(line: Column) -> Column:
    """Whether a line reads like the heading of a clause: by keyword, number or capitals, and neither long nor a sentence."""
    line = squeeze(line)
    count = F.size(F.split(line, " "))
    long = (F.length(line) > 90) | (count > 12)
    sentence = line.rlike("[,;]$") | (line.endswith(".") & (count > 6))
    capitals = (F.regexp_count(line, F.lit(r"\p{L}")) >= 3) & (F.regexp_count(line, F.lit(r"\p{L}")) == F.regexp_count(line, F.lit(r"\p{Lu}")))
    return F.coalesce((line != "") & ~long & ~sentence & (line.rlike(HEADING_WORD) | line.rlike(HEADING_NUMBER) | capitals), F.lit(False))


def ngrams(parts: Column, n: int = 3) -> Column:
    """Distinct runs of n neighbouring words, joined by spaces; none if there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(parts) - (n - 1)), lambda i: F.array_join(F.slice(parts, i, n), " "))
    return F.when(F.size(parts) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pc.utf8_normalize(texts, form="NFKC")


def nfkc(text: Column) -> Column:
    """The text with compatible signs (ligatures, full-width digits) as plain ones. Only texts beyond ASCII leave the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def normal_words(text: Column) -> Column:
    """Lower-cased words of a text (by nfkc(), where it may hold signs beyond ASCII) whose quotes and dashes are made plain."""
    return words(F.lower(F.translate(text, "“”„‘’–—‑ ", "\"\"\"''--- ")))


def citations(text: Column) -> Column:
    """Distinct cited source ids in order, as in [S1] or [S1, S3]."""
    groups = F.regexp_extract_all(text, F.lit(CITATION), 1)
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[,;]\s*"))))


#: Fixed value: text in a pair of straight or curly marks, at most 600 characters on one line, and the 80 characters after it.
QUOTED = r'"([^"\n]{1,600})"(?=([\s\S]{0,80}))|“([^”\n]{1,600})”(?=([\s\S]{0,80}))'


def quoted_spans(text: Column) -> Column:
    """Quotes in order as structs (quote, after): their text without blanks at its ends, and the 80 characters that follow. Marks
    pair from the left, so that a short phrase does not open the quote after it."""
    found = [F.regexp_extract_all(text, F.lit(QUOTED), i) for i in (1, 2, 3, 4)]
    pairs = F.arrays_zip(*[f.alias(n) for f, n in zip(found, ("straight", "after", "curly", "then"))])
    return F.transform(pairs, lambda p: F.struct(strip(F.concat(p["straight"], p["curly"])).alias("quote"), F.concat(p["after"], p["then"]).alias("after")))


def title(text: Column, most: int = 60) -> Column:
    line = squeeze(text)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.regexp_replace(F.substring(line, 1, most - 3), f"{BLANK}+$", ""), F.lit("...")))


def escape_tags(text: Column) -> Column:
    """Closing tags of the prompt's own wrappers made harmless."""
    return F.regexp_replace(text, "(?i)</(sources?|document|situation|question)", "&lt;/$1")


def attribute(text: Column) -> Column:
    return F.substring(F.translate(text, '"\n', "' "), 1, 160)


#: What is taken out of Markdown before it is spoken, and what comes in its place, in order.
SPOKEN = [
    (r"```[\s\S]*?```", " "), (r"\[(S\d+(?:\s*[,;]\s*S\d+)*)\]", ""), (r"\[([^\]]+)\]\((https?:[^)]+)\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""),
    (r"(?m)^\s*\d+[.)]\s+", ""), (r"(?m)^\s*>\s?", ""), (r"\|", " "), (r"[*_`~#]", ""), (r"\s+", " "), (r"\s+([.,;:!?])", "$1"),
]


def speakable(text: Column) -> Column:
    """Markdown as plain words to be spoken."""
    out = text
    for pattern, by in SPOKEN:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def safe_filename(name: Column) -> Column:
    """The last part of a path without control characters, at most 120 characters, or "document"."""
    last = F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1)
    cleaned = F.substring(F.trim(F.regexp_replace(last, r"\p{C}", "")), 1, 120)
    return F.when(cleaned == "", "document").otherwise(cleaned)


def size_label(count: Column) -> Column:
    """Bytes as B, KB or MB."""
    return F.when(count < 1024, F.concat(count.cast("string"), F.lit(" B"))).when(count < 1048576, F.concat(F.round(count / 1024, 0).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.concat(F.round(count / 1048576, 1).cast("string"), F.lit(" MB")))


def hash_bucket(token: Column, width: int = 64) -> Column:
    """md5 modulo width, for widths that divide 256."""
    return F.conv(F.right(F.md5(token), F.lit(2)), 16, 10).cast("int") % width


def first_rows(rows: DataFrame, group: str, number: str, most: int, width: int = 1024) -> DataFrame:
    """Of each group at least its first `most` rows by a number, and none that lies beyond the block of `width` numbers in which the
    last of these is. Only counts of blocks are shuffled, so a window over what is left has few rows, whatever the table's size."""
    block = F.floor(F.col(number) / width)
    counts = rows.groupBy(F.col(group).alias("_group"), block.alias("_block")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_block")) - F.col("_n")
    last = counts.withColumn("_before", before).where(F.col("_before") < most).groupBy("_group").agg(F.max("_block").alias("_last"))  # a row a group
    return rows.join(F.broadcast(last), F.col(group).eqNullSafe(F.col("_group"))).where(block <= F.col("_last")).drop("_group", "_last")


def row_groups(rows: DataFrame, sheet: str, row: str, line: str, size: int = 50) -> DataFrame:
    """(sheet, b, location, n_rows, text): numbered lines of sheets in segments of `size` rows. The first line that is not empty is
    a sheet's header, told again in every segment but the first; empty lines are left out but counted, as are segments of them."""
    held = rows.select(sheet, F.col(row).alias("_i"), F.col(line).alias("_line"), F.floor((F.col(row) - 1) / size).alias("b"))
    headers = held.where("_line <> ''").groupBy(F.col(sheet).alias("_sheet")).agg(F.min_by("_line", "_i").alias("_header"))
    told = F.array_sort(F.collect_list(F.when(F.col("_line") != "", F.struct("_i", "_line"))))
    groups = held.groupBy(sheet, "b").agg(F.count("*").alias("_n"), told.alias("g")).where(F.size("g") > 0).join(headers, F.col(sheet) == F.col("_sheet"))
    first, last = (F.col("b") * size + 1).cast("string"), (F.col("b") * size + F.col("_n")).cast("string")
    body = F.array_join(F.transform("g", lambda s: s["_line"]), "\n")
    text = F.when(F.col("b") > 0, F.concat(F.lit("(Columns: "), "_header", F.lit(")\n"), body)).otherwise(body)
    return groups.select(sheet, "b", F.concat(F.lit("Sheet '"), F.col(sheet), F.lit("' rows "), first, F.lit("-"), last).alias("location"), F.size("g").cast("long").alias("n_rows"), text.alias("text"))
