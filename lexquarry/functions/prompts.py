"""Prompts assembled from data: wrapped sources, documents, questions, and the context line of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions.text import attribute, escape_tags, squeeze, strip

#: What stands for an empty list.
NO_SOURCES = "(no documents uploaded or none relevant)"
NO_DOCUMENTS = "(The user has not provided any documents.)"


def _quoted(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'{name}="'), attribute(value), F.lit('"'))


def source_block(sources: Column) -> Column:
    """An array of structs (id, name, location, section, text) as one block of tagged sources."""
    one = F.transform(sources, lambda s: F.concat(F.concat_ws(" ", F.concat(F.lit('<source id="'), s["id"], F.lit('"')), _quoted("document", s["name"]), _quoted("location", s["location"]), _quoted("section", s["section"])), F.lit(">\n"), escape_tags(s["text"]), F.lit("\n</source>")))
    return F.concat(F.lit("<sources>\n"), F.when(F.size(sources) == 0, NO_SOURCES).otherwise(F.array_join(one, "\n")), F.lit("\n</sources>"))


def document_block(label: Column, name: Column, text: Column) -> Column:
    return F.concat(F.lit("<document "), _quoted("label", label), F.lit(" "), _quoted("name", name), F.lit(">\n"), escape_tags(text), F.lit("\n</document>"))


def question_turn(question: Column, sources: Column) -> Column:
    return F.concat(sources, F.lit("\n\n<question>\n"), escape_tags(question), F.lit("\n</question>"))


def analysis_prompt(task: Column, situation: Column, documents: Column) -> Column:
    """Task, situation (left out if blank) and documents, with empty lines between."""
    told = strip(F.coalesce(situation, F.lit("")))
    wrapped = F.when(told != "", F.concat(F.lit("<situation>\n"), escape_tags(told), F.lit("\n</situation>")))
    return F.concat_ws("\n\n", task, wrapped, F.when(F.size(documents) == 0, NO_DOCUMENTS).otherwise(F.array_join(documents, "\n\n")))


def marked_text(segments: Column, limit: int | Column) -> Column:
    """(text, truncated): segments (location, text) with their places as marks, up to a budget of characters; the first that
    does not fit is cut if over 200 characters of it remain."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(False).alias("truncated"))

    def step(done: Column, s: Column) -> Column:
        block = F.concat(F.lit("["), s["location"], F.lit("]\n"), s["text"])
        joined = lambda b: F.when(done["text"] == "", b).otherwise(F.concat(done["text"], F.lit("\n\n"), b))
        fits = done["used"] + F.length(block) <= limit
        left = limit - done["used"]
        cut = F.struct(F.when(left > 200, joined(F.substr(block, F.lit(1), left))).otherwise(done["text"]).alias("text"), done["used"].alias("used"), F.lit(True).alias("truncated"))
        more = F.struct(joined(block).alias("text"), (done["used"] + F.length(block) + 2).alias("used"), F.lit(False).alias("truncated"))
        return F.when(done["truncated"], done).when(fits, more).otherwise(cut)

    return F.aggregate(segments, start, step, lambda d: F.struct(d["text"].alias("text"), d["truncated"].alias("truncated")))


def context_label(*parts: Column) -> Column:
    return F.concat_ws(" · ", *[F.nullif(squeeze(p), F.lit("")) for p in parts])


def retry_after(message: Column) -> Column:
    """Seconds to wait that an error tells, between 5 and 3,600, or 60."""
    told = F.regexp_extract(message, r"(?i)retry(?:delay|\s+(?:after|in))\D{0,4}(\d+)", 1)
    digits = F.regexp_replace(told, "^0+(?=.)", "")
    # a number of any length: one of five digits or more is over the most
    return F.greatest(F.lit(5), F.when(F.coalesce(told, F.lit("")) == "", 60).when(F.length(digits) > 4, 3600).otherwise(F.least(F.lit(3600), digits.try_cast("int"))))


def error_class(status: Column) -> Column:
    return F.when(status == 429, "busy").when(status >= 500, "unavailable").when(status.isin(401, 403), "denied").when(status == 400, "rejected").otherwise("failed")


def export_name(title: Column) -> Column:
    """A title as a file name: letters, digits, blanks, underscores and hyphens, blanks as underscores, 60 at most."""
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(title, r"[^A-Za-z0-9 _-]", "")), " ", "_"), 1, 60)


def time_label(seconds: Column) -> Column:
    """How long ago: just now, minutes, hours, yesterday, or days."""
    minute, hour = 60, 3600
    return (
        F.when(seconds < minute, "just now").when(seconds < hour, F.concat(F.floor(seconds / minute).cast("string"), F.lit(" min ago")))
        .when(seconds < 24 * hour, F.concat(F.floor(seconds / hour).cast("string"), F.lit(" h ago"))).when(seconds < 48 * hour, "yesterday")
        .otherwise(F.concat(F.floor(seconds / (24 * hour)).cast("string"), F.lit(" days ago")))
    )


def highlights(text: Column, quotes: Column) -> Column:
    """(start, length) of the first place of each quote, whatever its case, by place; those that begin inside another are left out."""
    at = F.transform(quotes, lambda q: F.struct(F.instr(F.lower(text), F.lower(q)).alias("start"), F.length(q).alias("length")))
    found = F.array_sort(F.filter(at, lambda s: (s["start"] > 0) & (s["length"] > 0)))
    none = F.array().cast("array<struct<start:int,length:int>>")
    end = lambda done: F.when(F.size(done) == 0, 0).otherwise(F.element_at(done, -1)["start"] + F.element_at(done, -1)["length"])
    return F.aggregate(found, none, lambda done, s: F.when(s["start"] >= end(done), F.array_append(done, s)).otherwise(done))


def preview(segments: Column, limit: int = 200_000) -> Column:
    """(segments, truncated): the first segments (location, text) whole, as many as a budget of characters holds."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct((a["upto"] + F.length(s["text"])).alias("upto"), F.when(a["upto"] + F.length(s["text"]) <= limit, a["n"] + 1).otherwise(a["n"]).alias("n"))
    fits = F.aggregate(segments, start, step)["n"]
    return F.struct(F.slice(segments, 1, fits).alias("segments"), (fits < F.size(segments)).alias("truncated"))


def escape_html(text: Column) -> Column:
    """The five signs that HTML gives a meaning, as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def web_sources(cited: DataFrame, answer: str, place: str, most: int = 8) -> DataFrame:
    """(answer, rank, uri, title): the first addresses of each answer by first appearance. Rows have uri, title and domain; an
    address keeps its first title, or else its domain, or else "Source"."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    first = cited.groupBy(answer, "uri").agg(F.min(place).alias("_at"), F.min_by("title", place).alias("title"), F.min_by("domain", place).alias("domain"))
    rank = F.row_number().over(Window.partitionBy(answer).orderBy("_at"))
    # the filter is on the number itself, so that Spark limits each answer's rows before the shuffle
    ranked = first.withColumn("rank", rank).where(F.col("rank") <= most)
    return ranked.select(answer, F.col("rank").cast("long").alias("rank"), "uri", F.coalesce(blank(F.col("title")), blank(F.col("domain")), F.lit("Source")).alias("title"))


#: Languages that can be asked for, with the tags of their speech, and jurisdictions.
LANGUAGES = {
    "English": "en-IN", "Hindi": "hi-IN", "Tamil": "ta-IN", "Telugu": "te-IN", "Kannada": "kn-IN", "Malayalam": "ml-IN", "Bengali": "bn-IN", "Marathi": "mr-IN", "Gujarati": "gu-IN", "Punjabi": "pa-IN", "Urdu": "ur-IN", "Odia": "or-IN",
    "Spanish": "es-ES", "French": "fr-FR", "German": "de-DE", "Portuguese": "pt-BR", "Arabic": "ar-SA", "Chinese (Simplified)": "zh-CN", "Japanese": "ja-JP",
}
JURISDICTIONS = ["Auto-detect", "India", "United States", "United Kingdom", "European Union", "Canada", "Australia", "Singapore", "United Arab Emirates", "Other / International"]


def options(language: Column, jurisdiction: Column, role: Column) -> Column:
    """(language, tag, jurisdiction, role, problem) of a request: what is not given gets its default, blanks of a role are collapsed,
    and problem says what is not known or too long."""
    language, jurisdiction, role = F.coalesce(language, F.lit("English")), F.coalesce(jurisdiction, F.lit("Auto-detect")), F.coalesce(role, F.lit(""))
    problem = F.when(~language.isin(*LANGUAGES), "unsupported language").when(~jurisdiction.isin(*JURISDICTIONS), "unsupported jurisdiction").when(F.length(role) > 80, "role too long")
    tag = F.get(F.filter(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("tag")) for k, v in LANGUAGES.items()]), lambda x: x["name"] == language), F.lit(0))["tag"]
    return F.struct(language.alias("language"), tag.alias("tag"), jurisdiction.alias("jurisdiction"), squeeze(role).alias("role"), problem.alias("problem"))
