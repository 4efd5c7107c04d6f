import pytest
from pyspark.sql import functions as F

from lexquarry.functions import text as X
from lexquarry.operators.chunking import chunk_documents, chunks, line_headings, pieces


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("words", [["terminate", "terminated", "terminates", "termination", "terminating"], ["deposit", "deposits"]])
def test_stems_agree(spark, words):
    got = {one(spark, X.stem, w) for w in words}
    assert len(got) == 1


def test_tokens_of_other_scripts(spark):
    assert one(spark, X.tokenize, "किराया और जमा राशि") == ["किराया", "और", "जमा", "राशि"]


@pytest.mark.parametrize("text,want", [("A [S2]. B [S1, S3]; C [S2][S4] and [S5;S6]", ["S2", "S1", "S3", "S4", "S5", "S6"]), ("none", []), ("[s1] [S]", [])])
def test_citations(spark, text, want):
    assert one(spark, X.citations, text) == want


@pytest.mark.parametrize("line,want", [("4. SECURITY DEPOSIT", True), ("Section 12 Termination", True), ("TERMINATION", True), ("(a) rent", True), ("This is a plain sentence that ends here.", False), ("30 days notice", True), ("", False), ("A, B,", False), ("AB", False), ("x" * 91, False)])
def test_headings(spark, line, want):
    assert one(spark, X.is_heading, line) is want
    assert one(spark, line_headings, f"before, and after,\n{line}\n")[1] == (" ".join(line.split()) if want else None)


def test_clean_and_title(spark):
    assert one(spark, X.clean_text, "a \r\nb\r\rc\x00\n\n\n\nd  ") == "a\nb\n\nc\n\nd"
    assert one(spark, X.title, "word " * 30) == ("word " * 30)[:57].rstrip() + "..."
    assert one(spark, X.escape_tags, "</Source></question>") == "&lt;/Source>&lt;/question>"
    assert one(spark, X.speakable, "# T\n- **a** [S1] [b](https://x) `c` .") == "T a b c."
    assert one(spark, X.safe_filename, "..\\..\\etc/pass\u0007wd") == "passwd"


def test_chunks_keep_section_and_overlap():
    lines = "\n".join(f"The deposit line number {i} is here" for i in range(60))
    segments = ["4. SECURITY DEPOSIT\n" + lines, "5. TERMINATION\nShort."]
    got = chunks(segments, [[line if line[0] in "45" else None for line in s.split("\n")] for s in segments], 400, 80)
    first = [c for c in got if c[0] == 0]
    assert len(first) > 1 and all(c[1] == "4. SECURITY DEPOSIT" and len(c[2]) <= 480 for c in first)
    assert first[1][2].split("\n")[0] in first[0][2]
    assert got[-1] == (1, "5. TERMINATION", "5. TERMINATION\nShort.")
    assert all(len(p) <= 50 for p in pieces("One two three. " * 20 + "x" * 120, 50))


def test_chunk_documents(spark):
    df = spark.createDataFrame([(1, "PETS\n\n  No   cats.\n1. RENT\nIt is due."), (2, None), (3, ""), (4, "plain text, without any")], "doc_id int, text string")
    got = [tuple(r) for r in chunk_documents(df).orderBy("doc_id", "index").collect()]
    assert got == [(1, 0, "PETS", "PETS\nNo   cats.\n1. RENT\nIt is due."), (4, 0, "", "plain text, without any")]


def test_marked_text(spark):
    df = spark.createDataFrame([([("Page 1", "x" * 500), ("Page 2", "y" * 500)],), ([("Page 1", "x" * 700), ("Page 2", "y" * 500)],), ([],)], "s array<struct<location:string,text:string>>")
    from lexquarry.functions import prompts as P

    got = [r[0] for r in df.select(P.marked_text(F.col("s"), 800)).collect()]
    assert got[0].truncated and "[Page 2]" in got[0].text and len(got[0].text) <= 810
    assert got[1].truncated and "[Page 2]" not in got[1].text and (got[2].text, got[2].truncated) == ("", False)


def test_prompts_and_labels(spark):
    from lexquarry.functions import prompts as P

    assert one(spark, lambda c: P.retry_after(c), "Please retry in 7.5s") == 7 and one(spark, lambda c: P.retry_after(c), "no hint") == 60
    assert one(spark, lambda c: P.analysis_prompt(c, F.lit(" "), F.array().cast("array<string>")), "Task") == "Task\n\n" + P.NO_DOCUMENTS
    assert one(spark, lambda c: P.export_name(c), "Risk: report (1)!") == "Risk_report_1"
    marks = one(spark, lambda c: P.highlights(c, F.array(F.lit("RENT"), F.lit("ent is"), F.lit("due"))), "The rent is due")
    assert [(m.start, m.length) for m in marks] == [(5, 4), (13, 3)]


@pytest.mark.parametrize("told,wait", [("999999", 3600), ("1000000", 3600), ("9" * 60, 3600), ("0000012", 12), ("000", 5), ("3599", 3599), ("10000", 3600)])
def test_retry_after_any_length(spark, told, wait):
    from lexquarry.functions import prompts as P

    assert one(spark, lambda c: P.retry_after(c), f"quota: please retry in {told}s") == wait


def test_statuses_round_half_to_even(spark, tmp_path):
    """As DuckDB casts doubles to integers."""
    from lexquarry.plans import display

    spark.createDataFrame([(1, 428.5), (2, 429.5), (3, 400.5), (4, 499.5)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert [r.kind for r in display.error_envelopes(spark, str(tmp_path)).orderBy("event_id").collect()] == ["failed", "failed", "rejected", "unavailable"]


def test_first_rows(spark):
    """A window gets the rows it needs and few others, not a whole sheet."""
    rows = spark.range(0, 40000, 2).select(F.when(F.col("id") % 20 == 0, None).when(F.col("id") % 3 == 0, "a").otherwise("b").alias("sheet"), (F.col("id") - 7000).alias("k"))
    kept = {}
    for r in X.first_rows(rows, "sheet", "k", 1500).collect():
        kept.setdefault(r.sheet, []).append(r.k)
    whole = {}
    for r in rows.collect():
        whole.setdefault(r.sheet, []).append(r.k)
    for sheet, ks in whole.items():
        assert set(sorted(ks)[:1500]) <= set(kept[sheet]) <= set(ks) and len(kept[sheet]) <= 1500 + 512
    assert X.first_rows(rows.where("false"), "sheet", "k", 5).count() == 0


def test_pcm16(spark):
    from pyspark.sql import functions as F

    from lexquarry.functions.audio import pcm16

    df = spark.createDataFrame([([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0],)], "s array<double>")
    assert df.select(pcm16(F.col("s"))).first()[0] == [-32768, -32768, -16384, 0, 16383, 32767, 32767]
