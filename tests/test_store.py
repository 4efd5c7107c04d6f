"""The store as functions of logs and tables."""

from pyspark.sql import functions as F

from lexquarry.functions import prompts as P
from lexquarry.functions import text as X
from lexquarry.operators import store


def test_conversations_after_a_log(spark):
    log = [
        (1, "s", "a", "create", None, None), (2, "s", "a", "message", "user", "  First   question " + "x" * 80), (3, "t", "a", "message", "user", "not mine"), (4, "t", "a", "delete", None, None), (5, "t", "a", "rename", None, "stolen"),
        (6, "s", "a", "message", "assistant", "answer"), (7, "s", "b", "message", "user", "before it is there"), (8, "s", "b", "create", None, None), (9, "s", "b", "rename", None, "named"), (10, "s", "b", "rename", None, "named again"),
        (11, "t", "b", "create", None, None), (12, "t", "c", "create", None, None), (13, "t", "c", "message", "user", "gone"), (14, "t", "c", "delete", None, None), (15, "t", "c", "message", "user", "too late"),
        (16, "u", "d", "create", None, None), (17, "u", None, "clear", None, None), (18, "u", "d", "message", "user", "too late"), (19, "u", "e", "create", None, None), (20, "s", None, "clear", None, None), (21, "s", "f", "create", None, None),
    ]
    df = spark.createDataFrame(log, "seq long, session string, conv string, op string, role string, text string")
    got = {r.conv: r for r in store.conversations_after(df.where("seq < 20")).collect()}
    assert set(got) == {"a", "b", "e"}
    assert got["a"].title == ("First question " + "x" * 80)[:57] + "..." and [(m.seq, m.role, m.text) for m in got["a"].messages][1:] == [(6, "assistant", "answer")]
    assert (got["a"].session, got["a"].n_messages, got["a"].updated) == ("s", 2, 6)
    assert (got["b"].title, got["b"].n_messages, got["b"].updated) == ("named again", 0, 10) and (got["e"].title, got["e"].updated) == ("", 19)
    assert {r.conv for r in store.conversations_after(df).collect()} == {"e", "f"}
    assert store.conversations_after(df.where("false")).count() == 0


def test_pasted_texts(spark):
    long = "some text that is long enough"
    rows = [("s", 1, None, long), ("s", 2, " ", "short"), ("s", 3, "Notes.MD", long), ("t", 4, "lease", long), ("s", 5, "x.pdf", long * 3), ("s", 6, "y.txt", None), ("s", 7, "z", long + "!" * 80)]
    got = {r.seq: r for r in store.pasted(spark.createDataFrame(rows, "session string, seq long, name string, text string"), 20, 100).collect()}
    assert [got[i].name for i in range(1, 8)] == ["Pasted text.txt", "Pasted text.txt", "Notes.MD", "lease.txt", "x.pdf.txt", "y.txt", "z.txt"]
    assert [got[i].refused for i in range(1, 8)] == [None, "too_short", None, None, None, "too_short", "too_long"]
    assert got[3].duplicate_of == got[1].doc_id and all(got[i].duplicate_of is None for i in (1, 4, 5)) and len({r.doc_id for r in got.values()}) == 7 and len(got[1].doc_id) == 16


def test_previews(spark):
    kind = "s array<struct<location:string,text:string>>"
    df = spark.createDataFrame([([("a", "x" * 5), ("b", "y" * 5), ("c", "z")],), ([("a", "x" * 11)],), ([],), ([("a", "x" * 10)],)], kind)
    got = [r[0] for r in df.select(P.preview(F.col("s"), 10)).collect()]
    assert [([s.location for s in g.segments], g.truncated) for g in got] == [(["a", "b"], True), ([], True), ([], False), (["a"], False)]
    assert spark.range(1).select(P.escape_html(F.lit("<a href=\"x\">'&amp;'</a>"))).first()[0] == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;amp;&#39;&lt;/a&gt;"


def test_row_groups(spark):
    rows = [("S", i, "" if i in (1, 4, 5, 6) else f"r{i}") for i in range(1, 9)] + [("T", 1, ""), ("T", 2, "")]
    got = X.row_groups(spark.createDataFrame(rows, "sheet string, i long, line string"), "sheet", "i", "line", 3).orderBy("b").collect()
    assert [(r.location, r.n_rows, r.text) for r in got] == [("Sheet 'S' rows 1-3", 2, "r2\nr3"), ("Sheet 'S' rows 7-8", 2, "(Columns: r2)\nr7\nr8")]


def test_web_sources(spark):
    rows = [(1, 5, "u1", "Later", "h"), (1, 2, "u1", " First ", "h"), (1, 3, "u2", "", "host"), (1, 4, "u3", None, " "), (2, 1, "u1", None, None)] + [(3, i, f"u{i}", "t", "h") for i in range(20)]
    got = P.web_sources(spark.createDataFrame(rows, "answer int, place int, uri string, title string, domain string"), "answer", "place").orderBy("answer", "rank").collect()
    assert [(r.rank, r.uri, r.title) for r in got if r.answer == 1] == [(1, "u1", "First"), (2, "u2", "host"), (3, "u3", "Source")]
    assert [r.title for r in got if r.answer == 2] == ["Source"] and len([r for r in got if r.answer == 3]) == 8


def test_options(spark):
    rows = [(None, None, None), ("Hindi", "India", "  tenant \n of  a flat "), ("Klingon", "India", ""), ("English", "Mars", ""), ("English", "Canada", "x" * 81), ("english", "Canada", "")]
    df = spark.createDataFrame(rows, "l string, j string, r string")
    got = [r[0] for r in df.select(P.options(F.col("l"), F.col("j"), F.col("r"))).collect()]
    assert [(g.language, g.tag, g.jurisdiction, g.role, g.problem) for g in got[:2]] == [("English", "en-IN", "Auto-detect", "", None), ("Hindi", "hi-IN", "India", "tenant of a flat", None)]
    assert [g.problem for g in got[2:]] == ["unsupported language", "unsupported jurisdiction", "role too long", "unsupported language"]
