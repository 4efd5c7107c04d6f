"""Markdown blocks, and Word files written in two phases."""

import glob
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lexquarry.sources import files, word

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TEXT = "# Title\n\nPlain **bold** and *it* a * b ** c\n#### deep\n##### not\n- item\n* other\n2) two\n> quoted\n>> twice\n| A | B |\n|:---|---|\n| 1 | **2** | 3 |\n\n|---|\n|x|\nend\r\n<tag> & \x01"


def blocks(spark, text):
    df = spark.createDataFrame([(text,)], "markdown string")
    return df.select(word.markdown_blocks("markdown").alias("b")).first().b


def test_blocks(spark):
    got = [(b.kind, b.level, [["".join(r.text for r in cell)][0] for cell in b.cells]) for b in blocks(spark, TEXT) if b.kind != "blank"]
    assert got == [
        ("heading", 1, ["Title"]), ("paragraph", 0, ["Plain bold and it a  b * c"]), ("heading", 3, ["deep"]), ("paragraph", 0, ["##### not"]), ("bullet", 0, ["item"]), ("bullet", 0, ["other"]), ("numbered", 0, ["two"]),
        ("quote", 0, ["quoted"]), ("quote", 0, ["twice"]), ("table", 0, ["A", "B"]), ("table", 0, ["1", "2", "3"]), ("table", 0, ["---"]), ("table", 0, ["x"]), ("paragraph", 0, ["end"]), ("paragraph", 0, ["<tag> & \x01"]),
    ]
    runs = blocks(spark, TEXT)[2].cells[0]
    assert [(r.text, r.bold, r.italic) for r in runs][:4] == [("Plain ", False, False), ("bold", True, False), (" and ", False, False), ("it", False, True)]
    assert [b.kind for b in blocks(spark, None)] == ["blank"]


def read(path):
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            if name.endswith((".xml", ".rels")):
                ElementTree.fromstring(z.read(name))
        return ElementTree.fromstring(z.read("word/document.xml")), z.read("docProps/core.xml").decode()


def test_written_files(spark, tmp_path):
    spark.dataSource.register(word.WordFiles)
    rows = [("brief", "A & B", TEXT), ("brief", "Second", "x"), (None, None, None), ("a/b", "t", "")]
    df = spark.createDataFrame(rows, "name string, title string, markdown string").coalesce(1).select("name", "title", word.markdown_blocks("markdown").alias("blocks"))
    target = str(tmp_path / "out")
    df.write.format("word").mode("append").save(target)
    found = {f.rsplit("/", 1)[1]: f for f in glob.glob(f"{target}/part-*/*")}
    assert set(found) == {"brief.docx", "brief (2).docx", "document.docx", "a_b.docx"} and not glob.glob(f"{target}/_staged*")
    page, core = read(found["brief.docx"])
    styles = [s.get(f"{W}val") for s in page.iter(f"{W}pStyle")]
    assert styles == ["Title", "Heading1", "Heading3", "ListBullet", "ListBullet", "ListNumber", "Quote", "Quote"] and "A &amp; B" in core
    tables = list(page.iter(f"{W}tbl"))
    assert [[len(r.findall(f"{W}tc")) for r in t.findall(f"{W}tr")] for t in tables] == [[3, 3], [1, 1]]
    assert [r.find(f"{W}t").text for r in page.iter(f"{W}r") if r.find(f"{W}rPr/{W}b") is not None] == ["bold", "2"]
    with open(found["brief.docx"], "rb") as f:  # the library's own reader gives the text back
        segments = files.parse("docx", "brief.docx", f.read())
    assert "Plain bold and it" in segments[0][1] and word.FOOTER in segments[-1][1]
    df.limit(1).write.format("word").mode("append").save(target)
    assert len(glob.glob(f"{target}/part-*/*")) == 5
    df.limit(1).write.format("word").mode("overwrite").save(target)
    assert len(glob.glob(f"{target}/part-*/*")) == 1


@pytest.mark.parametrize("parts", [1, 4])
def test_nothing_is_seen_of_a_failed_write(spark, tmp_path, parts):
    """A task that still runs while a write is given up may leave staged files, which no reader lists; one task leaves none."""
    spark.dataSource.register(word.WordFiles)
    df = spark.range(40).repartition(parts).select(F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("name"), F.lit("t").alias("title"), word.markdown_blocks(F.lit("x")).alias("blocks"))
    with pytest.raises(Exception, match="broken"):
        df.write.format("word").mode("append").save(str(tmp_path / "out"))
    assert not glob.glob(f"{tmp_path}/out/part-*") and (parts > 1 or not glob.glob(f"{tmp_path}/out/*"))
