"""Paged files: any cut into tasks gives the pages of the whole file."""

import random

import pytest

from lexquarry.sources import files, paged


def whole(text):
    """Pages as of the file in one piece."""
    return [(page, body) for page, body in files.pages_of(text) if body]


def test_any_cut_gives_the_same_pages(tmp_path):
    draw = random.Random(1)
    for i in range(120):
        lines = draw.choices(["[Page 1]", "  [Page 22]  ", "[Page 3] not a mark", "text with [Page 4]", "", "é line 日本", "[Page\t5]", "x" * 300], [3, 2, 1, 1, 2, 4, 1, 1], k=draw.randrange(25))
        text = "\n".join(lines)
        path = tmp_path / f"{i}.txt"
        path.write_text(text, encoding="utf-8")
        for piece in (7, 50, 333, 1 << 20):
            reader = paged.PagedReader({"path": str(path), "bytesPerTask": piece})
            got = [(location, body) for part in reader.partitions() for _, location, body, _ in reader.read(part)]
            assert got == whole(text), (piece, text)


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(paged.PagedFiles)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "long.txt").write_text("".join(f"[Page {n}]\nThis is page {n}.\n" + "word " * 50 + "\n" for n in range(1, 400)))
    (tmp_path / "in" / "sub" / "plain.md").write_text("no marks here")
    (tmp_path / "in" / "bad.txt").write_bytes(b"a\0b")
    (tmp_path / "in" / "picture.png").write_bytes(b"x")
    (tmp_path / "in" / "empty.txt").write_text("")
    return str(tmp_path / "in")


def test_source(spark, folder):
    df = spark.read.format("paged").option("path", folder).option("bytesPerTask", 10_000).load()
    rows = df.collect()
    assert {r.location for r in rows if r.path.endswith("long.txt")} == {f"Page {n}" for n in range(1, 400)}
    assert [(r.location, r.text) for r in rows if r.path.endswith("plain.md")] == [("Page 1", "no marks here")]
    assert {r.path.rsplit("/", 1)[1]: r.error for r in rows if r.error} == {"bad.txt": "The file is not UTF-8 text.", "picture.png": "This kind of file has no pages."}
    assert df.rdd.getNumPartitions() > 10  # one file, several tasks
    assert spark.read.format("paged").option("path", folder).option("maxBytes", 1000).load().where("error = 'The file is too large.'").count() == 1


def test_pushed_filters(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("paged").option("path", folder).option("pushFilters", "true").load()
        assert [r.location for r in df.where("location = 'Page 7'").collect()] == ["Page 7"]
        assert sorted(r.location for r in df.where("location IN ('Page 1', 'Page 399') AND length(text) > 20").collect()) == ["Page 1", "Page 399"]
        one = df.where(f"path = '{folder}/sub/plain.md'")
        assert one.rdd.getNumPartitions() == 1 and one.count() == 1
        assert df.where("path = 'nowhere'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
