"""Paged files as a data source: a large file is read by several tasks, and filters on file and page can be pushed into the reading.

    spark.dataSource.register(PagedFiles)
    spark.read.format("paged").option("path", folder).load().where("location = 'Page 7'")

Pages of text files begin with a line [Page N]; those of PDF files come from an optional library. With option pushFilters the
source takes filters on file and page itself; the session must allow that (spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from lexquarry.sources.files import MAX_BYTES, MAX_PAGES
from lexquarry.sources.html import clean

SCHEMA = "path string, location string, text string, error string"
#: Fixed value: the line before each page.
MARK = re.compile(rb"^[ \t]*\[Page\s+(\d+)\][ \t\r]*$", re.MULTILINE)
#: The longest line that is looked at as a mark.
LONGEST = 256


@dataclass
class Part(InputPartition):
    """Bytes [begin, end) of a text file, pages [begin, end) of a PDF file, or the reason why a file is not read."""

    path: str
    kind: str
    begin: int = 0
    end: int = 0
    size: int = 0
    error: str | None = None


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.piece, self.pages = options["path"], int(options.get("bytesPerTask", 8 << 20)), int(options.get("pagesPerTask", 100))
        self.most = int(options.get("maxBytes", MAX_BYTES))
        self.only: dict[str, set[str]] = {}

    def wanted(self, name: str, value: str | None) -> bool:
        return name not in self.only or value in self.only[name]

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[InputPartition]:
        store, root = self.store()
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
        out: list[InputPartition] = []
        for f in sorted((f for f in files if self.wanted("path", f.path)), key=lambda f: f.path):
            kind = f.extension.lower()
            if f.size > self.most:
                out.append(Part(f.path, kind, error="The file is too large."))
            elif kind == "pdf":  # which pages there are is known where they are read
                steps = range(0, MAX_PAGES, self.pages) if f.size > self.piece else [0]
                out += [Part(f.path, kind, k, min(k + self.pages, MAX_PAGES) if f.size > self.piece else MAX_PAGES, f.size) for k in steps]
            elif kind in ("txt", "md", "text"):
                out += [Part(f.path, kind, k, min(k + self.piece, f.size), f.size) for k in range(0, max(f.size, 1), self.piece)]
            else:
                out.append(Part(f.path, kind, error="This kind of file has no pages."))
        return out or [Part("", "none")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.kind == "none":
            return
        try:
            if partition.error is not None:
                raise ValueError(partition.error)
            for location, text in (self.pdf if partition.kind == "pdf" else self.text)(partition):
                if text and self.wanted("location", location):
                    yield partition.path, location, text, None
        except ValueError as reason:
            if "location" not in self.only and partition.begin == 0:  # a file that is not read is told once, and has no page
                yield partition.path, None, None, str(reason)

    def text(self, part: Part) -> Iterator[tuple[str, str]]:
        """Pages whose marks begin in the part's bytes, each up to the next mark; a file without any is page 1."""
        store, _ = self.store()
        with store.open_input_file(part.path) as f:
            head = f.read_at(min(1024, part.size), 0)
            if b"\0" in head or head[:2] in (b"\xff\xfe", b"\xfe\xff"):
                raise ValueError("The file is not UTF-8 text.")
            at, data = part.begin, b""
            # a mark belongs to the part in which its line begins: what comes before the first line's begin is the part's before
            f.seek(at - 1 if at else 0)
            data = f.read(part.end - at + (1 if at else 0))
            if at:
                skip = data.find(b"\n") + 1
                data = data[skip:] if skip else b""
                if not skip:
                    return
            if data and not data.endswith(b"\n"):
                data += self.line(f)
            marks = list(MARK.finditer(data))
            if not marks and at:
                return
            while not any(m.start() >= (marks[-1].end() if marks else 0) for m in MARK.finditer(data, marks[-1].end() if marks else len(data))):
                more = f.read(self.piece)
                if not more:
                    break
                if not more.endswith(b"\n"):
                    more += self.line(f)
                following = MARK.search(more)
                if following is not None:
                    data += more[: following.start()]
                    if not marks:
                        return  # text before the first mark of a file is of no page
                    break
                data += more
        if not marks:
            yield "Page 1", clean(data.decode(errors="replace"))
            return
        for mark, end in zip(marks, [m.start() for m in marks[1:]] + [len(data)]):
            yield f"Page {int(mark[1])}", clean(data[mark.end() : end].decode(errors="replace"))

    @staticmethod
    def line(f) -> bytes:
        """The rest of the line at which f stands."""
        out = b""
        while True:
            more = f.read(LONGEST)
            end = more.find(b"\n") + 1
            if end:
                f.seek(f.tell() - len(more) + end)
                return out + more[:end]
            out += more
            if not more:
                return out

    def pdf(self, part: Part) -> Iterator[tuple[str, str]]:
        try:
            import pypdf
        except ImportError as e:
            raise ValueError("No PDF reader is installed.") from e
        store, _ = self.store()
        with store.open_input_file(part.path) as f:
            pages = pypdf.PdfReader(f)
            if pages.is_encrypted or len(pages.pages) > MAX_PAGES:
                raise ValueError("The PDF is protected or too long.")
            for n in range(part.begin, min(part.end, len(pages.pages))):
                if self.wanted("location", f"Page {n + 1}"):
                    yield f"Page {n + 1}", clean(pages.pages[n].extract_text() or "")


class FilteredReader(PagedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equalities and lists on path and location; all others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("path",), ("location",)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.only[name] = self.only.get(name, wanted) & wanted
            else:
                yield f


class PagedFiles(DataSource):
    """format("paged"): (path, location, text, error), a row for each page that has text, and for each file that is not read."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteredReader if self.options.get("pushFilters") == "true" else PagedReader)(self.options)
