"""Markdown as Word files: parsed into blocks by Column functions, written by a data source that makes one file of a row.

    spark.dataSource.register(WordFiles)
    df.select("name", "title", markdown_blocks("markdown").alias("blocks")).write.format("word").mode("append").save(folder)
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import Column, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lexquarry.functions.text import strip

#: What a row holds: file name without its ending, title, and the blocks of markdown_blocks().
SCHEMA = "name string, title string, blocks array<struct<kind:string,level:int,cells:array<array<struct<text:string,bold:boolean,italic:boolean>>>>>"
FOOTER = "Legal information to help you understand your documents, not legal advice."

#: How a line of each kind begins, in the order in which they are tried; the rest of it is the text.
KINDS = [("table", r"^(?=\|)"), ("heading", r"^#{1,4}\s+"), ("bullet", r"^[-*+]\s+"), ("numbered", r"^\d+[.)]\s+"), ("quote", r"^>[> ]*")]
#: Fixed value: the row that divides a table's head from its body.
DIVIDER = r"^\|?\s*:?-{3,}"
#: Bold and italic runs and what lies between them.
RUN = r"\*\*[^*]+\*\*|\*[^*]+\*|[^*]+|\*"


def runs(text: Column) -> Column:
    """Structs (text, bold, italic) of a line in order."""

    def one(part: Column) -> Column:
        bold, italic = part.rlike(r"^\*\*[^*]+\*\*$"), part.rlike(r"^\*[^*]+\*$")
        return F.struct(F.when(bold | italic, F.regexp_replace(part, r"^\*+|\*+$", "")).otherwise(part).alias("text"), bold.alias("bold"), italic.alias("italic"))

    return F.transform(F.regexp_extract_all(text, F.lit(RUN), 0), one)


def markdown_blocks(markdown: Column | str) -> Column:
    """Structs (kind, level, cells) for the lines of a Markdown text: headings (level 3 at most), bullets, numbered lines, quotes,
    table rows and paragraphs, each with the runs of its cells; blank lines, which end a table, are of kind blank. Divider rows
    are dropped, unless one begins its table. A null text has none."""
    text = F.coalesce(F.col(markdown) if isinstance(markdown, str) else markdown, F.lit(""))
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip)

    def block(line: Column) -> Column:
        kind, rest, level = F.lit("paragraph"), line, F.lit(0)
        for name, begin in reversed(KINDS):
            kind, rest = F.when(line.rlike(begin), name).otherwise(kind), F.when(line.rlike(begin), F.regexp_replace(line, begin, "")).otherwise(rest)
        level = F.when(kind == "heading", F.least(F.lit(3), F.length(F.regexp_extract(line, "^#{1,4}", 0)))).otherwise(0)
        cells = F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|")
        texts = F.when(kind == "table", F.transform(cells, lambda c: runs(strip(c)))).otherwise(F.array(runs(rest)))
        return F.struct(F.when(line == "", "blank").otherwise(kind).alias("kind"), level.cast("int").alias("level"), texts.alias("cells"))

    kept = F.filter(lines, lambda line, i: ~(line.rlike(DIVIDER) & line.startswith("|") & (i > 0) & F.coalesce(F.get(lines, i - 1).startswith("|"), F.lit(False))))
    return F.transform(kept, block)


NAMESPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = {"heading": "Heading{}", "bullet": "ListBullet", "numbered": "ListNumber", "quote": "Quote", "title": "Title"}


def _paragraph(text_runs, style: str | None = None) -> str:
    def run(text, bold, italic) -> str:
        look = "<w:b/>" * bool(bold) + "<w:i/>" * bool(italic)
        clean = "".join(c for c in text if c >= " " or c == "\t")  # what XML cannot hold
        return f'<w:r>{f"<w:rPr>{look}</w:rPr>" if look else ""}<w:t xml:space="preserve">{escape(clean)}</w:t></w:r>'

    return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}{"".join(run(*r) for r in text_runs)}</w:p>'


def _table(rows) -> str:
    width = max(len(cells) for cells in rows)
    cell = lambda own: f"<w:tc>{_paragraph(own)}</w:tc>"
    body = "".join(f"<w:tr>{''.join(map(cell, [*cells, *[[]] * (width - len(cells))]))}</w:tr>" for cells in rows)
    return f'<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/></w:tblPr><w:tblGrid>{"<w:gridCol/>" * width}</w:tblGrid>{body}</w:tbl>'


def docx(title: str, blocks) -> bytes:
    """A Word file: the title, the blocks, rows of one table together, and the footer."""
    body = [_paragraph([(title, False, False)], STYLES["title"])]
    for kind, own in groupby(blocks, key=lambda b: b.kind):
        if kind == "table":
            body.append(_table([b.cells for b in own]))
        elif kind != "blank":
            body += [_paragraph(b.cells[0], STYLES.get(kind, "").format(b.level) or None) for b in own]
    body.append(_paragraph([(FOOTER, False, True)]))
    kinds = ["Title", *[f"Heading{n}" for n in (1, 2, 3)], "ListBullet", "ListNumber", "Quote"]
    lists = {"ListBullet": 1, "ListNumber": 2}
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{k}"><w:name w:val="{k}"/>{f"""<w:pPr><w:numPr><w:numId w:val="{lists[k]}"/></w:numPr></w:pPr>""" if k in lists else ""}</w:style>' for k in kinds)
    numbers = "".join(f'<w:abstractNum w:abstractNumId="{n}"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{sign}"/></w:lvl></w:abstractNum>' for n, fmt, sign in ((1, "bullet", "•"), (2, "decimal", "%1.")))
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    types = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    relation = lambda n, kind, target: f'<Relationship Id="r{n}" Type="{kind}" Target="{target}"/>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        + "".join(f'<Override PartName="/word/{n}.xml" ContentType="{types}.{k}+xml"/>' for n, k in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering")))
        + '<Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships">{relation(1, f"{office}/officeDocument", "word/document.xml")}{relation(2, f"{package}/relationships/metadata/core-properties", "docProps/core.xml")}</Relationships>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{package}/relationships">{relation(1, f"{office}/styles", "styles.xml")}{relation(2, f"{office}/numbering", "numbering.xml")}</Relationships>',
        "word/document.xml": f"<w:document {NAMESPACE}><w:body>{''.join(body)}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {NAMESPACE}>{styles}<w:style w:type="table" w:styleId="TableGrid"><w:name w:val="Table Grid"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {NAMESPACE}>{numbers}{"".join(f"""<w:num w:numId="{n}"><w:abstractNumId w:val="{n}"/></w:num>""" for n in (1, 2))}</w:numbering>',
        "docProps/core.xml": f'<cp:coreProperties xmlns:cp="{package}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></cp:coreProperties>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, part in parts.items():
            archive.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{part}')
    return out.getvalue()


@dataclass
class Staged(WriterCommitMessage):
    folder: str | None
    files: int


class WordWriter(DataSourceWriter):
    """Each attempt of a task writes to a folder of its own below _staged; commit moves those of the attempts that count, as one
    folder each, and abort leaves nothing."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def places(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else f"/{self.path}")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = self.places()
        folder, names = f"{root}/_staged-{self.job}/{uuid.uuid4().hex}", {}
        for row in iterator:
            if not names:
                store.create_dir(folder)
            name = (row.name or "document").replace("/", "_")
            names[name] = n = names.get(name, 0) + 1
            with store.open_output_stream(f"{folder}/{name}{f' ({n})' if n > 1 else ''}.docx") as out:
                out.write(docx(row.title or "", row.blocks or []))
        return Staged(folder if names else None, sum(names.values()))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self.places()
        store.create_dir(root)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.base_name.startswith("part-"):
                    store.delete_dir(old.path)
        for n, message in enumerate(messages):
            if message is not None and message.folder is not None:
                store.move(message.folder, f"{root}/part-{n:05}-{self.job}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self.places()
        if store.get_file_info(f"{root}/_staged-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_staged-{self.job}")


class WordFiles(DataSource):
    """format("word"): a .docx file for each row, in folders part-* of the path. Repeated names within a part get a number."""

    @classmethod
    def name(cls) -> str:
        return "word"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"name", "title", "blocks"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        return WordWriter(self.options["path"], overwrite)
