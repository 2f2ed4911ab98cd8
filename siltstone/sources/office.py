"""Office files (zipped XML) to text, pages and tables: rows of `binaryFile` are read one file at a time inside Spark's tasks."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one unpacked part, and cells of one sheet (empty ones too), beyond which a file gives an error row.
PART_BYTES, CELLS = 1 << 28, 5_000_000
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "path string, kind string, page_number int, title string, text string, headers array<string>, rows array<array<string>>"


class Package:
    """The parts of one Office file. Parts with a document type declaration, or in UTF-16, are refused: entities could blow them up."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element:
        with self.zip.open(name) as f:
            body = f.read(PART_BYTES + 1)
        if len(body) > PART_BYTES:
            raise ValueError(f"{name} is over {PART_BYTES} bytes")
        if b"<!DOCTYPE" in body or body[:2] in (b"\xff\xfe", b"\xfe\xff"):
            raise ValueError(f"{name} has a document type declaration or is not in UTF-8")
        return ET.fromstring(body)

    def targets(self, name: str) -> dict[str, str]:
        """Parts that a part points to, by relation id."""
        folder, _, base = name.rpartition("/")
        at = f"{folder}/_rels/{base}.rels"
        if at not in self.names:
            return {}
        return {r.get("Id"): posixpath.normpath(posixpath.join("/" + folder, r.get("Target"))).lstrip("/") for r in self.xml(at) if r.get("TargetMode") != "External"}


def kind(e: ET.Element) -> str:
    """Name of an element without its namespace."""
    return e.tag.rpartition("}")[2]


def value(c: ET.Element, shared: list[str]) -> str:
    """A cell as text: numbers as Python writes them, dates as their serial number, no value as empty."""
    v, t = c.findtext("{*}v"), c.get("t", "n")
    if t == "inlineStr":
        return "".join(x.text or "" for x in c.iterfind("{*}is//{*}t"))
    if v is None:
        return ""
    if t == "s":
        return shared[int(v)]
    if t == "b":
        return str(v == "1")
    if t != "n":
        return v
    try:
        return str(float(v)) if re.search("[.eE]", v) else str(int(v))
    except ValueError:
        return v


def sheets(p: Package) -> Iterator[tuple[int, str, list[list[str]]]]:
    """(number, name, rows) of every sheet with cells; rows are as wide as the widest, and missing ones empty."""
    shared = ["".join(x.text or "" for e in si if kind(e) in ("t", "r") for x in ([e] if kind(e) == "t" else e.iterfind("{*}t"))) for si in (p.xml("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in p.names else ())]
    at = p.targets("xl/workbook.xml")
    for number, sheet in enumerate(p.xml("xl/workbook.xml").iterfind("{*}sheets/{*}sheet"), 1):
        cells, row = {}, 0
        for r in p.xml(at[sheet.get(RELATION)]).iterfind("{*}sheetData/{*}row"):
            row, column = int(r.get("r", row + 1)), 0
            for c in r.iterfind("{*}c"):
                column += 1
                if letters := re.match("[A-Z]+", c.get("r", "")):
                    column = 0
                    for x in letters[0]:
                        column = column * 26 + ord(x) - 64
                cells[row, column] = value(c, shared)
        if not cells:
            continue
        high, wide = max(r for r, _ in cells), max(c for _, c in cells)
        if high * wide > CELLS:
            raise ValueError(f"sheet {number} spans over {CELLS} cells")
        yield number, sheet.get("name"), [[cells.get((r, c), "") for c in range(1, wide + 1)] for r in range(1, high + 1)]


def workbook(p: Package) -> Iterator[tuple]:
    """A page of tab-separated lines and a table for every sheet; the whole text joins the pages."""
    pages = []
    for number, name, (headers, *rows) in sheets(p):
        pages.append(f"Sheet: {name}\n" + "".join("\t".join(r) + "\n" for r in [headers, *rows]))
        yield "page", number, name, pages[-1], None, None
        yield "table", number, name, None, headers, rows
    yield "document", None, None, "\n\n".join(pages), None, None


def slide_text(paragraph: ET.Element) -> str:
    return "".join("\v" if kind(e) == "br" else e.findtext("{*}t") or "" for e in paragraph if kind(e) in ("r", "br", "fld"))


def presentation(p: Package) -> Iterator[tuple]:
    """A page of the paragraphs of a slide's own shapes, and its tables; groups of shapes are not opened."""
    at, pages = p.targets("ppt/presentation.xml"), []
    for number, s in enumerate(p.xml("ppt/presentation.xml").iterfind("{*}sldIdLst/{*}sldId"), 1):
        parts = []
        for shape in p.xml(at[s.get(RELATION)]).iterfind("{*}cSld/{*}spTree/*"):
            parts += [t for x in shape.iterfind("{*}txBody/{*}p") if (t := slide_text(x).strip())] if kind(shape) == "sp" else []
            for table in shape.iterfind("{*}graphic/{*}graphicData/{*}tbl"):
                rows = [["\n".join(slide_text(x) for x in c.iterfind("{*}txBody/{*}p")).strip() for c in r.iterfind("{*}tc")] for r in table.iterfind("{*}tr")]
                yield "table", number, None, None, rows[0] if rows else [], rows[1:]
        text = "\n".join(parts)
        pages.append(f"Slide {number}:\n{text}")
        yield "page", number, None, text, None, None
    yield "document", None, None, "\n\n".join(pages), None, None


def run_text(paragraph: ET.Element) -> str:
    """Text of a Word paragraph's runs and links; page breaks are left out."""
    out = []
    for run in (r for e in paragraph for r in ([e] if kind(e) == "r" else e if kind(e) == "hyperlink" else ()) if kind(r) == "r"):
        for e in run:
            k = kind(e)
            out.append(e.text or "" if k == "t" else "\t" if k in ("tab", "ptab") else "-" if k == "noBreakHyphen" else "\n" if k == "cr" or k == "br" and next((v for n, v in e.items() if n.endswith("}type")), "textWrapping") == "textWrapping" else "")
    return "".join(out)


def word_rows(table: ET.Element) -> list[list[str]]:
    """Cell texts of a Word table; a cell over several columns or rows is repeated in each."""
    rows: list[list[str]] = []
    for r in table.iterfind("{*}tr"):
        row: list[str] = []
        for c in r.iterfind("{*}tc"):
            span, merge = c.find("{*}tcPr/{*}gridSpan"), c.find("{*}tcPr/{*}vMerge")
            text = "\n".join(run_text(x) for x in c.iterfind("{*}p")).strip()
            if merge is not None and rows and len(rows[-1]) > len(row) and not any(v == "restart" for v in merge.attrib.values()):
                text = rows[-1][len(row)]
            row += [text] * int(next(iter(span.attrib.values()), 1) if span is not None else 1)
        rows.append(row)
    return rows


def word_document(p: Package) -> Iterator[tuple]:
    """Paragraphs, pictures as placeholders, and tables as Markdown, in the order of the body: one page."""
    blocks, pictures = [], 0
    for e in p.xml("word/document.xml").iterfind("{*}body/*"):
        if kind(e) == "p":
            if (t := run_text(e)).strip():
                blocks.append(t)
            for drawing in e.iter():
                if kind(drawing) == "drawing" and drawing.find(".//{*}blip") is not None:
                    pictures += 1
                    about = drawing.find(".//{*}docPr")
                    blocks.append(f"[IMAGE_{pictures}: {(about is not None and (about.get('descr') or about.get('name'))) or '图片'}]")
        elif kind(e) == "tbl" and (rows := word_rows(e)):
            headers = rows[0]
            lines = [headers, ["---"] * len(headers), *[(r + [""] * len(headers))[: len(headers)] for r in rows[1:]]]
            blocks.append("\n".join("| " + " | ".join(r) + " |" for r in lines))
            yield "table", 1, None, None, headers, rows[1:]
    text = "\n\n".join(blocks)
    yield "page", 1, None, text, None, None
    yield "document", None, None, text, None, None


def framed(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["path", "kind", "page_number", "title", "text", "headers", "rows"])
    return out.assign(page_number=out["page_number"].astype("Int32"))


READERS = {"docx": word_document, "xlsx": workbook, "pptx": presentation}


def read_office(files: DataFrame, fmt: str, path: str = "path", content: str = "content") -> DataFrame:
    """(path, kind, page_number, title, text, headers, rows) of every file of `files`: rows of kind page and table, and one of kind document with the whole text.

    A file that cannot be read (null or empty content too) gives one row of kind error whose text says why. Other columns of `files` are left out;
    repeated rows each give their rows; an empty table gives none.
    """
    reader = READERS[fmt]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, size = [], 0
        for q in parts:
            for name, body in zip(q["path"], q["content"], strict=True):
                try:
                    rows = list(reader(Package(bytes(body or b""))))
                except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError, OSError, EOFError, NotImplementedError, RuntimeError) as e:
                    rows = [("error", None, None, f"{type(e).__name__}: {e}", None, None)]
                done += [(name, *r) for r in rows]
                size += len(body or b"")
                if len(done) >= 256 or size > 1 << 20:
                    yield framed(done)
                    done, size = [], 0
        yield framed(done)

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInPandas(run, SCHEMA)


def scan_office(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """`read_office` of all files of a format under a folder that Spark reads."""
    return read_office(spark.read.format("binaryFile").option("pathGlobFilter", f"*.{fmt}").option("recursiveFileLookup", "true").load(path), fmt)


def zipped(parts: dict[str, str]) -> bytes:
    """An Office file of the given parts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()
