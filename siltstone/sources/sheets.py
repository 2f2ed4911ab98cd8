"""Workbooks that a remote converter turned into one Markdown text: the names of their sheets, and the text dealt to them.

The converter's answer is a JSON document; names and text are read in an Arrow function, a row at a time and without shuffles.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The mark of a sheet, and the forms of headings, tables and gaps.
MARK = "sheet:"
HEADING = re.compile(r"^##\s+[Ss]heet:\s*(.+)$", re.MULTILINE)
TABLES = re.compile(r"(?:\|[^\n]+\n)+")
WIDE_GAP, GAP = re.compile(r"\n\s*\n\s*\n"), re.compile(r"\n\n+")


def _items(value: object, *names: str) -> list[dict]:
    """The first non-empty list under one of `names` of a JSON object; only its objects."""
    if isinstance(value, dict):
        for n in names:
            if isinstance(value.get(n), list) and value[n]:
                return [x for x in value[n] if isinstance(x, dict)]
    return []


def _said(x: dict, *names: str) -> str:
    return next((str(x[n]) for n in names if x.get(n)), "")


def _marked(name: str) -> str | None:
    return name[len(MARK) :].strip() if name.lower().startswith(MARK) else None


def _object(value: object) -> dict:
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            value = {}
    return value if isinstance(value, dict) else {}


def sheet_names(answer: object, markdown: str = "") -> list[str]:
    """Distinct names in order, from the first of four places that has any: the structured document (its groups, else its furniture), groups of the answer, headings
    of the text, and sections."""
    answer = _object(answer)
    inside = _object(answer.get("json_content") or answer.get("json") or {})

    def from_groups(of: object) -> Iterator[str | None]:
        yield from (_marked(_said(g, "name", "label")) for g in _items(of, "groups"))

    def from_furniture() -> Iterator[str | None]:
        yield from (_said(x, "text", "name") for x in _items(inside.get("furniture"), "children", "items") if "sheet" in _said(x, "label").lower())

    def from_sections() -> Iterator[str | None]:
        for x in _items(answer, "sections", "items"):
            name = _said(x, "name", "title")
            if (own := _marked(name)) is not None:
                yield own
            elif "sheet" in _said(x, "type", "label").lower():
                yield name

    places = (from_groups(inside), from_furniture(), from_groups(answer if _items(answer, "groups") else answer.get("body")), (m.strip() for m in HEADING.findall(markdown or "")), from_sections())
    for place in places:
        if names := list(dict.fromkeys(n for n in place if n)):
            return names
    return []


def dealt(parts: list[str], n: int) -> list[str]:
    """`parts` in n runs of even length, the first ones longer by one where it does not come out even; with fewer parts than runs the last are empty."""
    each, more = divmod(len(parts), n)
    edges = [i * each + min(i, more) for i in range(n + 1)]
    return ["\n\n".join(parts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def split_by_sheets(text: str, names: list[str]) -> list[tuple[int, str, str, int]]:
    """(page_number, sheet_name, text, char_count) of each sheet: the tables of the text, if there is one a sheet; else what wide gaps part, if that comes out; else its paragraphs dealt out evenly."""
    tables = TABLES.findall(text)
    if len(tables) == len(names):
        return [(i, n, t.strip(), len(t)) for i, (n, t) in enumerate(zip(names, tables, strict=True), 1)]
    wide, narrow = ([p.strip() for p in gap.split(text) if p.strip()] for gap in (WIDE_GAP, GAP))
    pages = wide if len(wide) == len(names) else dealt(narrow, len(names)) if names else []
    return [(i, n, t, len(t)) for i, (n, t) in enumerate(zip(names, pages, strict=True), 1)]


def split_excel_by_sheets(books: DataFrame, keep: tuple[str, ...] = ("doc_id",), answer: str = "answer", text: str = "text") -> DataFrame:
    """(keep, page_number, sheet_name, text, char_count) of workbooks (keep, answer: JSON text, text: Markdown). A book without sheet names, and a null text, give no rows."""
    @F.pandas_udf("array<struct<page_number:int,sheet_name:string,text:string,char_count:long>>")
    def run(answers: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([split_by_sheets(t, sheet_names(a, t)) if t is not None else [] for a, t in zip(answers, texts, strict=True)])

    return books.select(*keep, F.inline(run(answer, text)))
