"""File formats to text rows through Spark's own readers; and the registry of formats."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T

# The loaders of each format, first to last choice.
FORMATS = {
    "pdf": ["docling_serve", "pymupdf", "pypdf", "unstructured"],
    "docx": ["docling_serve", "docx", "unstructured"],
    "xlsx": ["xlsx", "docling_serve", "unstructured"],
    "xls": ["xlsx", "unstructured"],
    "pptx": ["pptx", "docling_serve", "unstructured"],
    "ppt": ["docling_serve", "unstructured"],
    "html": ["html", "unstructured"],
    "htm": ["html", "unstructured"],
    "csv": ["csv"],
    "json": ["json"],
    "txt": ["text"],
    "md": ["text"],
    "markdown": ["text"],
    "xml": ["xml", "unstructured"],
    "msg": ["msg", "unstructured"],
    "vtt": ["vtt"],
    "properties": ["properties"],
    "doc": ["doc", "unstructured"],
}
# Endings of files that are taken, and their greatest size.
UPLOADS = ("pdf", "doc", "docx", "txt", "md", "markdown", "xlsx", "xls", "pptx", "ppt", "html", "htm", "csv", "json", "xml", "rtf", "odt", "ods", "odp")
UPLOAD_BYTES = 52_428_800


def validate_upload(name: Column, size: Column) -> Column:
    """Why a file is not taken, or null: the ending of its name (of a name that begins with a dot, there is none), then its size, then that it is empty."""
    end = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/](\.[^./]+)$", 1))
    return (
        F.when(~F.substring(end, 2, 100).isin(*UPLOADS), F.concat(F.lit("Unsupported file format: "), end))
        .when(size > UPLOAD_BYTES, F.concat(F.lit("File size exceeds limit: "), size.cast("string"), F.lit(" bytes"))).when(F.coalesce(size, F.lit(0)) == 0, "Empty file not allowed")
    )


#: Loaders that run here; the others need libraries or services that are not installed.
AVAILABLE = ("csv", "json", "text", "xml", "html", "properties", "docx", "xlsx", "pptx")


def runs(fmt: str, loader: str) -> bool:
    """Whether a loader takes a format here: old binary workbooks need a library."""
    return loader in AVAILABLE and fmt != "xls"


def loader_registry(spark: SparkSession) -> DataFrame:
    """(format, turn, loader, available), one row a choice."""
    rows = [(f, i, x, runs(f, x)) for f, ls in FORMATS.items() for i, x in enumerate(ls)]
    return spark.createDataFrame(rows, "format string, turn long, loader string, available boolean")


def first_available(fmt: Column) -> Column:
    """The first loader of a format that runs here; null where there is none."""
    out = F.lit(None).cast("string")
    for f, ls in FORMATS.items():
        use = next((x for x in ls if runs(f, x)), None)
        out = F.when(F.lower(fmt) == f, F.lit(use)).otherwise(out)
    return out


def rendered(df: DataFrame, columns: list[str]) -> Column:
    """`name: value | name: value` of a row; nulls are empty."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header, as text; malformed lines are dropped."""
    df = spark.read.option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return df.select(rendered(df, df.columns).alias("text"))


def flattened(value: object, path: str = "") -> list[str]:
    """`a.b[0]: v` lines of a JSON value; booleans as True and False, null as null."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flattened(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in flattened(v, f"{path}[{i}]")]
    return [f"{path}: {'null' if value is None else value}"]


def scan_json_flatten(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row a line of each JSON text; a text that is no JSON gives none."""
    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            try:
                return flattened(json.loads(t)) if t else []
            except ValueError:
                return []

        return pd.Series([one(t) for t in x])

    return df.select(*keep, F.posexplode(run(column)).alias("i", "line")).withColumn("i", F.col("i").cast("long"))


def scan_xml(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Text of all elements depth first (text, then tail, stripped), with the number of elements; a text that is no XML gives nulls."""
    @F.pandas_udf("struct<text:string,elements:long>")
    def run(x: pd.Series) -> pd.DataFrame:
        rows = []
        for t in x:
            try:
                root = ET.fromstring(t or "")
            except ET.ParseError:
                rows.append((None, None))
                continue
            rows.append(("\n".join(s.strip() for s in root.itertext() if s.strip()), sum(1 for _ in root.iter())))
        return pd.DataFrame(rows, columns=["text", "elements"])

    return df.select(*keep, run(column).alias("r")).select(*keep, "r.*")


#: Fixed value: how a converter marks a picture that it could not take over.
BROKEN_IMAGE = "<!-- 🖼️❌ Image not available"


def placeholders(text: str, alt_chars: int = 500) -> str:
    """Pictures `![alt](source)` as `[IMAGE_n: alt]`, brackets in the source balanced; then every line up to the end of a broken picture's mark, which goes
    on in the numbering and takes the line's text as its alt. Pictures in such a line go with it; an empty alt reads 图片."""
    close, opened = {}, []
    for m in re.finditer("[()]", text):
        if m[0] == "(":
            opened.append(m.start())
        elif opened:
            close[opened.pop()] = m.end()
    found, at = [], 0
    while (at := text.find("![", at)) >= 0:
        middle = text.find("](", at, at + alt_chars + 2)
        end = close.get(middle + 1) if middle >= 0 else None
        if end:
            found.append((at, end, text[at + 2 : middle]))
        at = end or (middle if middle >= 0 else at) + 2
    at = 0
    while (at := text.find(BROKEN_IMAGE, at)) >= 0 and (stop := text.find("-->", at)) >= 0:
        begin = text.rfind("\n", 0, at) + 1
        found.append((begin, stop + 3, text[begin:at].strip()))
        at = stop + 3
    out, done = [], 0
    for n, (begin, end, alt) in sorted(enumerate(found, 1), key=lambda x: (x[1][0], -x[1][1])):
        if begin >= done:
            out += [text[done:begin], f"[IMAGE_{n}: {alt or '图片'}]"]
            done = end
    return "".join(out) + text[done:]


def images_to_placeholders(df: DataFrame, column: str = "text") -> DataFrame:
    """`df` with the pictures of a Markdown column as placeholders (see `placeholders`); null stays null."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(placeholders, na_action="ignore")

    return df.withColumn(column, run(column))


def scan_properties(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(key, value) of `k=v` or `k:v` lines; the equals sign wins; lines of # or ! are comments."""
    line = df.select(*keep, F.posexplode(F.split(column, "\n")).alias("line_no", "line")).withColumn("line", T.strip(F.col("line")))
    line = line.filter((F.col("line") != "") & ~F.col("line").rlike("^[#!]") & F.col("line").rlike("[=:]"))
    sep = F.when(F.col("line").contains("="), "=").otherwise(":")
    at = F.when(F.col("line").contains("="), F.locate("=", F.col("line"))).otherwise(F.locate(":", F.col("line")))
    return line.select(*keep, F.col("line_no").cast("long").alias("line_no"), T.strip(F.substring("line", F.lit(1), at - 1)).alias("key"), T.strip(F.substring("line", at + 1, F.length("line"))).alias("value"), sep.alias("sep"))


def extraction_quality(level: Column, has_tables: Column, has_images: Column, empty: Column) -> Column:
    base = F.when(level == "high", 0.9).when(level == "medium", 0.75).when(level == "fast", 0.6).otherwise(0.4)
    return F.when(empty, F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), base + F.when(has_tables, 0.05).otherwise(0.0) + F.when(has_images, 0.02).otherwise(0.0)), 6))
