"""Loading files whatever their format: encodings in turn, and a chain of loaders with a timeout for each attempt.

Files come as rows of Spark's `binaryFile` source (path, length, content), so any store that Spark reads will do. A file is read whole in one row; the chain of a
format is a small table that is broadcast, and the attempts run where the row is.
"""

from __future__ import annotations

import csv
import io
import json
import signal
import threading
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import files as S
from siltstone.sources import html, office

#: Encodings in turn; the last takes any bytes.
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")
#: Seconds of an attempt, and of one on a file over LARGE bytes; characters that a result needs more than.
TIMEOUT, LARGE_TIMEOUT, LARGE, LEAST = 120.0, 600.0, 5 << 20, 10
#: Bytes of a picture from which it is a file of its own and not part of the text.
INLINE = 50 * 1024


def decode(content: bytes) -> tuple[str, str]:
    """Text and encoding: the first that takes all bytes. Line ends become newlines."""
    for name in ENCODINGS:
        try:
            text = content.decode(name)
        except UnicodeDecodeError:
            continue
        return text.replace("\r\n", "\n").replace("\r", "\n"), name
    raise AssertionError("latin-1 takes any bytes")


def extension(path: Column) -> Column:
    """Lower-case ending of a path's last part; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def scan_text(content: DataFrame) -> DataFrame:
    """(path, format, text, encoding, line_count, file_size) of text files (path, content); format txt without an ending. Null content is empty."""
    @F.pandas_udf("text string, encoding string")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(bytes(b) if b is not None else b"") for b in x], columns=["text", "encoding"])

    rows = content.select("path", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("file_size"), run("content").alias("_t"))
    fmt = F.when(extension(F.col("path")) == "", "txt").otherwise(extension(F.col("path")))
    return rows.select("path", fmt.alias("format"), "_t.text", "_t.encoding", (F.regexp_count("_t.text", F.lit("\n")) + 1).cast("long").alias("line_count"), "file_size")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of all files under a folder that have bytes: Spark's source leaves empty ones out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def _csv(content: bytes) -> str:
    rows = list(csv.reader(io.StringIO(decode(content)[0])))
    if not rows:
        raise ValueError("no header")
    return "\n".join(" | ".join(f"{h}: {v}" for h, v in zip(rows[0], r, strict=False)) for r in rows[1:] if len(r) == len(rows[0]))


def _xml(content: bytes) -> str:
    return "\n".join(s.strip() for s in ET.fromstring(content).itertext() if s.strip())


def _office(fmt: str) -> Callable[[bytes], str]:
    def load(content: bytes) -> str:
        return next(r[3] for r in office.READERS[fmt](office.Package(content)) if r[0] == "document")

    return load


#: Loaders that run here, by name: bytes to text, or an exception with the reason.
LOADERS: dict[str, Callable[[bytes], str]] = {
    "text": lambda b: decode(b)[0],
    "csv": _csv,
    "json": lambda b: "\n".join(S.flattened(json.loads(decode(b)[0]))),
    "xml": _xml,
    "html": lambda b: html.plain_text(html.parse(decode(b)[0])),
    "properties": lambda b: decode(b)[0],
    **{fmt: _office(fmt) for fmt in office.READERS},
}


class TimedOut(Exception):
    pass


def within(seconds: float, work: Callable[[], str]) -> str:
    """The result of `work`, or TimedOut. In a worker's main thread an alarm interrupts it; elsewhere the caller goes on without it."""
    message = f"timed out after {seconds:g} s"
    if threading.current_thread() is threading.main_thread():
        def ring(*_: object) -> None:
            raise TimedOut(message)

        before = signal.signal(signal.SIGALRM, ring)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return work()
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
    out: list = []

    def keep() -> None:
        try:
            out.append(work())
        except Exception as e:  # handed to the caller below
            out.append(e)

    t = threading.Thread(target=keep, daemon=True)
    t.start()
    t.join(seconds)
    if not out:
        raise TimedOut(message)
    if isinstance(out[0], Exception):
        raise out[0]
    return out[0]


def loader_chains(spark: SparkSession, loaders: tuple[str, ...] = tuple(LOADERS)) -> DataFrame:
    """(format, chain, available): the loaders of each format in order, and those of them that run. At most one row a format."""
    rows = [(f, ls, [x for x in ls if x in loaders and not (f == "xls" and x == "xlsx")]) for f, ls in S.FORMATS.items()]
    return spark.createDataFrame(rows, "format string, chain array<string>, available array<string>")


RESULT = "success boolean, loader string, text string, fallback_used boolean, fallback_reason string, original_parser string, error string, attempts array<struct<loader:string,error:string,seconds:double>>"


def load_with_fallback(content: DataFrame, preferred: str | None = None, fallback: bool = True, timeout: float = TIMEOUT, loaders: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, format, result): each file (path, content) goes to the loaders of its format until one gives a valid result.

    A result is valid if its text has more than LEAST characters. `preferred` is tried first; without `fallback` only the first loader of the chain is. An attempt may take `timeout` seconds (LARGE_TIMEOUT, if
    that is more, for files over LARGE bytes). result: success; the loader; where the first loader failed, fallback_used and why; else the error. attempts
    says of every try what it took and why it failed. Formats without loaders, and formats none of whose loaders runs here, are errors of their own. Null content is empty.
    """
    known = loaders or LOADERS
    chains = loader_chains(content.sparkSession, tuple(known))
    rows = content.select("path", "content", extension(F.col("path")).alias("format")).join(F.broadcast(chains), "format", "left")

    def one(chain: list[str] | None, fmt: str, body: bytes) -> tuple:
        if chain is None:
            return False, "unknown", None, False, None, None, f"Unsupported format: {fmt}", []
        order = ([preferred] if preferred else []) + [x for x in chain if x != preferred]
        order = [x for x in (order if fallback else order[:1]) if x in known and not (fmt == "xls" and x == "xlsx")]
        if not order:
            return False, "none", None, False, None, None, "No available loaders for this format", []
        limit = max(timeout, LARGE_TIMEOUT) if len(body) > LARGE else timeout
        tried: list[tuple] = []
        for name in order:
            began = time.monotonic()
            try:
                text = within(limit, lambda name=name: known[name](body))
                problem = None if len(text) > LEAST else "Invalid result (empty or no content)"
            except Exception as e:  # any loader's failure is a reason to go on
                text, problem = None, f"{type(e).__name__}: {e}"
            tried.append((name, problem, time.monotonic() - began))
            if problem is None:
                used = len(tried) > 1
                return True, name, text, used, f"Primary parser ({order[0]}) failed: {tried[0][1]}" if used else None, order[0] if used else None, None, tried
        return False, order[-1], None, False, None, None, "All parsers failed", tried

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [(r.path, r.format, *one(None if r.chain is None else list(r.chain), r.format, bytes(r.content or b""))) for r in p.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["path", "format", "success", "loader", "text", "fallback_used", "fallback_reason", "original_parser", "error", "attempts"])

    return rows.select("path", "format", "chain", "content").mapInPandas(run, f"path string, format string, {RESULT}")


def image_type(content: Column) -> Column:
    """MIME type by the leading bytes of a picture; null where they are none that is known."""
    # Leading bytes.
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(head.startswith("424D"), "image/bmp").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image/tiff")
    )


def image_store_policy(pictures: DataFrame, inline: int = INLINE) -> DataFrame:
    """(path, mime, bytes, store, data, file_name) of pictures (path, content): up to `inline` bytes they go into the result as Base64, larger ones to a file named by their SHA-256.

    Pictures of no known type and empty or null ones are skipped: store is `skip`."""
    n = F.coalesce(F.length("content"), F.lit(0)).cast("long")
    mime = image_type(F.col("content"))
    x = pictures.select("path", mime.alias("mime"), n.alias("bytes"), "content")
    store = F.when(F.col("mime").isNull(), "skip").when(F.col("bytes") <= inline, "inline").otherwise("file")
    name = F.concat(F.sha2("content", 256), F.lit("."), F.substring_index("mime", "/", -1))
    return x.withColumn("store", store).select("path", "mime", "bytes", "store", F.when(F.col("store") == "inline", F.translate(F.base64("content"), "\r\n", "")).alias("data"), F.when(F.col("store") == "file", name).alias("file_name"))
