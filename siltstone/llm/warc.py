"""WARC archives: a writer with revisit records, and a salvage reader.

The writer makes every record one gzip member and lets Spark's own text sink store the members back to back, so the
archives can go to any file system that Spark writes. The reader takes whole archive files (the writer bounds them by the shuffle's partitions),
checks every member and record, and after a failed check searches for the next gzip member or WARC version line,
recovers the later records, and reports each skipped byte range as a gap. Inside a member it resumes at the next version line; what a damaged
member still yields is kept where a record's own digest vouches for it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import workdir

VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member; its last byte is zero.
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
DATE = "2024-01-01T00:00:00Z"
LEAST = 1000


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    out = MAGIC + b"\x00\x00\x00\x00\x00\x00\xff" + body + (zlib.crc32(data) & 0xFFFFFFFF).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    return out if out[-1] == 0 else out + EMPTY


def record(page_id: int | str, url: str | None, payload: bytes, kind: str, refers: int | None, digest: str) -> bytes:
    """One WARC record. A revisit carries no payload, only the digest and length of the full one. A page without an id has a made-up one ("none-...")."""
    head = [b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(), b"WARC-Date: " + DATE.encode(), b"WARC-Payload-Digest: sha1:" + digest.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url).encode("utf-8", "replace"))
    body = payload
    if kind == "revisit":
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    head += [b"X-Payload-Length: %d" % len(payload), b"X-Block-Digest: sha1:" + hashlib.sha1(body).hexdigest().encode(), b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]
    return VERSION + b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


#: Parts that rows without an id are dealt to where they meet the heads of their payloads.
PARTS = 64


def roles(pages: DataFrame) -> DataFrame:
    """Adds payload_sha1, payload_bytes and (for revisits) refers_to to `pages` (page_id, url, html).

    Heads of equal payloads of at least LEAST bytes are found from digests alone; the page rows are shuffled once.
    Rows that repeat the head's own page_id are responses too. Null html is an empty payload. A row without an id revisits the head of its payload; where
    no row of that payload has an id, all are responses.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.withColumn("payload_sha1", F.sha1(body)).withColumn("payload_bytes", F.octet_length(body).cast("long"))
    small = keyed.filter(F.col("payload_bytes") >= LEAST).select("page_id", "payload_sha1", "payload_bytes")
    heads = small.groupBy("payload_sha1", "payload_bytes").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND head IS NOT NULL").drop("n")
    later = small.join(heads, ["payload_sha1", "payload_bytes"]).filter(F.col("page_id") < F.col("head")).select("page_id", "payload_sha1", F.col("head").alias("refers_to")).distinct()
    named = keyed.filter("page_id IS NOT NULL").join(later.hint("shuffle_hash"), ["page_id", "payload_sha1"], "left")
    # rows without an id, which may all hold one payload
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part")
    nameless = keyed.filter("page_id IS NULL").withColumn("_part", F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(PARTS)))
    wanted = heads.join(small.filter("page_id IS NULL").select("payload_sha1").distinct(), "payload_sha1", "left_semi")
    nameless = nameless.join(wanted.select("payload_sha1", F.col("head").alias("refers_to"), part), ["payload_sha1", "_part"], "left").drop("_part")
    return named.unionByName(nameless)


def write_warc(pages: DataFrame, path: str) -> None:
    """Write one record per row of `pages` (page_id, url, html) to archives in the new folder `path`. Null page_id: the record's id is made up.

    Archive size follows the shuffle's partition size. Repeated rows each give a record. An empty table writes archives without records. Other columns of
    `pages` are left out, whatever their names.
    """
    def members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, nameless = TaskContext.get().partitionId(), 0
        for p in parts:
            out = []
            for i, url, html, digest, head in zip(p["page_id"], p["url"], p["html"], p["payload_sha1"], p["refers_to"], strict=True):
                payload = (html or "").encode("utf-8")
                revisit = not pd.isna(head)
                if pd.isna(i):
                    i, nameless = f"none-{part}-{nameless}", nameless + 1
                # the sink ends every row with a zero byte: the last of the member's length field
                out.append(gzip_member(record(i, url, payload, "revisit" if revisit else "response", int(head) if revisit else None, digest))[:-1])
            yield pd.DataFrame({"member": out})

    rows = roles(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "payload_sha1", F.col("refers_to").cast("string").alias("refers_to"))
    # a string column carries the bytes as they are
    rows.mapInPandas(members, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        k, _, v = line.partition(b":")
        if not v:
            raise ValueError("malformed header line")
        out[k.strip().decode("latin-1").lower()] = v.strip().decode("utf-8", "replace")
    return out


#: Bytes within which a record's headers must end.
HEAD = 1 << 16
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")


def _record_at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int, bool]:
    """The record that starts at `at`: headers, block, end, and whether a digest vouches for the block. ValueError where a check fails."""
    m = VERSION_LINE.match(data, at)
    stop = data.find(b"\r\n\r\n", at, at + HEAD)
    if not m or stop < 0:
        raise ValueError("no version line")
    h = _headers(data[m.end() : stop])
    if not h.get("content-length", "").isdigit():
        raise ValueError("no length")
    end = stop + 4 + int(h["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block does not end where its length says")
    block = data[stop + 4 : end]
    want = h.get("x-block-digest") or (h.get("warc-payload-digest") if h.get("warc-type") != "revisit" and "http" not in h.get("content-type", "") else None)
    vouched = bool(want) and re.fullmatch(r"sha1:[0-9a-f]{40}", want.lower()) is not None
    if vouched and hashlib.sha1(block).hexdigest() != want.lower()[5:]:
        raise ValueError("block digest differs")
    return h, block, end + 4, vouched


def _gzip_head(data: bytes, at: int) -> int:
    """Where the compressed bytes of the gzip member at `at` begin."""
    if len(data) < at + 10:
        raise ValueError("truncated member")
    flags, k = data[at + 3], at + 10
    if flags & 0xE0:
        raise ValueError("reserved gzip flags")
    if flags & 4:
        k += 2 + int.from_bytes(data[k : k + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            k = data.find(b"\0", k, k + HEAD) + 1
            if not k:
                raise ValueError("gzip name without an end")
    return k + 2 if flags & 2 else k


def _member_at(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What the gzip member that starts at `at` holds, its end, and why it is damaged. A damaged one has no end, and holds what could be unpacked."""
    try:
        head = _gzip_head(data, at)
    except ValueError as e:
        return b"", None, str(e)
    view = memoryview(data)
    for step in (1 << 14, 64):  # small steps lose little where the bytes are damaged
        z, out, k = zlib.decompressobj(-15), [], head
        try:
            while not z.eof and k < len(data):
                out.append(z.decompress(view[k : k + step]))
                k += step
        except zlib.error as e:
            why = str(e)
            continue
        body, end = b"".join(out), min(k, len(data)) - len(z.unused_data) + 8
        if not z.eof or end > len(data):
            return body, None, "truncated member"
        if int.from_bytes(data[end - 8 : end - 4], "little") != zlib.crc32(body) or int.from_bytes(data[end - 4 : end], "little") != len(body) & 0xFFFFFFFF:
            return body, None, "member checksum differs"
        return body, end, ""
    return b"".join(out), None, why


def _inside(body: bytes, vouched_only: bool) -> Iterator[tuple[str, int, int, dict[str, str] | None, bytes | str]]:
    """Records and gaps of a member's content, with offsets in it. `vouched_only`: records without a digest are gaps."""
    at, bad, why = 0, None, ""
    while at < len(body):
        try:
            h, block, end, vouched = _record_at(body, at)
            if vouched_only and not vouched:
                raise ValueError("no digest in a damaged member")
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            m = VERSION_LINE.search(body, at + 1)
            at = m.start() if m else len(body)
            continue
        if bad is not None:
            yield "gap", bad, at, None, why
            bad = None
        yield "record", at, end, h, block
        at = end
    if bad is not None:
        yield "gap", bad, len(body), None, why


def salvage(data: bytes) -> Iterator[tuple[str, int, int, int | None, int | None, dict[str, str] | None, bytes | str]]:
    """("record", start, end, inner start, inner end, headers, block) and ("gap", start, end, inner start, inner end, None, reason) in order.

    Works on gzip members of any number of records, on plain records, and on a mixture. Start and end are those of the member or plain record in the archive;
    inner offsets those in a member's content (null for plain records, and for gaps of whole archive bytes). Damaged archive bytes
    go to one gap up to the next member or version line that passes its checks; vouched records of a damaged member come with that gap's start and end.
    """
    at, bad, why = 0, None, ""
    marks = {MAGIC: -1, b"WARC/1.": -1}  # where each mark is next; looked for again only once it is passed
    saved: list = []

    def gap(end: int) -> Iterator[tuple]:
        for a, b, h, block in saved:
            yield "record", bad, end, a, b, h, block
        yield "gap", bad, end, None, None, None, why

    while at < len(data):
        found, end, reason, body = [], None, "", None
        if data.startswith(MAGIC, at):
            body, end, reason = _member_at(data, at)
            if end is None:
                saved_here = [(a, b, h, x) for kind, a, b, h, x in _inside(body, True) if kind == "record"]
            else:
                found = [(kind, a, b, h, x) for kind, a, b, h, x in _inside(body, False)]
        else:
            saved_here = []
            try:
                h, block, end, _ = _record_at(data, at)
                found = [("record", None, None, h, block)]
            except ValueError as e:
                reason = str(e)
        if end is None:
            if bad is None:
                bad, why, saved = at, reason, []
            saved += saved_here
            for mark, last in marks.items():
                if last <= at:
                    k = data.find(mark, at + 1)
                    marks[mark] = k if k >= 0 else len(data)
            at = min(marks.values())
            continue
        if bad is not None:
            yield from gap(at)
            bad = None
        for kind, a, b, h, x in found:
            yield kind, at, end, a, b, h, x
        at = end
    if bad is not None:
        yield from gap(len(data))


SCHEMA = "archive string, kind string, start long, `end` long, inner_start long, inner_end long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary, reason string"


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record and gap of the archives under `path` (kind: record or gap). A revisit's payload is null; `payload=False` leaves all out."""
    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0].strip("`") for c in SCHEMA.split(", ")]
        for p in parts:
            for name, content in zip(p["path"], p["content"], strict=True):
                rows = []
                for kind, *at, h, block in salvage(bytes(content)):
                    if kind == "gap":
                        rows.append((name, kind, *at, *[None] * 7, block))
                        continue
                    t = h.get("warc-type")
                    n = h.get("x-payload-length", "")
                    rows.append((name, kind, *at, t, h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(n) if n.isdigit() else len(block), block if payload and t != "revisit" else None, None))
                    if len(rows) >= 2000:
                        yield pd.DataFrame(rows, columns=cols)
                        rows = []
                yield pd.DataFrame(rows, columns=cols)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, SCHEMA)


def page_of(column: str) -> Column:
    """The page id in a record id; null where it was made up."""
    number = F.regexp_extract(column, r"urn:page:(-?\d+)>", 1)
    return F.when(number != "", number).cast("long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    got = read_warc(spark, path, payload=False).filter("kind = 'record'")
    return got.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", page_of("refers_to")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS head FROM p),
r AS (SELECT *, n >= 1000 AND head IS NOT NULL AND (page_id IS NULL OR page_id < head) AS again FROM h)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN head END AS refers_to FROM r
"""
