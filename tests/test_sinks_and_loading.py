"""Sinks that publish all or nothing, and loading from real files."""

import json
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone.operators.storage import shared_folder
from siltstone.sources import loading as L
from siltstone.sources import office
from siltstone.sources import sinks as K


def plain(path):
    return Path(path.removeprefix("file://"))


def results(spark, n, day="2024-01-0"):
    return spark.range(n).repartition(3).select(F.concat(F.lit(day), (F.col("id") % 2 + 1).cast("string")).alias("day"), F.format_string("embedding_%03d.json", "id").alias("file_name"), F.to_json(F.struct("id")).alias("body"))


def test_results_become_visible_together(spark):
    path = shared_folder(spark, "results")
    assert K.read_results(spark, path).count() == K.list_result_files(spark, path).count() == 0
    K.sink_json(results(spark, 40), path)
    K.sink_json(results(spark, 3, "2024-02-0"), path)
    got = K.read_results(spark, path).collect()
    assert len(got) == 43 and sorted(json.loads(r["body"])["id"] for r in got if r["day"] < "2024-02") == list(range(40))
    names = sorted(os.listdir(plain(path)))
    assert len(names) == 2 and all(n.startswith("batch=") for n in names)
    assert sorted(os.listdir(plain(path) / names[0]) + os.listdir(plain(path) / names[1])) == ["day=2024-01-01", "day=2024-01-02", "day=2024-02-01", "day=2024-02-02"]
    K.sink_json(results(spark, 0), path)
    assert sorted(os.listdir(plain(path))) == names


def test_a_failed_write_leaves_nothing(spark):
    path = shared_folder(spark, "results")
    K.sink_json(results(spark, 4), path)
    before = sorted(os.listdir(plain(path)))
    broken = results(spark, 200).withColumn("day", F.when(F.col("file_name") == "embedding_150.json", "no day").otherwise(F.col("day")))
    with pytest.raises(Exception, match="not a day"):
        K.sink_json(broken, path)
    assert sorted(os.listdir(plain(path))) == before and K.read_results(spark, path).count() == 4


def test_listing_is_newest_first(spark):
    path = shared_folder(spark, "results")
    K.sink_json(results(spark, 30), path)
    got = K.list_result_files(spark, path, "2024-01-02", limit=3).orderBy("place").collect()
    assert [(r["place"], r["file_name"]) for r in got] == [(1, "embedding_029.json"), (2, "embedding_027.json"), (3, "embedding_025.json")]
    assert K.list_result_files(spark, path, limit=2).count() == 4


RECORDS = "result_id long, document_id long, model string, created_at long"


def write(spark, store, rows, between=lambda table: None):
    df = spark.createDataFrame(rows, RECORDS)
    return K.sink_dual_write(store, df, df.select("result_id", (F.col("result_id") * 10).alias("payload")), between)


def state(store):
    return sorted(r["result_id"] for r in store.read("records").collect()), sorted((r["result_id"], r["payload"]) for r in store.read("payloads").collect())


def test_two_tables_stand_or_fall_together(spark):
    store = K.Publication(spark, shared_folder(spark, "dual"))
    assert store.read("records") is None and store.version() == 0
    # of one write the latest counts; ties to the greater id; null keys are keys
    assert write(spark, store, [(1, 1, "m", 5), (2, 1, "m", 9), (3, 1, "m", 9), (4, 2, "m", 1), (5, None, "m", 1)]) == 1
    first = ([3, 4, 5], [(3, 30), (4, 40), (5, 50)])
    assert state(store) == first

    def fail(table):
        if table == "records":
            raise OSError("disk full")

    with pytest.raises(OSError):
        write(spark, store, [(9, 1, "m", 99)], fail)
    assert state(store) == first and store.version() == 1
    assert len([n for n in os.listdir(plain(store.root)) if n.startswith("version-")]) == 1
    # a later write takes the place of earlier records, whatever their time; their payloads go
    assert write(spark, store, [(6, 1, "m", 1), (7, None, "m", 0), (8, 3, None, 0)]) == 2
    assert state(store) == ([4, 6, 7, 8], [(4, 40), (6, 60), (7, 70), (8, 80)])
    with pytest.raises(K.PublishError):
        store.publish({"records": store.read("records")}, start=1)
    assert store.version() == 2
    store.clean(keep=1)
    assert state(store)[0] == [4, 6, 7, 8]
    assert sorted(n.split("-")[0] for n in os.listdir(plain(store.root)) if not n.startswith(".")) == ["manifest", "version"]


def test_text_files_in_each_encoding(spark, tmp_path):
    said = {"a.txt": "héllo\r\nwörld\rend".encode(), "b.TXT": "中文\n文件".encode("gbk"), "c": b"caf\xe9", "d.md": b"", "e.txt": b"\xff\xfe\x00\x81"}
    for name, body in said.items():
        (tmp_path / name).write_bytes(body)
    got = {r["path"].rpartition("/")[2]: r for r in L.scan_text(L.binary_files(spark, str(tmp_path))).collect()}
    assert (got["a.txt"]["text"], got["a.txt"]["encoding"], got["a.txt"]["line_count"], got["a.txt"]["format"]) == ("héllo\nwörld\nend", "utf-8", 3, "txt")
    assert (got["b.TXT"]["text"], got["b.TXT"]["encoding"], got["b.TXT"]["format"]) == ("中文\n文件", "gbk", "txt")
    assert (got["c"]["text"], got["c"]["encoding"], got["c"]["format"], got["c"]["file_size"]) == ("café", "latin-1", "txt", 4)
    assert "d.md" not in got  # Spark's source gives no row for a file without bytes
    assert got["e.txt"]["encoding"] == "latin-1"
    empty = L.scan_text(spark.createDataFrame([("x/d.md", b"")], "path string, content binary")).first()
    assert (empty["text"], empty["line_count"], empty["format"]) == ("", 1, "md")
    none = spark.createDataFrame([("x.txt", None)], "path string, content binary")
    assert L.scan_text(none).first()["text"] == "" and L.scan_text(none.limit(0)).count() == 0


def test_loading_falls_back_with_a_reason(spark, tmp_path):
    """One hanging reader, one that fails, one that gives too little, and one that works."""
    (tmp_path / "a.docx").write_bytes(b"whatever it is, it is long enough")
    (tmp_path / "b.html").write_bytes(b"<p>short</p>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.zzz").write_bytes(b"?")
    files = L.binary_files(spark, str(tmp_path)).select("path", "content")

    def hang(content):
        time.sleep(60)

    def fails(content):
        raise RuntimeError("no parser")

    loaders = {"docling_serve": hang, "docx": fails, "unstructured": lambda b: b.decode(), "html": lambda b: "tiny"}
    began = time.time()
    got = {r["path"].rpartition("/")[2]: r for r in L.load_with_fallback(files.filter("path NOT LIKE '%.pdf'"), timeout=1.0, loaders=loaders).collect()}
    assert time.time() - began < 30
    a = got["a.docx"]
    assert a["success"] and a["loader"] == "unstructured" and a["fallback_used"] and a["original_parser"] == "docling_serve"
    assert a["fallback_reason"] == "Primary parser (docling_serve) failed: TimedOut: timed out after 1 s"
    assert [(t["loader"], t["error"]) for t in a["attempts"]] == [("docling_serve", "TimedOut: timed out after 1 s"), ("docx", "RuntimeError: no parser"), ("unstructured", None)]
    assert 0.9 < a["attempts"][0]["seconds"] < 10
    b = got["b.html"]
    assert b["success"] and b["loader"] == "unstructured" and b["fallback_reason"].endswith("Invalid result (empty or no content)")
    assert got["d.zzz"]["error"] == "Unsupported format: zzz" and got["d.zzz"]["loader"] == "unknown"
    # the loaders that run here
    own = {r["path"].rpartition("/")[2]: r for r in L.load_with_fallback(files).collect()}
    assert own["c.pdf"]["error"] == "No available loaders for this format" and own["c.pdf"]["loader"] == "none"
    assert not own["a.docx"]["success"] and own["a.docx"]["error"] == "All parsers failed" and own["a.docx"]["attempts"][0]["error"].startswith("BadZipFile")


def test_preferred_loader_comes_first(spark):
    files = spark.createDataFrame([("a.txt", b"<p>hello there, world</p>")], "path string, content binary")
    r = L.load_with_fallback(files, preferred="html").first()
    assert r["loader"] == "html" and r["text"].strip() == "hello there, world" and not r["fallback_used"]
    r = L.load_with_fallback(files, preferred="json").first()
    assert r["loader"] == "text" and r["fallback_used"] and r["original_parser"] == "json"
    r = L.load_with_fallback(files, preferred="json", fallback=False).first()
    assert not r["success"] and r["error"] == "All parsers failed" and len(r["attempts"]) == 1
    assert L.load_with_fallback(files, preferred="pymupdf", fallback=False).first()["error"] == "No available loaders for this format"


def test_each_loader_reads_its_format(spark):
    book = office.zipped({"xl/workbook.xml": '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row r='1'><c r='A1' t='str'><v>first cell</v></c></row></sheetData></worksheet>"})
    files = [("a.csv", b"x,y\n1,hello\n2\n3,world"), ("b.json", b'{"a": [1, true, null]}'), ("c.xml", b"<r><a>some text</a> tail </r>"), ("d.xlsx", book), ("e.properties", b"key=value\n#x"), ("f.csv", b""), ("g.json", None), ("h.xml", b"<r>")]
    got = {r["path"]: r for r in L.load_with_fallback(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got["a.csv"]["text"] == "x: 1 | y: hello\nx: 3 | y: world"
    assert got["b.json"]["text"] == "a[0]: 1\na[1]: True\na[2]: null"
    assert got["c.xml"]["text"] == "some text\ntail"
    assert got["d.xlsx"]["success"] and "first cell" in got["d.xlsx"]["text"]
    assert got["e.properties"]["text"] == "key=value\n#x"
    assert [got[x]["success"] for x in ("f.csv", "g.json", "h.xml")] == [False] * 3


def test_pictures_by_their_bytes(spark):
    png, jpeg = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"
    rows = [("a", png + b"x"), ("b", jpeg + b"y" * L.INLINE), ("c", jpeg + b"y" * (L.INLINE - 3)), ("d", b"text"), ("e", None), ("f", b""), ("g", b"RIFF1234WEBPxx"), ("h", b"RIFF1234WAVExx")]
    got = {r["path"]: r for r in L.image_store_policy(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {k: (r["mime"], r["store"]) for k, r in got.items()} == {"a": ("image/png", "inline"), "b": ("image/jpeg", "file"), "c": ("image/jpeg", "inline"), "d": (None, "skip"), "e": (None, "skip"), "f": (None, "skip"), "g": ("image/webp", "inline"), "h": (None, "skip")}
    assert got["b"]["file_name"].endswith(".jpeg") and got["b"]["data"] is None
    import base64

    assert base64.b64decode(got["c"]["data"], validate=True) == rows[2][1] and "\n" not in got["c"]["data"]
