"""Canonical exact digests: documents that differ only in Unicode form, case or white space share a fingerprint.

canonical(text): NFKC, case folding, NFKC again (folding can leave composed forms), runs of white space to one blank, ends
stripped. The fingerprint is the 128-bit xxHash3 of its UTF-8 bytes. Inside equal buckets the bytes of documents are compared, so that a
collision never merges two texts. Edited texts exist only in passing: in their buckets a 256-bit digest of the bytes is compared.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import staged


def canonical(text: str | None) -> str:
    """Null is empty. Lone surrogates stay out of Spark strings, so every result has a UTF-8 form."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8"))


def likeness(a: tuple[str, bytes], b: tuple[str, bytes]) -> float:
    """Of two exact fingerprints with their canonical bytes: 1 if both are equal, else 0."""
    return 1.0 if a == b else 0.0


def printed(text: str) -> tuple[str, bytes]:
    body = canonical(text).encode("utf-8")
    return xxhash.xxh3_128_hexdigest(body), body


def proof(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=32).digest()


def variants(prints: DataFrame) -> DataFrame:
    """(fingerprint, proof, variant): of fingerprints with several proofs, each proof numbered from 0. prints: (fingerprint, proof), repeated ones too."""
    from pyspark.sql import Window as W

    clash = prints.groupBy("fingerprint").agg(F.min("proof").alias("_a"), F.max("proof").alias("_z")).filter("_a <> _z").select("fingerprint")
    each = prints.join(clash, "fingerprint", "left_semi").distinct()
    return each.withColumn("variant", F.row_number().over(W.partitionBy("fingerprint").orderBy("proof")) - 1)


def checked(docs: DataFrame, prints: DataFrame, text: str = "text", most_broadcast: int = 1 << 20) -> None:
    """Compares the canonical bytes of all documents that share a fingerprint; prints: their (fingerprint, proof).

    Each task sends one copy of each of its distinct canonical texts among those, and the copies meet byte by byte; so a third of all rows in one
    group sends one text a task. Bytes that differ under one fingerprint and one proof can't be told apart by `variants`: RuntimeError.
    """
    def bodies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[bytes] = set()
        for p in parts:
            out = []
            for f, x in zip(p["fingerprint"], p["body"], strict=True):
                seen = proof(x)
                if seen not in met:
                    out.append((f, seen, x))
                    met.add(seen)
                    if len(met) > 1_000_000:  # forgetting only sends a text twice
                        met.clear()
            yield pd.DataFrame(out, columns=["fingerprint", "proof", "body"])

    def canonicals(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([printed(x or "") for x in p[text]], columns=["fingerprint", "body"])

    shared = staged(prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint"), "shared-fingerprints")
    marked = docs.select(text).mapInPandas(canonicals, "fingerprint string, body binary")
    marked = marked.join(F.broadcast(shared) if shared.count() <= most_broadcast else shared, "fingerprint", "left_semi")
    met = marked.mapInPandas(bodies, "fingerprint string, proof binary, body binary").groupBy("fingerprint", "proof").agg(F.min("body").alias("_a"), F.max("body").alias("_z"))
    if not met.filter("_a <> _z").isEmpty():
        raise RuntimeError("two texts share a fingerprint and a proof")


def _settled(rows: DataFrame, clash: DataFrame | None, fingerprint: str, proof_col: str) -> DataFrame:
    """`fingerprint` with "-variant" appended where other bytes share it; the proof column goes."""
    if clash is None:
        return rows.drop(proof_col)
    named = clash.select(F.col("fingerprint").alias("_f"), F.col("proof").alias("_p"), F.col("variant").alias("_v"))
    out = rows.join(named, (F.col(fingerprint) == F.col("_f")) & (F.col(proof_col) == F.col("_p")), "left")
    return out.withColumn(fingerprint, F.when(F.col("_v") > 0, F.concat_ws("-", fingerprint, "_v")).otherwise(F.col(fingerprint))).drop("_f", "_p", "_v", proof_col)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, group_size): rows with equal fingerprints have equal canonical bytes.

    Null is empty; repeated rows are members of one group; an empty table gives no rows; other columns of `docs` are left out.
    """
    def prints(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [printed(x or "") for x in p[text]]
            yield pd.DataFrame({id_col: p[id_col], "fingerprint": [f for f, _ in got], "proof": [proof(b) for _, b in got]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = staged(docs.select(id_col, text).mapInPandas(prints, f"`{id_col}` {kind}, fingerprint string, proof binary"), "prints")
    pairs = rows.select("fingerprint", "proof")
    checked(docs, pairs, text)
    clash = staged(variants(pairs), "collisions")
    rows = _settled(rows, None if clash.isEmpty() else clash, "fingerprint", "proof")
    sizes = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("group_size"))
    return rows.join(sizes, "fingerprint").select(id_col, "fingerprint", "group_size")


#: Rows of one range of descending ids, about.
RANGE = 4000
FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, _proof binary, _edited_proof binary"


def compared(text: str, own: tuple[str, bytes], after: str, other: tuple[str, bytes]) -> tuple:
    """The columns FIELDS of a text whose next is `after`."""
    k = len(text) // 3
    edited = text[: len(text) - k] + after[:k] if k else text
    e = printed(edited)
    return len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), own[0], e[0], likeness(own, e), likeness(own, other), proof(own[1]), proof(e[1])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rows_per_range: int = RANGE) -> DataFrame:
    """Per row: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last floor(n/3) code points by the first as many (or all) of the next document, descending id; after the last
    comes the first. Null is empty, a null id comes last; rows with one id are ordered by a hash of their text; a sole row is its own next. Ids may be of
    any type that sorts. Repeated rows stay; an empty table gives no rows; other columns of `docs` are left out.

    Texts are shuffled once, to ranges of descending id (a repeated row spreads by its place in the input). Each range hands out its first and last text;
    only these meet across ranges, and the driver sees the numbers of the ranges that have rows alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ranges = max(1, -(-docs.select(id_col).count() // rows_per_range))
    order = [F.col(id_col).desc_nulls_last(), F.col("_tie"), F.col("_turn")]
    dealt = docs.select(id_col, text).withColumn("_tie", F.xxhash64(text)).withColumn("_turn", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    cols = [id_col, *[f.split()[0] for f in FIELDS.split(", ")], "_range", "_edge", "_text"]
    schema = f"`{id_col}` {kind}, {FIELDS}, _range int, _edge string, _text string"
    empty = (None,) * 8

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None  # the row whose next has not come yet: id, text, fingerprint and bytes
        for p in parts:
            out = []
            for i, x in zip(p[id_col], p[text], strict=True):
                x = x or ""
                f = printed(x)
                if held is None:
                    out.append((i, *empty, part, "first", x))
                else:
                    out.append((held[0], *compared(held[1], held[2], x, f), part, None, None))
                held = (i, x, f)
            yield pd.DataFrame(out, columns=cols)
        if held is not None:
            yield pd.DataFrame([(held[0], *empty, part, "last", held[1])], columns=cols)

    def join_edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [(i, *compared(x, printed(x), y, printed(y)), None, None, None) for i, x, y in zip(p[id_col], p["_text"], p["_after"], strict=True)]
            yield pd.DataFrame(out, columns=cols)

    rows = staged(dealt.mapInPandas(run, schema), "edited")
    edges = rows.filter("_edge IS NOT NULL").select(id_col, "_range", "_edge", "_text")
    some = sorted(r["_range"] for r in edges.filter("_edge = 'first'").select("_range").collect())
    before = docs.sparkSession.createDataFrame(list(zip(some, some[-1:] + some[:-1], strict=True)), "_range int, _before int")
    heads = edges.filter("_edge = 'first'").join(before, "_range").select(F.col("_before").alias("_range"), F.col("_text").alias("_after"))
    met = edges.filter("_edge = 'last'").select(id_col, "_range", "_text").join(heads, "_range").mapInPandas(join_edges, schema)
    out = staged(rows.filter("_edge IS NULL").unionByName(met).drop("_range", "_edge", "_text"), "edited-all")
    own = out.select("fingerprint", F.col("_proof").alias("proof"))
    checked(docs, own, text)
    clash = staged(variants(own.unionByName(out.select(F.col("edited_fingerprint").alias("fingerprint"), F.col("_edited_proof").alias("proof")))), "collisions")
    clash = None if clash.isEmpty() else clash
    out = _settled(out, clash, "fingerprint", "_proof")
    return _settled(out, clash, "edited_fingerprint", "_edited_proof").select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
