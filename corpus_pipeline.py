"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet and reread as the
next one's docs. All but the last return the columns of documents. A row travels as one struct beside its text, so columns of `docs` may have any names.
Null ids, null and empty texts and repeated rows are rows like others; what each stage does with them is said there. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import language, neardup, packing, quality, secrets
from siltstone.llm.common import discard, held_out, staged, workdir


#: Words that a worker remembers while it packs: fewer than by default, as its memory has served the stages before.
WORDS = 100_000


def carried(docs: DataFrame) -> DataFrame:
    """Columns _row (the row but its text), doc_id and text."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), "doc_id", "text")


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """Columns of `docs` from rows of `carried`; `new` replaces some."""
    return rows.select(*[new.get(c, F.col("text") if c == "text" else F.col("_row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (predicted 1). Null and empty texts are judged like an empty passage; repeated rows alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out_of = held_out(F.col("doc_id"))
    model = quality.train(docs.filter(~out_of).select("doc_id", "text"), labels.filter(~out_of))
    return unpacked(quality.classify(carried(docs), model).filter("predicted = 1"), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is told: rejected are those without a letter (null and empty texts too), and those whose nearest codeword has a loss
    beyond chance, that is with the weighted bits against it. Where no language could be learned all stay. Repeated rows are judged alike."""
    model = language.train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    if not model.languages:
        return docs
    told = (F.col("lang_pred") != language.UNKNOWN) & (F.col("loss") <= language.CHANCE)
    return unpacked(language.identify(carried(docs), model).filter(told), docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates: that of the least doc_id, a null one last (see `neardup.representatives`: repeated ids are told
    apart by their texts). Null texts and texts without words stay."""
    return neardup.representatives(docs, neardup.near_duplicates(docs.select("doc_id", "text")))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every found secret replaced by its kind in square brackets (of overlapping spans the earlier and longer), and n_chars counted
    anew. Null texts stay null; repeated rows each stay."""
    found = secrets.scan_history(carried(docs).drop("doc_id"), secrets.Ledger(spark, workdir(spark, "pipeline-ledger")), keep_text=True)
    return unpacked(secrets.redacted(found), docs, n_chars=F.length("text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences. Null texts are one piece of id 0; repeated rows each give their pieces."""
    import public_tokenizers as vocab

    return packing.pack_documents(docs.select("doc_id", "text"), vocab.path("word_bpe_49k.json"), words=WORDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", neardup_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: The learned and sampled stages have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
