"""BM25 sparse index in long form (chunk_id, term, weight): keyed by term, so ids never drift when statistics are refitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.stopwords import STOPWORDS

K1, B, MAX_DF = 1.5, 0.75, 0.95


def term_rows(df: DataFrame, key: str, text: str = "text", stop: bool = True) -> DataFrame:
    """(key, term), one row a token; stop words dropped inside the scan's own stage."""
    toks = T.tokens(F.col(text))
    if stop:
        toks = F.filter(toks, lambda t: ~t.isin(*STOPWORDS))
    return df.select(F.col(key), F.explode(toks).alias("term"))


def term_counts(df: DataFrame, key: str, text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, dl): dl counts all tokens of the row. `only` (a column term) leaves other terms out before they are shuffled."""
    toks = F.filter(T.tokens(F.col(text)), lambda t: ~t.isin(*STOPWORDS))
    each = df.select(F.col(key), toks.alias("toks")).select(key, F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("term"))
    if only is not None:
        each = each.join(only, "term", "left_semi")
    return each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: doc_count, avgdl (texts without tokens count)."""
    n = F.size(F.filter(T.tokens(F.col(text)), lambda t: ~t.isin(*STOPWORDS)))
    return df.agg(F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.avg(F.coalesce(n, F.lit(0))), F.lit(0.0)).alias("avgdl"))


def document_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """(term, df), before any pruning; counts of batches can be added up."""
    toks = F.array_distinct(F.filter(T.tokens(F.col(text)), lambda t: ~t.isin(*STOPWORDS)))
    return df.select(F.explode(toks).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(frequencies: DataFrame, corpus: DataFrame, max_df: float = MAX_DF) -> DataFrame:
    """(term, df, idf) of terms in at most int(max_df * N) texts: with one text there is none."""
    n = F.col("doc_count")
    out = frequencies.crossJoin(F.broadcast(corpus.select("doc_count"))).filter(F.col("df") <= F.floor(n * max_df))
    return out.select("term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def with_term_ids(vocab: DataFrame, prefix: int = 2) -> DataFrame:
    """Adds term_id: the place of the term in sorted order, from 0. Terms are numbered by prefix, and prefixes by a small table of counts."""
    head = F.substring("term", 1, prefix)
    sizes = vocab.groupBy(head.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.withColumn("_first", F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).drop("_n")
    own = vocab.withColumn("_p", head).withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy("term")) - 1)
    return own.join(first, "_p").withColumn("term_id", (F.col("_first") + F.col("_r")).cast("long")).drop("_p", "_r", "_first")


def merged_statistics(old: DataFrame, new: DataFrame, old_corpus: DataFrame, new_corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frequencies and corpus of two batches together; avgdl weighted by documents."""
    freq = old.unionByName(new).groupBy("term").agg(F.sum("df").alias("df"))
    both = old_corpus.unionByName(new_corpus).agg(F.sum("doc_count").alias("doc_count"), (F.sum(F.col("doc_count") * F.col("avgdl")) / F.sum("doc_count")).alias("avgdl"))
    return freq, both


def weight(tf: Column, idf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)), to 6 places."""
    return F.round(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), 6)


def encode_documents(counts: DataFrame, vocab: DataFrame, corpus: DataFrame, key: str, k1: float = K1, b: float = B) -> DataFrame:
    """(key, term, weight) with weight = idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)), to 6 places, above 0. dl counts tokens outside the vocabulary too."""
    x = counts.join(vocab.select("term", "idf"), "term").crossJoin(F.broadcast(corpus.select("avgdl")))
    w = weight(F.col("tf"), F.col("idf"), F.col("dl"), F.col("avgdl"), k1, b)
    return x.select(key, "term", w.alias("weight")).filter("weight > 0")


def encode_queries(queries: DataFrame, vocab: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, weight) with weight = idf * tf, to 6 places, above 0."""
    tf = term_counts(queries, key, text)
    return tf.join(vocab.select("term", "idf"), "term").select(key, "term", F.round(F.col("idf") * F.col("tf"), 6).alias("weight")).filter("weight > 0")


def score(doc_weights: DataFrame, query_weights: DataFrame, doc_key: str, query_key: str) -> DataFrame:
    """(query, doc, score): exact inner products over common terms, to 6 places. The queries' terms prune the index first: a side of theirs is
    broadcast by Spark only where its size allows."""
    hits = doc_weights.withColumnRenamed("weight", "wd").join(query_weights.withColumnRenamed("weight", "wq"), "term")
    return hits.groupBy(query_key, doc_key).agg(F.round(F.sum(F.col("wd") * F.col("wq")), 6).alias("score"))


def top(scores: DataFrame, by: str, n: int, tie: str, column: str = "score") -> DataFrame:
    """The n best rows of each group with their rank from 1; ties by `tie`."""
    w = W.partitionBy(by).orderBy(F.desc(column), tie)
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
