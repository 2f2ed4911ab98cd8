"""Ranked candidates: fusion, merging, noise control, packing. Every ranking has an explicit tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T

RRF_K = 60
SINGLE_TOPIC_MAX = 40


def validate_query(text: Column, most: int = 2000) -> Column:
    """struct(query, error): the stripped text, or null with the error `empty` or `too long` (over `most` characters). Null is empty."""
    t = T.strip(F.coalesce(text, F.lit("")))
    error = F.when(t == "", "empty").when(F.length(t) > most, "too long")
    return F.struct(F.when(error.isNull(), t).alias("query"), error.alias("error"))


def parse_enhancement(answer: Column, query: Column) -> Column:
    """struct(rewritten, is_complex, sub_queries, all_queries, parsed) of what a model answered on a query: a JSON object with rewritten_query, is_complex and sub_queries, possibly in a code fence.

    Any failure (no JSON, no object, a rewritten query that is no text) leaves the query alone, and so does an empty one. A query that is not complex has no sub-queries; of a list only texts
    count, stripped, and not empty ones. is_complex is true unless it is missing, null, false, 0 or empty. A repeated key counts as a failure."""
    lines = F.split(T.strip(answer), "\n")
    fenced = T.strip(F.element_at(lines, -1)) == "```"
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1 - F.when(fenced & (F.size(lines) > 1), 1).otherwise(0), F.lit(0))), "\n")
    v = F.try_parse_json(F.when(T.strip(answer).startswith("```"), inner).otherwise(T.strip(answer)))
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    said = part("rewritten_query")
    good = kind(v).startswith("OBJECT") & (said.isNull() | (kind(said) == "STRING"))
    text = T.strip(F.coalesce(F.try_variant_get(said, "$", "string"), F.lit("")))
    rewritten = F.when(F.coalesce(good, F.lit(False)) & (text != ""), text).otherwise(query)
    flag = part("is_complex")
    plain = F.coalesce(F.try_variant_get(flag, "$", "string"), F.lit(""))
    empty = F.when(kind(flag) == "BOOLEAN", plain == "false").when(kind(flag) == "STRING", plain == "").when(kind(flag).rlike("^(ARRAY|OBJECT)"), F.to_json(flag).isin("[]", "{}")).otherwise(F.coalesce(plain.try_cast("double"), F.lit(0.0)) == 0)
    is_complex = F.coalesce(good, F.lit(False)) & ~empty
    listed = F.transform(F.filter(F.try_variant_get(part("sub_queries"), "$", "array<variant>"), lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")) == "STRING"), lambda x: T.strip(F.variant_get(x, "$", "string")))
    none = F.array().cast("array<string>")
    subs = F.when(is_complex, F.coalesce(F.filter(listed, lambda x: x != ""), none)).otherwise(none)
    return F.struct(rewritten.alias("rewritten"), is_complex.alias("is_complex"), subs.alias("sub_queries"), F.concat(F.array(rewritten), subs).alias("all_queries"), F.coalesce(good, F.lit(False)).alias("parsed"))


def search_modes(requests: DataFrame, statistics: DataFrame, key: str = "index_id", requested: str = "mode") -> DataFrame:
    """Adds search_mode to requests: dense_only where it was asked for, or where an index has no row in `statistics`; else hybrid. A null index has none."""
    known = statistics.select(F.col(key).alias("_known")).distinct()
    mode = F.when((F.coalesce(F.col(requested), F.lit("auto")) != "dense_only") & F.col("_known").isNotNull(), "hybrid").otherwise("dense_only")
    return requests.join(known, F.col(key) == F.col("_known"), "left").withColumn("search_mode", mode).drop("_known")


def rrf_fuse(lists: list[DataFrame], key: str, n: int, by: str = "query_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (by, key, rank from 1): sum of 1 / (k + rank), to 9 places; the n best of each query."""
    if k <= 0:
        raise ValueError("k must be positive")
    both = lists[0].select(by, key, "rank")
    for x in lists[1:]:
        both = both.unionByName(x.select(by, key, "rank"))
    s = both.groupBy(by, key).agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("rrf_score"))
    w = W.partitionBy(by).orderBy(F.desc("rrf_score"), key)
    return s.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def multi_query_merge(cands: DataFrame, key: str = "vec_id") -> DataFrame:
    """cands: (query_id, variant, key, score), variant 0 the primary query. Each key once a query, with its best score; ties to the earlier variant."""
    best = F.max(F.struct(F.col("score"), (-F.col("variant")).alias("v")))
    return cands.groupBy("query_id", key).agg(best.alias("b")).select("query_id", key, F.col("b.score").alias("score"), (-F.col("b.v")).alias("variant"))


def quota(cands: DataFrame, per: str, n: int = 10, score: str = "score", tie: str = "vec_id", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """At most n candidates of each index of a query, best first; n = 0 is no limit."""
    if not n:
        return cands
    w = W.partitionBy(*by, per).orderBy(F.desc(score), tie)
    return cands.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def exact_dedup_cross_doc(cands: DataFrame, text: str = "text", doc: str = "doc_id", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Of candidates with one stripped text in several documents only the winning document's stay (best score, then position). Blank texts are exempt."""
    h = F.when(T.strip(F.col(text)) == "", None).otherwise(F.sha2(T.strip(F.col(text)).cast("binary"), 256))
    w = W.partitionBy(*by, "_h").orderBy(F.desc("score"), "position")
    won = F.first(doc).over(w)
    x = cands.withColumn("_h", h)
    kept = x.filter(F.col("_h").isNotNull()).withColumn("_d", won).filter(F.col("_d") == F.col(doc)).drop("_d")
    return kept.unionByName(x.filter(F.col("_h").isNull())).drop("_h")


def near_pairs(cands: DataFrame, least: float = 0.5, key: str = "vec_id", doc: str = "doc_id", text: str = "text", by: str = "query_id") -> DataFrame:
    """Pairs (a < b) of candidates of one query and different documents whose character 3-gram sets have Jaccard similarity `least` or more.

    Texts are stripped; one under 3 characters is its own only gram, an empty one has none and is like no other.
    Candidate lists are bounded by the retrieval stage; pairs meet on common 3-grams by an equi-join.
    """
    low = cands.select(by, F.col(key).alias("k"), F.col(doc).alias("d"), T.strip(F.coalesce(F.col(text), F.lit(""))).alias("t")).filter("t <> ''")
    spots = low.select(by, "k", "d", "t", F.explode(F.sequence(F.lit(1), F.greatest(F.length("t") - 2, F.lit(1)))).alias("i"))
    grams = spots.select(by, "k", "d", F.substring("t", F.col("i"), F.lit(3)).alias("gram")).distinct()
    each = grams.join(grams.groupBy(by, "k").agg(F.count(F.lit(1)).alias("size")), [by, "k"])
    other = each.select(by, F.col("k").alias("k2"), F.col("d").alias("d2"), F.col("size").alias("size2"), "gram")
    both = each.join(other, [by, "gram"]).filter((F.col("k") < F.col("k2")) & (F.col("d") != F.col("d2")))
    n = both.groupBy(by, "k", "k2").agg(F.count(F.lit(1)).alias("common"), F.first("size").alias("size"), F.first("size2").alias("size2"))
    j = F.col("common") / (F.col("size") + F.col("size2") - F.col("common"))
    return n.select(by, F.col("k").alias("a"), F.col("k2").alias("b"), F.round(j, 6).alias("jaccard")).filter(F.col("jaccard") >= least)


def near_dedup(cands: DataFrame, least: float = 0.5, by: str = "query_id", key: str = "vec_id") -> DataFrame:
    """Greedy in order of score: a candidate goes if a kept one of another document is similar. One query's list is one group, bounded by retrieval."""
    import pandas as pd

    pairs = near_pairs(cands, least, by=by, key=key).select(by, "a", "b")
    fields = cands.select(by, key, "score")

    def greedy(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(links["a"], links["b"], strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        kept: set = set()
        out = []
        for r in rows.sort_values(["score", key], ascending=[False, True]).itertuples(index=False):
            k = getattr(r, key)
            if not near.get(k, set()) & kept:
                kept.add(k)
                out.append((getattr(r, by), k))
        return pd.DataFrame(out, columns=[by, key])

    kind = {f.name: f.dataType.simpleString() for f in cands.schema}
    links = pairs.select(F.col(by).alias("_q"), "a", "b")
    kept = fields.groupBy(by).cogroup(links.groupBy("_q")).applyInPandas(greedy, f"`{by}` {kind[by]}, `{key}` {kind[key]}")
    return cands.join(kept, [by, key], "left_semi")


def single_topic(query: Column) -> Column:
    """Short queries (40 characters or fewer without white space) that neither compare nor name two topics."""
    q = F.regexp_replace(query, T.SPACE, "")
    # Comparison markers and two-topic patterns.
    marks = r"对比|比较|区别|差异|不同|异同|优劣|哪个好|还是|vs|VS|versus|compare|difference"
    pairs = r".+和.+的|.+与.+的|.+以及.+|.+及.+的"
    return (F.length(q) <= SINGLE_TOPIC_MAX) & ~q.rlike(marks) & ~q.rlike(pairs)


def threshold(cands: DataFrame, score: str = "score", static: float = 0.4, ratio: float = 0.6, cap: float = 0.5, least: int = 5, by: str = "query_id", tie: str = "vec_id") -> DataFrame:
    """Keeps scores of max(static, min(ratio * best, cap)) or more and refills to `least` rows by score; adds final_rank and backfilled."""
    w = W.partitionBy(by).orderBy(F.desc(score), tie)
    x = cands.withColumn("final_rank", F.row_number().over(w).cast("long")).withColumn("_best", F.max(score).over(W.partitionBy(by)))
    limit = F.greatest(F.lit(static), F.least(F.lit(ratio) * F.col("_best"), F.lit(cap)))
    x = x.withColumn("backfilled", F.col(score) < limit)
    return x.filter(~F.col("backfilled") | (F.col("final_rank") <= least)).drop("_best")


def diversity(cands: DataFrame, most: int = 2, doc: str = "doc_id", rank: str = "final_rank", by: str = "query_id") -> DataFrame:
    """At most `most` rows of a document (rows without a document share one bucket); 0 is no limit."""
    if not most:
        return cands
    w = W.partitionBy(by, F.coalesce(F.col(doc).cast("string"), F.lit("unknown"))).orderBy(rank)
    return cands.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def paginate(cands: DataFrame, page: int = 1, size: int = 10, rank: str = "final_rank", by: str = "query_id") -> DataFrame:
    """The rows of one page after renumbering what is left."""
    w = W.partitionBy(by).orderBy(rank)
    x = cands.withColumn("place", F.row_number().over(w).cast("long"))
    return x.filter((F.col("place") > (page - 1) * size) & (F.col("place") <= page * size))


def final_topk(cands: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "vec_id") -> DataFrame:
    """The k best of each query after all layers, with place from 1."""
    w = W.partitionBy(by).orderBy(F.desc(score), tie)
    return cands.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k)


def format_results(cands: DataFrame, text: str = "text", score: str = "score", chars: int = 200) -> DataFrame:
    """Adds summary (the first `chars` characters, with three dots where more follow) and percent (the score from 0 to 1 as a percentage, one decimal)."""
    cut = F.length(text) > chars
    return cands.withColumn("summary", F.when(cut, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(F.col(text))).withColumn("percent", F.concat(F.format_number(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(score))) * 100, 1), F.lit("%")))


def extract_sources(cands: DataFrame, by: str = "query_id", doc: str = "doc_id", rank: str = "rank") -> DataFrame:
    """One row a document that a query's context cites: its first place and how many of its chunks are there."""
    return cands.groupBy(by, doc).agg(F.min(rank).alias("first_rank"), F.count(F.lit(1)).alias("chunks"), F.max("score").alias("best_score"))


def rerank_text(chunks: DataFrame) -> DataFrame:
    """Adds rerank_text: the document's name first; short texts get what stands before and after."""
    # The labels.
    short = F.length("content") < 100
    before = F.when(short & (F.coalesce(F.length("before"), F.lit(0)) > 0), F.concat(F.lit("[上文: "), F.col("before"), F.lit("]")))
    after = F.when(short & (F.coalesce(F.length("after"), F.lit(0)) > 0), F.concat(F.lit("[下文: "), F.col("after"), F.lit("]")))
    return chunks.withColumn("rerank_text", F.concat_ws("\n", F.concat(F.lit("[文档: "), F.col("name"), F.lit("]")), before, F.col("content"), after))


def overlap_score(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a reranking model: the share of the query's distinct tokens that the text has, to 6 places."""
    q = F.array_distinct(T.tokens(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(q, T.tokens(text))) / F.size(q), 6))


def context_items(found: DataFrame, least: float = 0.3, text: str = "text", name: str = "name", by: str = "query_id", score: str = "score", place: str = "place") -> DataFrame:
    """Search results as the context of an answer: rows of at least `least` in order, numbered anew from 1, with content, similarity and source_file (来源 and the number where a row has no name).

    A null text is empty and a null score 0."""
    # Fixed value: the name of a nameless source.
    x = found.withColumn("similarity", F.coalesce(score, F.lit(0.0))).filter(F.col("similarity") >= least)
    x = x.withColumn("index", F.row_number().over(W.partitionBy(by).orderBy(place)).cast("long"))
    named = F.coalesce(F.when(F.col(name) != "", F.col(name)), F.concat(F.lit("来源 "), F.col("index").cast("string")))
    return x.select(by, "index", named.alias("source_file"), "similarity", F.coalesce(text, F.lit("")).alias("content"), "chunk_id")


def prompt_of(items: DataFrame, by: str = "query_id", query: str = "query") -> DataFrame:
    """(by, prompt, sources, files) of context items with their query: numbered contents with their sources, and the question after them. A query's items are bounded by its search."""
    # The labels.
    line = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), F.col("content"), F.lit("\n来源："), F.col("source_file"))
    g = items.groupBy(by, query).agg(F.sort_array(F.collect_list(F.struct("index", line.alias("line"), "source_file"))).alias("_l"), F.count(F.lit(1)).alias("sources"))
    return g.select(by, F.concat(F.array_join("_l.line", "\n\n"), F.lit("\n\n问题："), F.col(query)).alias("prompt"), "sources", F.col("_l.source_file").alias("files"))


def pack_context(items: DataFrame, budget: Column, by: str = "query_id", order: str = "rank", tokens: str = "tokens") -> DataFrame:
    """The longest prefix of each ranked list that fits the token budget: packing stops at the first item that does not."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("used_tokens", F.sum(tokens).over(w)).filter(F.col("used_tokens") <= budget)


def context_budget(context: int, question: Column, max_output: int, reserve: int = 500) -> Column:
    """int(0.9 * (context - reserve - tokens of the question - max_output)), a token for four characters."""
    return F.floor((F.lit(context) - reserve - F.floor(F.length(question) / 4) - max_output) * 0.9)
