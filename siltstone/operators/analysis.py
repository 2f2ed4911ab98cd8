"""Document features, language and domain signals, and rule-based recommenders; column expressions and small joins."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.domains import CHINESE, DOMAINS, ENGLISH

# Base chunk size and overlap by format, and multipliers and bounds by length.
FORMATS = {"csv": (500, 0), "xlsx": (500, 0), "xls": (500, 0), "json": (600, 0), "pdf": (800, 150), "docx": (800, 150), "doc": (800, 150), "txt": (600, 100), "md": (600, 100), "html": (700, 100), "htm": (700, 100), "pptx": (400, 50), "ppt": (400, 50), "default": (600, 100)}
LENGTHS = {"short": (0.6, 0.5, 150, 500), "medium": (1.0, 1.0, 200, 1500), "long": (1.5, 1.5, 300, 2000)}
SHORT_BELOW, LONG_FROM = 2000, 50_001
# Scores of embedding models by language (zh, en, ja, ko, other) and domain (general, then DOMAINS), and whether they take images.
MODELS = {
    "bge-m3": ((0.92, 0.88, 0.85, 0.85, 0.78), (0.88, 0.82, 0.75, 0.72, 0.78, 0.85, 0.86), 0.0),
    "qwen3-embedding-8b": ((0.96, 0.88, 0.72, 0.70, 0.60), (0.90, 0.94, 0.82, 0.78, 0.85, 0.88, 0.85), 0.0),
    "qwen3-vl-embedding-8b": ((0.92, 0.85, 0.68, 0.68, 0.55), (0.88, 0.85, 0.72, 0.85, 0.78, 0.82, 0.85), 0.95),
}
# Index rules (rows up to, index type) and metrics by part of a model's name.
INDEX_RULES = ((9_999, "FLAT"), (499_999, "HNSW"), (4_999_999, "IVF_SQ8"), (None, "IVF_PQ"))


#: The head row and the rule under it of a Markdown table; a whole HTML table.
MARKDOWN_TABLE, HTML_TABLE = r"(?md)^\|.*\|$\n^\|[-:\s|]+\|$", r"(?is)<table[^>]*>.*?</table>"


def lines(text: Column) -> Column:
    """Stripped, non-empty lines."""
    return F.filter(F.transform(F.split(text, "\n"), T.strip), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n[ \t\n\r\f\x0B]*\n"), T.strip), lambda s: s != "")


def document_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts of characters, words, headings (Markdown and HTML), paragraphs, tables, images and code, and the flags that follow from them."""
    t = F.col(text)
    para = F.transform(paragraphs(t), F.length)
    fences = F.regexp_extract_all(t, F.lit(r"(?s)```.*?```"), F.lit(0))
    code = F.aggregate(F.transform(fences, F.length), F.lit(0), lambda s, x: s + x)
    out = df.withColumn("char_count", F.length(t).cast("long")).withColumn("word_count", T.word_count(t))
    out = out.withColumn("heading_count", (F.regexp_count(t, F.lit(r"(?m)^#{1,6}[ \t]+.+$")) + F.regexp_count(t, F.lit(r"(?i)<h[1-6][^>]*>"))).cast("long"))
    out = out.withColumn("heading_levels", F.size(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"(?m)^(#{1,6})[ \t]+.+$"), F.lit(1)), F.length))).cast("long"))
    out = out.withColumn("paragraph_count", F.size(para).cast("long")).withColumn("avg_paragraph", F.when(F.size(para) > 0, F.round(F.aggregate(para, F.lit(0), lambda s, x: s + x) / F.size(para), 6)).otherwise(F.lit(0.0)))
    out = out.withColumn("max_paragraph", F.coalesce(F.array_max(para), F.lit(0)).cast("long"))
    out = out.withColumn("table_count", (F.regexp_count(t, F.lit(MARKDOWN_TABLE)) + F.regexp_count(t, F.lit(HTML_TABLE))).cast("long")).withColumn("image_count", (F.regexp_count(t, F.lit(r"!\[[^\]]*\]\([^)]+\)")) + F.regexp_count(t, F.lit(r"(?i)<img[^>]+>"))).cast("long"))
    out = out.withColumn("code_count", F.size(fences).cast("long")).withColumn("code_ratio", F.when(F.length(t) > 0, F.round(code / F.length(t), 6)).otherwise(F.lit(0.0)))
    return out


def flags(f: DataFrame) -> DataFrame:
    """Adds clear_structure, is_technical, is_narrative and complexity to rows of `document_features`."""
    c = F.col
    out = f.withColumn("clear_structure", (c("heading_count") >= 3) & (c("heading_levels") >= 2))
    out = out.withColumn("is_technical", (c("code_ratio") > 0.2) | (c("code_count") > 3) | (c("table_count") > 2))
    out = out.withColumn("is_narrative", (c("heading_count") < 3) & (c("table_count") < 2) & (c("code_count") < 2) & (c("avg_paragraph") > 200))
    score = F.when(c("heading_count") > 10, 2).when(c("heading_count") > 5, 1).otherwise(0) + F.when((c("table_count") > 5) | (c("image_count") > 10), 2).when((c("table_count") > 0) | (c("image_count") > 0), 1).otherwise(0)
    score = score + F.when(c("code_ratio") > 0.3, 2).when(c("code_count") > 0, 1).otherwise(0) + F.when(c("char_count") > 50_000, 1).otherwise(0)
    return out.withColumn("complexity", F.when(score >= 4, "high").when(score >= 2, "medium").otherwise("low"))


def is_log_like(text: Column) -> Column:
    """Over 0.4 of the first 30 lines (of 5 or more) begin with a time stamp or a level."""
    def logged(first: Column) -> Column:
        hits = F.aggregate(first, F.lit(0), lambda s, x: s + x.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}[ \tT]\d{2}:\d{2}").cast("int") + x.rlike(r"(?i)^(INFO|DEBUG|WARN|ERROR|FATAL|WARNING|TRACE)[ \t]").cast("int"))
        return (F.size(first) >= 5) & (hits / F.size(first) > 0.4)

    return T.with_value(F.slice(lines(text), 1, 30), logged)


def is_structured(text: Column) -> Column:
    """At least 3 lines, over 0.6 of them `key: value`."""
    return T.with_value(lines(text), lambda ls: (F.size(ls) >= 3) & (F.size(F.filter(ls, lambda s: s.rlike(r"^.{2,50}:[ \t]+.+$"))) / F.size(ls) > 0.6))


def spread_of(n: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    """f(n, mean, variance) of an array of numbers; both null for an empty one."""
    total = lambda each: F.try_divide(F.aggregate(n, F.lit(0.0), each), F.size(n))
    return T.with_value(total(lambda s, x: s + x), lambda mean: T.with_value(total(lambda s, x: s + (x - mean) * (x - mean)), lambda var: f(n, mean, var)))


def line_uniformity(text: Column) -> Column:
    """1 minus the coefficient of variation of the lengths of the first 50 lines that aren't blank, as they stand, from 0 to 1, to 3 places; 0 for fewer than
    3 lines or a mean under 10."""
    n = F.transform(F.slice(F.filter(F.split(text, "\n"), lambda s: T.strip(s) != ""), 1, 50), F.length)
    even = lambda n, mean, var: F.when((F.size(n) < 3) | (mean < 10), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sqrt(var) / mean)), 3))
    return T.with_value(n, lambda n: spread_of(n, even))


def document_format(file_format: Column, file_name: Column, metadata_format: Column, loader: Column) -> Column:
    """The stated format, else the name's ending, else that of the metadata, else the loader where it is named after a format; lower case, empty if unknown."""
    given = lambda c: F.when(c != "", F.lower(c))
    base = F.regexp_replace(F.regexp_extract(file_name, r"([^/]*)$", 1), r"^\.+", "")
    ending = F.regexp_extract(base, r"\.([^.]+)$", 1)
    return F.coalesce(given(file_format), given(ending), given(metadata_format), F.when(F.lower(loader).isin("json", "csv", "txt", "md", "html", "xml"), F.lower(loader)), F.lit(""))


def is_flattened_tabular(text: Column, fmt: Column) -> Column:
    """Spreadsheet texts without a Markdown table whose first 30 lines (3 or more, 20 characters and more in the mean) vary in length by under half the mean."""
    n = F.transform(F.slice(lines(text), 1, 30), F.length)
    even = lambda n, mean, var: (F.size(n) >= 3) & F.coalesce((mean >= 20) & (F.sqrt(var) / mean < 0.5), F.lit(False))
    return fmt.isin("xlsx", "xls", "csv") & (F.regexp_count(text, F.lit(MARKDOWN_TABLE)) == 0) & T.with_value(n, lambda n: spread_of(n, even))


def is_slide_like(text: Column, fmt: Column, slides: Column) -> Column:
    """Slides by format or number; else 3 or more paragraphs, short in the mean, with many lines that begin with a bullet (stricter for Word documents)."""
    word = F.lower(fmt).isin("docx", "doc")

    def bulleted(para: Column) -> Column:
        mean = F.aggregate(F.transform(para, F.length), F.lit(0.0), lambda s, x: s + x) / F.size(para)
        line = F.flatten(F.transform(para, lambda p: F.split(p, "\n")))
        share = T.with_value(line, lambda line: F.size(F.filter(line, lambda x: x.rlike(r"^[ \t\n\r\f\x0B]*[-•*▪▸►][ \t\n\r\f\x0B]"))) / F.size(line))
        return (F.size(para) >= 3) & F.when(word, (mean < 100) & (share > 0.6)).otherwise((mean < 300) & (share > 0.3))

    return F.lower(fmt).isin("pptx", "ppt") | (F.coalesce(slides, F.lit(0)) > 0) | F.coalesce(T.with_value(paragraphs(text), bulleted), F.lit(False))


def recommend_text_strategy(fmt: Column, table_layout: Column, flattened: Column, log_like: Column, slide_like: Column, clear_structure: Column, headings: Column) -> Column:
    """struct(strategy, rule) for the plain text of a mixed document: the first rule that holds; a null input does not hold (a null layout counts as kept)."""
    f = F.lower(F.coalesce(fmt, F.lit("")))
    rules = [
        ("flattened table", "paragraph", flattened),
        ("sheet without layout", "paragraph", f.isin("xlsx", "xls", "csv") & ~F.coalesce(table_layout, F.lit(True))),
        ("log", "paragraph", log_like),
        ("slides", "paragraph", F.coalesce(slide_like, F.lit(False)) | f.isin("pptx", "ppt")),
        ("records", "paragraph", f == "json"),
        ("headings", "heading", clear_structure & (headings >= 5)),
    ]
    pair = lambda strategy, rule: F.struct(F.lit(strategy).alias("strategy"), F.lit(rule).alias("rule"))
    out = pair("semantic", "default")
    for rule, strategy, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), pair(strategy, rule)).otherwise(out)
    return out


def feature_distances(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, distance): Euclidean distance of two documents' vectors, to 6 places. features: (doc_id, i, x) long form; pairs: (a, b)."""
    one = features.select(F.col("doc_id").alias("a"), "i", "x")
    other = features.select(F.col("doc_id").alias("b"), "i", F.col("x").alias("y"))
    d = F.col("x") - F.col("y")
    return pairs.join(one, "a").join(other, ["b", "i"]).groupBy("a", "b").agg(F.round(F.sqrt(F.sum(d * d)), 6).alias("distance"))


def language_shares(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds zh, ja, ko and en shares by character ranges, and language and confidence (unknown, 0 without such characters; ties in that order)."""
    n = {k: F.regexp_count(text, F.lit(p)) for k, p in {"zh": r"[\x{4e00}-\x{9fff}]", "ja": r"[\x{3040}-\x{30ff}]", "ko": r"[\x{ac00}-\x{d7af}]", "en": r"[\x41-\x7a]"}.items()}
    out = df.select("*", *[v.cast("double").alias(f"_{k}") for k, v in n.items()]).withColumn("_all", F.col("_zh") + F.col("_ja") + F.col("_ko") + F.col("_en"))
    share = lambda x: F.when(F.col("_all") > 0, x / F.col("_all")).otherwise(F.lit(0.0))
    out = out.select(*df.columns, share(F.col("_zh")).alias("zh"), share(F.when(F.col("_ja") > 0, F.col("_ja") + 0.3 * F.col("_zh")).otherwise(F.lit(0.0))).alias("ja"), share(F.col("_ko")).alias("ko"), share(F.col("_en")).alias("en"))
    best = F.greatest("zh", "ja", "ko", "en")
    pick = F.when(best == 0, "unknown")
    for k in ("zh", "ja", "ko", "en"):
        pick = pick.when(F.col(k) == best, k)
    return out.withColumn("language", pick).withColumn("confidence", best)


def keyword_table(extra: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(domain, keyword), Chinese before English; `extra` adds keywords, for instance of other languages."""
    rows = [(d, k) for d in DOMAINS for k in CHINESE[d] + ENGLISH[d]] + [(d, k.lower()) for d, ks in (extra or {}).items() for k in ks]
    return list(dict.fromkeys(rows))


def keyword_hits(low: Column, extra: dict[str, list[str]] | None = None) -> Column:
    """An array: for each domain, in order, how many of its keywords a lower-case text has; null for a null text."""
    by: dict[str, list[str]] = {d: [] for d in domains_of(extra)}
    for d, k in keyword_table(extra):
        by[d].append(k)
    every = list(by.values())
    plain = [[k for k in ks if k.isascii()] for ks in every]

    @F.arrow_udf("array<int>")
    def hits(texts: pa.Array) -> pa.Array:
        # a text of ASCII characters has no other keywords
        count = lambda t: None if t is None else [sum(k in t for k in ks) for ks in (plain if t.isascii() else every)]
        return pa.array([count(t.as_py()) for t in texts], pa.list_(pa.int32()))

    return hits(low)


def domains_of(extra: dict[str, list[str]] | None = None) -> list[str]:
    return list(dict.fromkeys(d for d, _ in keyword_table(extra)))


def domain_shares(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, domain, share): the domains with a keyword in the text by their share of the hits, and general, which counts a tenth of all beside them; a text without hits is half general."""
    x = df.select(*keep, keyword_hits(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("_n"))
    total = F.aggregate("_n", F.lit(0), lambda s, n: s + n)
    each = F.arrays_zip(F.array(*[F.lit(d) for d in domains_of()]).alias("key"), F.col("_n").alias("value"))
    named = F.transform(F.filter(each, lambda e: e["value"] > 0), lambda e: F.struct(e["key"].alias("domain"), F.round(e["value"] / F.col("_total") / 1.1, 6).alias("share")))
    other = F.struct(F.lit("general").alias("domain"), F.when(F.col("_total") == 0, 0.5).otherwise(F.round(F.lit(0.1) / 1.1, 6)).alias("share"))
    return x.withColumn("_total", total).select(*keep, F.inline(F.concat(named, F.array(other))))


def classify_domain(df: DataFrame, text: str = "text", extra: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds domain, confidence and hits. A domain's score is the number of its keywords that occur in the text; p = score / all; fewer than two hits lower the
    confidence by 0.7; at most 0.95; ties by domain order; without a hit general, 0.5. Counted in the row: no join."""
    by = domains_of(extra)
    out = df.withColumn("_hits", keyword_hits(F.lower(F.col(text)), extra))
    out = out.select(*df.columns, *[F.col("_hits")[i].alias(f"_{d}") for i, d in enumerate(by)])
    total, best = sum((F.col(f"_{d}") for d in by), F.lit(0)), F.greatest(*[F.col(f"_{d}") for d in by])
    pick = F.when(total == 0, "general")
    for d in by:
        pick = pick.when(F.col(f"_{d}") == best, d)
    p = F.when(total == 0, F.lit(0.5)).otherwise(F.least(F.lit(0.95), best / total * F.when(best < 2, 0.7).otherwise(1.0)))
    return out.select(*df.columns, pick.alias("domain"), F.round(p, 6).alias("confidence"), best.cast("long").alias("hits"))


def adaptive_params(fmt: Column, chars: Column) -> tuple[Column, Column]:
    """Chunk size and overlap by format and length: int(base * multiplier), size within bounds, overlap at most 0.3 of the size."""
    size, over = F.lit(FORMATS["default"][0]), F.lit(FORMATS["default"][1])
    for k, (s, o) in FORMATS.items():
        size, over = F.when(F.lower(fmt) == k, s).otherwise(size), F.when(F.lower(fmt) == k, o).otherwise(over)
    by = lambda i: F.when(chars < SHORT_BELOW, LENGTHS["short"][i]).when(chars < LONG_FROM, LENGTHS["medium"][i]).otherwise(LENGTHS["long"][i])
    s = F.greatest(by(2), F.least((size * by(0)).cast("int"), by(3)))
    return s.cast("long"), F.least((over * by(1)).cast("int"), (s * 0.3).cast("int")).cast("long")


def recommend_index(rows: Column, model: Column) -> tuple[Column, Column]:
    """Index type by the number of vectors; metric by the model's name."""
    kind = F.lit(INDEX_RULES[-1][1])
    for most, name in reversed(INDEX_RULES[:-1]):
        kind = F.when(rows <= most, name).otherwise(kind)
    metric = F.when(F.lower(model).rlike("bge|qwen|openai|cohere|text-embedding|ada"), "COSINE").otherwise("L2")
    return kind, metric


def recommend_chunking(f: DataFrame, structured: Column) -> DataFrame:
    """(doc_id, rank, strategy, confidence): the three best rules; equal confidence in the order of the rules. f: rows of `flags`."""
    c = F.col
    rich, some = (c("table_count") >= 3) | (c("image_count") >= 3), (c("table_count") >= 2) | (c("image_count") >= 2)
    semantic = ~structured & (c("is_narrative") | ((c("heading_count") < 3) & (c("char_count") > 5000)))
    rule = lambda when, i, name, conf: F.when(when, F.struct((-conf).alias("minus"), F.lit(i).alias("turn"), F.lit(name).alias("strategy")))
    rules = [
        rule(structured, 0, "paragraph", F.lit(0.95)),
        rule((c("table_count") >= 1) | (c("image_count") >= 1), 1, "hybrid", F.when(rich, 0.92).when(some, 0.88).otherwise(0.85)),
        rule(c("clear_structure") & (c("heading_count") >= 5), 2, "heading", F.when(c("heading_count") > 10, 0.9).otherwise(0.8)),
        rule(c("is_technical") & (c("code_ratio") > 0.2), 3, "hybrid", F.lit(0.82)),
        rule(semantic, 4, "semantic", F.lit(0.85)),
        rule(~c("clear_structure") & ~structured & (c("char_count") > 10_000) & (c("table_count") == 0) & (c("image_count") == 0) & (c("heading_count") < 5) & ~(c("is_technical") & (c("code_ratio") > 0.2)), 5, "parent_child", F.lit(0.78)),
        rule((c("char_count") < 5000) | (c("complexity") == "low"), 6, "character", F.lit(0.6)),
        rule(~structured & ~semantic, 7, "semantic", F.lit(0.7)),
    ]
    top = F.slice(F.array_sort(F.filter(F.array(*rules), lambda x: x.isNotNull())), 1, 3)
    return f.select("doc_id", F.posexplode(top).alias("i", "r")).select("doc_id", (F.col("i") + 1).cast("long").alias("rank"), F.col("r.strategy").alias("strategy"), (-F.col("r.minus")).alias("confidence"))


def recommend_model(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, language, language_confidence, domain, domain_confidence, has_images, has_tables). (doc_id, model, score, rank) of every model."""
    c = F.col

    def pick(names: tuple[str, ...], values: tuple[float, ...], column: str, other: float) -> Column:
        out = F.lit(other)
        for n, v in zip(names, values, strict=True):
            out = F.when(c(column) == n, v).otherwise(out)
        return out

    wl = F.when(c("has_images"), 0.25).when(c("has_tables"), 0.35).otherwise(0.40)
    wd = F.when(c("has_images"), 0.25).when(c("has_tables"), 0.30).otherwise(0.35)
    wm = F.when(c("has_images"), 0.50).when(c("has_tables"), 0.35).otherwise(0.25)
    scores = []
    for name, (langs, doms, image) in MODELS.items():
        lang = pick(("zh", "en", "ja", "ko"), langs[:4], "language", langs[4]) * (0.5 + 0.5 * c("language_confidence"))
        dom = pick(("general", *DOMAINS), doms, "domain", doms[0]) * (0.5 + 0.5 * c("domain_confidence"))
        multi = F.when(c("has_images"), 1.0 if image >= 0.5 else 0.1).when(c("has_tables"), 0.9 if image >= 0.5 else 0.6).otherwise(0.8)
        scores.append(F.struct(F.lit(name).alias("model"), F.round(lang * wl + dom * wd + multi * wm, 6).alias("score")))
    x = docs.select("doc_id", F.explode(F.array(*scores)).alias("s")).select("doc_id", "s.model", "s.score")
    return x.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "model")).cast("long"))


def outliers(features: DataFrame, limit: float = 0.3) -> DataFrame:
    """features: (doc_id, i, x) long form. Documents whose distance from the mean vector is over `limit`, with the distance."""
    mean = features.groupBy("i").agg(F.avg("x").alias("m"))
    d = features.join(F.broadcast(mean), "i").groupBy("doc_id").agg(F.round(F.sqrt(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))), 6).alias("distance"))
    return d.filter(F.col("distance") > limit)
