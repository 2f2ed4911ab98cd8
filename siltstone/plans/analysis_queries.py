"""Queries of document analysis and of the recommenders, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import analysis as A
from siltstone.plans.common import CHUNKS, WORDS, chunks, documents, strip_sql, table


def features(s, d):
    return A.flags(A.document_features(documents(s, d)))


def markdown(s, d):
    """Documents with every line that has no full stop made a heading, so that heading rules have work."""
    t = F.concat_ws("\n", F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) < 40, F.concat(F.repeat(F.lit("#"), (F.length(x) % 3 + 1).cast("int")), F.lit(" "), x)).otherwise(x)))
    return documents(s, d).select("doc_id", t.alias("text"))


def languages(s, d):
    x = A.language_shares(documents(s, d))
    r = lambda c: F.round(c, 6).alias(c)
    return x.select("doc_id", "language", r("confidence"), r("zh"), r("ja"), r("ko"), r("en"))


def chunk_language(s, d):
    x = A.language_shares(chunks(s, d).select("doc_id", F.col("content").alias("text")))
    long = x.select("doc_id", F.explode(F.create_map(F.lit("zh"), "zh", F.lit("ja"), "ja", F.lit("ko"), "ko", F.lit("en"), "en")).alias("lang", "p")).filter("p > 0")
    sums = long.groupBy("doc_id", "lang").agg(F.sum("p").alias("p"))
    total = sums.groupBy("doc_id").agg(F.sum("p").alias("all"), F.max_by("lang", F.struct("p", "lang")).alias("language"), F.max("p").alias("top"))
    return total.select("doc_id", "language", F.round(F.col("top") / F.col("all"), 6).alias("confidence"))


def domains(s, d):
    return A.classify_domain(documents(s, d)).select("doc_id", "domain", "confidence", "hits")


def analysed(s, d):
    f = features(s, d).select("doc_id", "table_count", "image_count", "char_count")
    lang = A.language_shares(documents(s, d)).select("doc_id", "language", F.round("confidence", 6).alias("language_confidence"))
    dom = domains(s, d).select("doc_id", "domain", F.col("confidence").alias("domain_confidence"))
    return f.join(lang, "doc_id").join(dom, "doc_id").select("*", (F.col("image_count") > 0).alias("has_images"), (F.col("table_count") > 0).alias("has_tables"))


def vector(s, d):
    """Long form of the 13 features: languages zh, en, ja, ko, other; domains; share of other content."""
    lang = A.language_shares(documents(s, d))
    x = lang.join(domains(s, d).withColumnRenamed("confidence", "p"), "doc_id")
    one = lambda name: F.when(F.col("domain") == name, F.col("p")).otherwise(F.lit(0.0))
    values = [F.col("zh"), F.col("en"), F.col("ja"), F.col("ko"), F.lit(0.0), *[one(n) for n in ("general", *A.DOMAINS)], F.lit(0.0)]
    return x.select("doc_id", F.posexplode(F.array(*values)).alias("i", "x"))


def size_params(s, d):
    x = table(s, d, "documents").select("doc_id", "n_chars", F.element_at(F.array(*[F.lit(k) for k in A.FORMATS]), (F.col("doc_id") % len(A.FORMATS) + 1).cast("int")).alias("format"))
    size, over = A.adaptive_params(F.col("format"), F.col("n_chars"))
    return x.select("doc_id", "format", size.alias("chunk_size"), over.alias("overlap"))


def index_choice(s, d):
    x = table(s, d, "events").groupBy("user_id", "event_type").agg((F.count(F.lit(1)) * 3000 * F.max("user_id")).alias("rows"))
    kind, metric = A.recommend_index(F.col("rows"), F.concat("event_type", F.when(F.col("user_id") % 2 == 0, "-bge").otherwise("")))
    return x.select("user_id", "event_type", "rows", kind.alias("index_type"), metric.alias("metric"))


def chunking_choice(s, d):
    m = markdown(s, d)
    return A.recommend_chunking(A.flags(A.document_features(m)), A.is_structured(F.col("text")))


def with_format(s, d):
    """Documents with a format, a name, a metadata format and a loader by doc_id, each missing for some."""
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % len(xs) + 1).cast("int"))
    return documents(s, d).select("doc_id", "text", pick("", "XLSX", "").alias("file_format"), pick("", "a.b/report.CSV", "notes", ".hidden", "deck.tar.pptx").alias("file_name"), pick("", "docx", "", "csv").alias("metadata_format"), pick("docling", "TXT", "csv", "html", "pdf", "xml", "md").alias("loader"))


def formatted(s, d):
    x = with_format(s, d)
    return x.withColumn("format", A.document_format(F.col("file_format"), F.col("file_name"), F.col("metadata_format"), F.col("loader")))


def text_strategies(s, d):
    x = A.flags(A.document_features(formatted(s, d)))
    flat, log = A.is_flattened_tabular(F.col("text"), F.col("format")), A.is_log_like(F.col("text"))
    slides = A.is_slide_like(F.col("text"), F.col("format"), F.when(F.col("doc_id") % 11 == 0, 3))
    x = x.select("doc_id", "format", "clear_structure", "heading_count", (F.col("doc_id") % 2 == 0).alias("layout"), flat.alias("flat"), log.alias("log"), slides.alias("slides"))
    chosen = A.recommend_text_strategy(F.col("format"), F.col("layout"), F.col("flat"), F.col("log"), F.col("slides"), F.col("clear_structure"), F.col("heading_count"))
    return x.withColumn("chosen", chosen).select("doc_id", "format", F.col("chosen.strategy").alias("strategy"), F.col("chosen.rule").alias("rule"))


def neighbour_distances(s, d):
    v = vector(s, d).withColumn("x", F.round("x", 6))
    ids = documents(s, d).select("doc_id")
    return A.feature_distances(v, ids.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")))


def batch_choice(s, d):
    a = analysed(s, d)
    n = a.agg(F.count(F.lit(1)).alias("n"))
    top = lambda c: a.groupBy(c).agg(F.count(F.lit(1)).alias("k")).agg(F.max_by(c, F.struct("k", c)).alias(c), F.max("k").alias(f"{c}_n"))
    x = n.crossJoin(top("language")).crossJoin(top("domain"))
    return x.select("language", "domain", F.round(F.col("language_n") / F.col("n"), 6).alias("language_share"), F.round(F.col("domain_n") / F.col("n"), 6).alias("domain_share"))


COUNTS = ("char_count", "word_count", "heading_count", "heading_levels", "paragraph_count", "avg_paragraph", "max_paragraph", "table_count", "image_count", "code_count", "code_ratio")

QUERIES = {
    "doc_features": lambda s, d: A.document_features(markdown(s, d)).select("doc_id", *COUNTS),
    "has_clear_structure": lambda s, d: A.flags(A.document_features(markdown(s, d))).select("doc_id", "clear_structure"),
    "is_technical_narrative": lambda s, d: features(s, d).select("doc_id", "is_technical", "is_narrative"),
    "estimated_complexity": lambda s, d: A.flags(A.document_features(markdown(s, d))).select("doc_id", "complexity"),
    "is_structured_data": lambda s, d: documents(s, d).select("doc_id", A.is_structured(F.col("text")).alias("structured")),
    "is_log_like": lambda s, d: documents(s, d).select("doc_id", A.is_log_like(F.col("text")).alias("log_like")),
    "line_uniformity": lambda s, d: documents(s, d).select("doc_id", A.line_uniformity(F.col("text")).alias("uniformity")),
    "document_format": lambda s, d: formatted(s, d).select("doc_id", "format"),
    "is_flattened_tabular": lambda s, d: formatted(s, d).select("doc_id", A.is_flattened_tabular(F.col("text"), F.col("format")).alias("flattened")),
    "is_slide_like": lambda s, d: formatted(s, d).select("doc_id", A.is_slide_like(F.col("text"), F.col("format"), F.when(F.col("doc_id") % 11 == 0, 3)).alias("slides")),
    "recommend_text_strategy": text_strategies,
    "feature_distance": neighbour_distances,
    "detect_language": languages,
    "detect_language_aggregate": chunk_language,
    "domain_shares": lambda s, d: A.domain_shares(documents(s, d)),
    "classify_domain": domains,
    "document_analysis": lambda s, d: analysed(s, d).drop("char_count"),
    "feature_vector": lambda s, d: vector(s, d).select("doc_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x")),
    "detect_outliers": lambda s, d: A.outliers(vector(s, d)),
    "smart_params": size_params,
    "recommend_index": index_choice,
    "recommend_chunking": chunking_choice,
    "recommend_model": lambda s, d: A.recommend_model(analysed(s, d)),
    "recommend_batch": batch_choice,
}

MD = "md AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) < 40 THEN repeat('#', (length(x) % 3 + 1)::INTEGER) || ' ' || x ELSE x END), chr(10)) AS text FROM documents)"
PARA = rf"list_transform(list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\n\r\f\x0B]*\n'), lambda x: {strip_sql('x')}), lambda x: x <> ''), lambda x: length(x))"


def feat(source: str) -> str:
    return rf"""f0 AS (SELECT doc_id, text, {PARA} AS para, regexp_extract_all(text, '(?s)```.*?```') AS fences FROM {source}),
f1 AS (SELECT doc_id, text, length(text)::BIGINT AS char_count, {WORDS.format('text')}::BIGINT AS word_count,
  (len(regexp_extract_all(text, '(?m)^#{{1,6}}[ \t]+.+$')) + len(regexp_extract_all(text, '(?i)<h[1-6][^>]*>')))::BIGINT AS heading_count,
  len(list_distinct(list_transform(regexp_extract_all(text, '(?m)^(#{{1,6}})[ \t]+.+$', 1), lambda x: length(x))))::BIGINT AS heading_levels,
  len(para)::BIGINT AS paragraph_count, CASE WHEN len(para) > 0 THEN round(list_sum(para) / len(para), 6) ELSE 0 END AS avg_paragraph, coalesce(list_max(para), 0)::BIGINT AS max_paragraph,
  (len(regexp_extract_all(text, '(?m)^\|.*\|$\n^\|[-:\s|]+\|$')) + len(regexp_extract_all(text, '(?is)<table[^>]*>.*?</table>')))::BIGINT AS table_count, (len(regexp_extract_all(text, '!\[[^\]]*\]\([^)]+\)')) + len(regexp_extract_all(text, '(?i)<img[^>]+>')))::BIGINT AS image_count,
  len(fences)::BIGINT AS code_count, CASE WHEN length(text) > 0 THEN round(coalesce(list_sum(list_transform(fences, lambda x: length(x))), 0) / length(text), 6) ELSE 0 END AS code_ratio FROM f0),
f AS (SELECT *, heading_count >= 3 AND heading_levels >= 2 AS clear_structure, code_ratio > 0.2 OR code_count > 3 OR table_count > 2 AS is_technical,
  heading_count < 3 AND table_count < 2 AND code_count < 2 AND avg_paragraph > 200 AS is_narrative,
  CASE WHEN c >= 4 THEN 'high' WHEN c >= 2 THEN 'medium' ELSE 'low' END AS complexity FROM (SELECT *,
    CASE WHEN heading_count > 10 THEN 2 WHEN heading_count > 5 THEN 1 ELSE 0 END + CASE WHEN table_count > 5 OR image_count > 10 THEN 2 WHEN table_count > 0 OR image_count > 0 THEN 1 ELSE 0 END
    + CASE WHEN code_ratio > 0.3 THEN 2 WHEN code_count > 0 THEN 1 ELSE 0 END + CASE WHEN char_count > 50000 THEN 1 ELSE 0 END AS c FROM f1))"""


LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')"
STRUCTURED = rf"(len({LINES}) >= 3 AND len(list_filter({LINES}, lambda x: regexp_matches(x, '^.{{2,50}}:[ \t]+.+$'))) / len({LINES}) > 0.6)"


def lang(source: str, key: str = "doc_id") -> str:
    n = lambda p: f"len(regexp_extract_all(text, '{p}'))::DOUBLE"
    return f"""l0 AS (SELECT {key}, {n('[\\x{{4e00}}-\\x{{9fff}}]')} AS z, {n('[\\x{{3040}}-\\x{{30ff}}]')} AS j, {n('[\\x{{ac00}}-\\x{{d7af}}]')} AS k, {n('[\\x41-\\x7a]')} AS e FROM {source}),
l1 AS (SELECT {key}, CASE WHEN z + j + k + e > 0 THEN z / (z + j + k + e) ELSE 0 END AS zh, CASE WHEN j > 0 THEN (j + 0.3::DOUBLE * z) / (z + j + k + e) ELSE 0 END AS ja, CASE WHEN z + j + k + e > 0 THEN k / (z + j + k + e) ELSE 0 END AS ko, CASE WHEN z + j + k + e > 0 THEN e / (z + j + k + e) ELSE 0 END AS en FROM l0),
l AS (SELECT *, greatest(zh, ja, ko, en) AS confidence, CASE WHEN greatest(zh, ja, ko, en) = 0 THEN 'unknown' WHEN zh = greatest(zh, ja, ko, en) THEN 'zh' WHEN ja = greatest(zh, ja, ko, en) THEN 'ja' WHEN ko = greatest(zh, ja, ko, en) THEN 'ko' ELSE 'en' END AS language FROM l1)""".replace("{{", "{").replace("}}", "}")


def domain_sql() -> str:
    by: dict[str, list[str]] = {}
    for d, k in A.keyword_table():
        by.setdefault(d, []).append(k)
    counts = ", ".join("(" + " + ".join(f"contains(lower(text), '{k}')::INTEGER" for k in ks) + f") AS {d}" for d, ks in by.items())
    names = list(by)
    best, total = f"greatest({', '.join(names)})", " + ".join(names)
    pick = " ".join(f"WHEN {d} = {best} THEN '{d}'" for d in names)
    return f"""d0 AS (SELECT doc_id, {counts} FROM documents), dm AS (SELECT doc_id, CASE WHEN {total} = 0 THEN 'general' {pick} END AS domain,
  round(CASE WHEN {total} = 0 THEN 0.5 ELSE least(0.95, {best} / ({total}) * CASE WHEN {best} < 2 THEN 0.7 ELSE 1 END) END, 6)::DOUBLE AS confidence, {best}::BIGINT AS hits FROM d0)"""


AN = f"""{feat('documents')}, {lang('documents')}, {domain_sql()}, an AS (SELECT f.doc_id, table_count, image_count, language, round(l.confidence, 6) AS language_confidence, domain, dm.confidence AS domain_confidence, image_count > 0 AS has_images, table_count > 0 AS has_tables
FROM f JOIN l USING (doc_id) JOIN dm USING (doc_id))"""
FV = f"""{lang('documents')}, {domain_sql()}, fv AS (SELECT doc_id, unnest(range(0, 13)) AS i, unnest([zh, en, ja, ko, 0, {', '.join(f"CASE WHEN domain = '{n}' THEN dm.confidence ELSE 0 END" for n in ('general', *A.DOMAINS))}, 0]) AS x FROM l JOIN dm USING (doc_id))"""


def model_sql() -> str:
    rows = []
    for name, (langs, doms, image) in A.MODELS.items():
        lw = " ".join(f"WHEN '{n}' THEN {v}" for n, v in zip(("zh", "en", "ja", "ko"), langs[:4], strict=True))
        dw = " ".join(f"WHEN '{n}' THEN {v}" for n, v in zip(("general", *A.DOMAINS), doms, strict=True))
        rows.append(f"""SELECT doc_id, '{name}' AS model, round(((CASE language {lw} ELSE {langs[4]} END)::DOUBLE * (0.5 + 0.5 * language_confidence)) * (CASE WHEN has_images THEN 0.25 WHEN has_tables THEN 0.35 ELSE 0.40 END)::DOUBLE
  + ((CASE domain {dw} END)::DOUBLE * (0.5 + 0.5 * domain_confidence)) * (CASE WHEN has_images THEN 0.25 WHEN has_tables THEN 0.30 ELSE 0.35 END)::DOUBLE
  + (CASE WHEN has_images THEN {1.0 if image >= 0.5 else 0.1} WHEN has_tables THEN {0.9 if image >= 0.5 else 0.6} ELSE 0.8 END)::DOUBLE * (CASE WHEN has_images THEN 0.50 WHEN has_tables THEN 0.35 ELSE 0.25 END)::DOUBLE, 6) AS score FROM an""")
    return " UNION ALL ".join(rows)


def params_sql() -> str:
    fmt = "[" + ", ".join(f"'{k}'" for k in A.FORMATS) + "]"
    size = "CASE fmt " + " ".join(f"WHEN '{k}' THEN {s}" for k, (s, _) in A.FORMATS.items()) + " END"
    over = "CASE fmt " + " ".join(f"WHEN '{k}' THEN {o}" for k, (_, o) in A.FORMATS.items()) + " END"
    by = lambda i: f"(CASE WHEN n_chars < {A.SHORT_BELOW} THEN {A.LENGTHS['short'][i]} WHEN n_chars < {A.LONG_FROM} THEN {A.LENGTHS['medium'][i]} ELSE {A.LENGTHS['long'][i]} END)"
    return f"""WITH x AS (SELECT doc_id, n_chars, {fmt}[doc_id % {len(A.FORMATS)} + 1] AS fmt FROM documents),
y AS (SELECT *, greatest({by(2)}, least(floor({size} * {by(0)}::DOUBLE), {by(3)}))::BIGINT AS chunk_size, floor({over} * {by(1)}::DOUBLE)::BIGINT AS o FROM x)
SELECT doc_id, fmt AS format, chunk_size, least(o, floor(chunk_size * 0.3::DOUBLE))::BIGINT AS overlap FROM y"""


CHOICE = f"""WITH {MD}, {feat('md')}, x AS (SELECT *, {STRUCTURED} AS st, NOT {STRUCTURED} AND (is_narrative OR (heading_count < 3 AND char_count > 5000)) AS sem FROM f), r AS (
SELECT doc_id, 0 AS turn, 'paragraph' AS strategy, 0.95 AS c FROM x WHERE st
UNION ALL SELECT doc_id, 1, 'hybrid', CASE WHEN table_count >= 3 OR image_count >= 3 THEN 0.92 WHEN table_count >= 2 OR image_count >= 2 THEN 0.88 ELSE 0.85 END FROM x WHERE table_count >= 1 OR image_count >= 1
UNION ALL SELECT doc_id, 2, 'heading', CASE WHEN heading_count > 10 THEN 0.9 ELSE 0.8 END FROM x WHERE clear_structure AND heading_count >= 5
UNION ALL SELECT doc_id, 3, 'hybrid', 0.82 FROM x WHERE is_technical AND code_ratio > 0.2
UNION ALL SELECT doc_id, 4, 'semantic', 0.85 FROM x WHERE sem
UNION ALL SELECT doc_id, 5, 'parent_child', 0.78 FROM x WHERE NOT clear_structure AND NOT st AND char_count > 10000 AND table_count = 0 AND image_count = 0 AND heading_count < 5 AND NOT (is_technical AND code_ratio > 0.2)
UNION ALL SELECT doc_id, 6, 'character', 0.6 FROM x WHERE char_count < 5000 OR complexity = 'low'
UNION ALL SELECT doc_id, 7, 'semantic', 0.7 FROM x WHERE NOT st AND NOT sem)
SELECT doc_id, rank, strategy, c::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, turn) AS rank FROM r) WHERE rank <= 3"""

NAMED = """fm AS (SELECT doc_id, text, ['', 'XLSX', ''][doc_id % 3 + 1] AS ff, ['', 'csv', '', '', 'pptx'][doc_id % 5 + 1] AS ending, ['', 'docx', '', 'csv'][doc_id % 4 + 1] AS mf, ['', 'txt', 'csv', 'html', '', 'xml', 'md'][doc_id % 7 + 1] AS ld FROM documents),
fmt AS (SELECT doc_id, text, coalesce(nullif(lower(ff), ''), nullif(ending, ''), nullif(mf, ''), ld) AS format FROM fm)"""

ORACLE = {
    "document_format": f"WITH {NAMED} SELECT doc_id, format FROM fmt",
    "is_flattened_tabular": rf"WITH {NAMED}, n AS (SELECT doc_id, format, text, list_transform(({LINES})[1:30], lambda x: length(x)) AS n FROM fmt), m AS (SELECT *, list_sum(n) / len(n) AS m FROM n) SELECT doc_id, coalesce(format IN ('xlsx', 'xls', 'csv') AND len(regexp_extract_all(text, '(?m)^\|.*\|$\n^\|[-:\s|]+\|$')) = 0 AND len(n) >= 3 AND m >= 20 AND sqrt(list_sum(list_transform(n, lambda x: (x - m) * (x - m))) / len(n)) / m < 0.5, false) AS flattened FROM m",
    "is_slide_like": rf"WITH {NAMED}, p AS (SELECT doc_id, format, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\n\r\f\x0B]*\n'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS p FROM fmt), q AS (SELECT *, list_sum(list_transform(p, lambda x: length(x))) / len(p) AS m, flatten(list_transform(p, lambda x: string_split(x, chr(10)))) AS l FROM p), r AS (SELECT *, len(list_filter(l, lambda x: regexp_matches(x, '^[ \t\n\r\f\x0B]*[-•*▪▸►][ \t\n\r\f\x0B]'))) / len(l) AS b FROM q) SELECT doc_id, format IN ('pptx', 'ppt') OR doc_id % 11 = 0 OR coalesce(len(p) >= 3 AND CASE WHEN format IN ('docx', 'doc') THEN m < 100 AND b > 0.6 ELSE m < 300 AND b > 0.3 END, false) AS slides FROM r",
    "feature_distance": f"WITH {FV}, r AS (SELECT doc_id, i, round(x, 6) AS x FROM fv) SELECT a.doc_id AS a, b.doc_id AS b, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS distance FROM r a JOIN r b ON b.doc_id = a.doc_id + 1 AND a.i = b.i GROUP BY ALL",
    "doc_features": f"WITH {MD}, {feat('md')} SELECT doc_id, {', '.join(COUNTS)} FROM f",
    "has_clear_structure": f"WITH {MD}, {feat('md')} SELECT doc_id, clear_structure FROM f",
    "is_technical_narrative": f"WITH {feat('documents')} SELECT doc_id, is_technical, is_narrative FROM f",
    "estimated_complexity": f"WITH {MD}, {feat('md')} SELECT doc_id, complexity FROM f",
    "is_structured_data": f"SELECT doc_id, {STRUCTURED} AS structured FROM documents",
    "is_log_like": rf"SELECT doc_id, len(l) >= 5 AND list_sum(list_transform(l, lambda x: regexp_matches(x, '^\d{{4}}[-/]\d{{2}}[-/]\d{{2}}[ \tT]\d{{2}}:\d{{2}}')::INTEGER + regexp_matches(x, '(?i)^(INFO|DEBUG|WARN|ERROR|FATAL|WARNING|TRACE)[ \t]')::INTEGER)) / len(l) > 0.4 AS log_like FROM (SELECT doc_id, ({LINES})[1:30] AS l FROM documents)",
    "line_uniformity": f"SELECT doc_id, CASE WHEN len(n) < 3 OR m < 10 THEN 0 ELSE round(greatest(0, least(1, 1 - sqrt(list_sum(list_transform(n, lambda x: (x - m) * (x - m))) / len(n)) / m)), 3) END::DOUBLE AS uniformity FROM (SELECT doc_id, n, list_sum(n) / len(n) AS m FROM (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: {strip_sql('x')} <> '')[1:50], lambda x: length(x)) AS n FROM documents))",
    "detect_language": f"WITH {lang('documents')} SELECT doc_id, language, round(confidence, 6) AS confidence, round(zh, 6) AS zh, round(ja, 6) AS ja, round(ko, 6) AS ko, round(en, 6) AS en FROM l",
    "detect_language_aggregate": f"WITH {CHUNKS}, {lang('(SELECT doc_id, content AS text FROM chunks)')}, s AS (SELECT doc_id, 'zh' AS lang, sum(zh) AS p FROM l GROUP BY 1 UNION ALL SELECT doc_id, 'ja', sum(ja) FROM l GROUP BY 1 UNION ALL SELECT doc_id, 'ko', sum(ko) FROM l GROUP BY 1 UNION ALL SELECT doc_id, 'en', sum(en) FROM l GROUP BY 1) SELECT doc_id, lang AS language, round(p / t, 6) AS confidence FROM (SELECT *, sum(p) OVER (PARTITION BY doc_id) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, lang DESC) AS r FROM s WHERE p > 0) WHERE r = 1",
    "domain_shares": f"""WITH h AS ({' UNION ALL '.join(f"SELECT doc_id, '{x}' AS domain, " + ' + '.join(f"contains(lower(coalesce(text, '')), '{k}')::INTEGER" for y, k in A.keyword_table() if y == x) + ' AS n FROM documents' for x in A.DOMAINS)}), t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM h)
SELECT doc_id, domain, round(n / total / 1.1::DOUBLE, 6) AS share FROM t WHERE n > 0 UNION ALL SELECT DISTINCT doc_id, 'general', CASE WHEN total = 0 THEN 0.5 ELSE round(0.1::DOUBLE / 1.1::DOUBLE, 6) END FROM t""",
    "classify_domain": f"WITH {domain_sql()} SELECT doc_id, domain, confidence, hits FROM dm",
    "document_analysis": f"WITH {AN} SELECT * FROM an",
    "feature_vector": f"WITH {FV} SELECT doc_id, i, round(x, 6) AS x FROM fv",
    "detect_outliers": f"WITH {FV}, m AS (SELECT i, avg(x) AS m FROM fv GROUP BY 1) SELECT * FROM (SELECT doc_id, round(sqrt(sum((x - m) * (x - m))), 6) AS distance FROM fv JOIN m USING (i) GROUP BY 1) WHERE distance > 0.3",
    "smart_params": params_sql(),
    "recommend_index": "WITH x AS (SELECT user_id, event_type, count(*) * 3000 * max(user_id) AS rows FROM events GROUP BY ALL) SELECT user_id, event_type, rows, CASE WHEN rows <= 9999 THEN 'FLAT' WHEN rows <= 499999 THEN 'HNSW' WHEN rows <= 4999999 THEN 'IVF_SQ8' ELSE 'IVF_PQ' END AS index_type, CASE WHEN user_id % 2 = 0 THEN 'COSINE' ELSE 'L2' END AS metric FROM x",
    "recommend_chunking": CHOICE,
    "recommend_model": f"WITH {AN}, m AS ({model_sql()}) SELECT doc_id, model, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, model) AS rank FROM m",
    "recommend_batch": f"""WITH {AN}, a AS (SELECT language, count(*) AS k FROM an GROUP BY 1 ORDER BY k DESC, language DESC LIMIT 1), b AS (SELECT domain, count(*) AS k FROM an GROUP BY 1 ORDER BY k DESC, domain DESC LIMIT 1)
SELECT language, domain, round(a.k / (SELECT count(*) FROM an), 6) AS language_share, round(b.k / (SELECT count(*) FROM an), 6) AS domain_share FROM a, b""",
}

ORACLE["recommend_text_strategy"] = f"""WITH {feat('documents')}, a AS ({ORACLE['document_format']}), b AS ({ORACLE['is_flattened_tabular']}), c AS ({ORACLE['is_log_like']}), e AS ({ORACLE['is_slide_like']}),
r AS (SELECT doc_id, format, CASE WHEN flattened THEN 'flattened table' WHEN format IN ('xlsx', 'xls', 'csv') AND doc_id % 2 <> 0 THEN 'sheet without layout' WHEN log_like THEN 'log'
  WHEN slides OR format IN ('pptx', 'ppt') THEN 'slides' WHEN format = 'json' THEN 'records' WHEN clear_structure AND heading_count >= 5 THEN 'headings' ELSE 'default' END AS rule
  FROM f JOIN a USING (doc_id) JOIN b USING (doc_id) JOIN c USING (doc_id) JOIN e USING (doc_id))
SELECT doc_id, format, CASE rule WHEN 'default' THEN 'semantic' WHEN 'headings' THEN 'heading' ELSE 'paragraph' END AS strategy, rule FROM r"""
