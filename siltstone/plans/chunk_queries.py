"""Queries of the chunkers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking as C
from siltstone.plans.common import CHUNKS, STRIP, WORDS, chunks, documents, strip_sql, table, windows_sql

SENTS = rf"""sents AS (SELECT doc_id, s AS sentence, i - 1 AS sentence_index FROM (
  SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM (
    SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？.!?][ \t\n\r\f\x0B]*'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS l FROM documents)))"""
TERMS = r"""terms AS (SELECT doc_id, sentence_index, unnest(regexp_extract_all(lower(sentence), '[\x{4e00}-\x{9fff}]|[a-zA-Z]+')) AS term FROM sents),
tf AS (SELECT doc_id, sentence_index, term, count(*) AS n FROM terms GROUP BY ALL),
len AS (SELECT doc_id, sentence_index, count(*) AS len FROM terms GROUP BY ALL),
df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
total AS (SELECT doc_id, count(*) AS sents FROM sents GROUP BY ALL),
w AS (SELECT doc_id, sentence_index, term, (n / len) * ln(sents / (df + 1)) AS weight FROM tf JOIN len USING (doc_id, sentence_index) JOIN df USING (doc_id, term) JOIN total USING (doc_id))"""


def break_sql(window: str, marks: list[str], after: str) -> str:
    """Length up to the first character of the last mark that begins after `after`, or null."""
    parts = []
    for m in marks:
        at = f"(length({window}) - strpos(reverse({window}), reverse({m})) - length({m}) + 1)"
        parts.append(f"CASE WHEN strpos(reverse({window}), reverse({m})) > 0 AND {at} > {after} THEN {at} + 1 END")
    return f"greatest({', '.join(parts)})"


NL2 = "(chr(10) || chr(10))"


def broken_sql(source: str, keep: str, text: str, size: int, step: int, marks: list[str], after: int) -> str:
    """Windows whose end moves back to a mark."""
    return f"""
  SELECT {keep}, row_number() OVER (PARTITION BY {keep} ORDER BY s) - 1 AS chunk_index, content, s AS start, s + e AS "end", length(content)::BIGINT AS char_count, {WORDS.format('content')}::BIGINT AS word_count FROM (
    SELECT {keep}, s, e, {strip_sql('substring(w, 1, e)')} AS content FROM (
      SELECT {keep}, s, w, CASE WHEN s + {size} < n THEN coalesce({break_sql('w', marks, str(after))}, {size}) ELSE n - s END AS e FROM (
        SELECT {keep}, s, n, substring({text}, (s + 1)::BIGINT, {size}) AS w FROM (
          SELECT {keep}, {text}, length({text})::BIGINT AS n, unnest(range(0, CASE WHEN length({text}) = 0 THEN 0 WHEN length({text}) <= {size} THEN 1 ELSE ((length({text}) - {size} + {step - 1}) // {step}) + 1 END)) * {step} AS s FROM {source}))))
  WHERE content <> ''"""


PARENTS = f"parents AS (SELECT *, doc_id || '-' || chunk_index AS parent_id FROM ({broken_sql('documents', 'doc_id', 'text', 2000, 1800, ["'。'", "'. '", NL2], 1600)}))"
CHILDREN = f"""kids AS (SELECT parents.doc_id, k.parent_id, k.chunk_index, k.content, k.start + parents.start AS start, k."end" + parents.start AS "end", k.char_count, k.word_count
  FROM ({broken_sql('parents', 'parent_id', 'content', 500, 450, ["' '", "chr(10)"], 400)}) k JOIN parents USING (parent_id))"""
COLS = 'chunk_index, content, start, "end", char_count, word_count'
LINES = rf"list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')"


def parents(s, d):
    return C.chunk_parent(documents(s, d))


def children(s, d):
    return C.chunk_child(parents(s, d))


def sents(s, d):
    return C.sentence_rows(documents(s, d))


def tfidf(s, d):
    return C.tfidf_sentences(sents(s, d)).select("doc_id", "sentence_index", "term", F.round("weight", 6).alias("weight"))


def coverage(s, d):
    return C.chunk_coverage(chunks(s, d))


def type_share(s, d):
    c = chunks(s, d).groupBy(F.when(F.col("char_count") < 100, "short").otherwise("text").alias("chunk_type")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("chunk_type", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("percent"))


def filter_sort(s, d):
    from pyspark.sql import Window as W

    c = chunks(s, d).filter("char_count >= 200")
    return c.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("char_count"), "chunk_index")).cast("long")).select("doc_id", "chunk_index", "char_count", "place")


def export(s, d):
    return chunks(s, d).select("doc_id", (F.col("chunk_index") + 1).alias("sequence"), "content", F.col("word_count").alias("token_count"))


QUERIES = {
    "chunk_character": lambda s, d: C.chunk_character(documents(s, d)),
    "chunk_sliding_window": lambda s, d: C.chunk_windows(documents(s, d), 300, 100),
    "chunk_stream": lambda s, d: C.chunk_stream(documents(s, d), segment=2000),
    "chunk_parent": parents,
    "chunk_child": children,
    "parent_child_link": lambda s, d: C.parent_child_link(parents(s, d), children(s, d)),
    "parent_child_statistics": lambda s, d: C.parent_child_statistics(parents(s, d), children(s, d)),
    "parent_child_tree": lambda s, d: parents(s, d).select("doc_id", "parent_id", F.col("char_count").alias("value")).join(children(s, d).groupBy("parent_id").agg(F.sum("char_count").alias("child_value")), "parent_id", "left").select("doc_id", "parent_id", "value", F.coalesce("child_value", F.lit(0)).cast("long").alias("child_value")),
    "chunk_structured_records": lambda s, d: C.chunk_structured_records(documents(s, d)),
    "chunk_paragraph": lambda s, d: C.chunk_paragraph(documents(s, d)),
    "chunk_sentences": lambda s, d: C.chunk_sentences(documents(s, d)),
    "chunk_semantic_embedding": lambda s, d: C.chunk_semantic_embedding(documents(s, d)),
    "parents_page": lambda s, d: C.parents_page(parents(s, d), children(s, d), 2, 2),
    "chunk_semantic_tfidf": lambda s, d: C.chunk_semantic_tfidf(documents(s, d)),
    "split_sentences": sents,
    "tfidf_sentences": tfidf,
    "adjacent_sentence_similarity": lambda s, d: C.adjacent_similarity(sents(s, d)),
    "chunk_statistics": lambda s, d: C.chunk_statistics(chunks(s, d)),
    "chunk_preview": lambda s, d: C.chunk_preview(chunks(s, d)).select("doc_id", "chunk_index", "content", "total_chunks"),
    "chunk_coverage": coverage,
    "chunk_size_histogram": lambda s, d: C.size_histogram(chunks(s, d)),
    "chunk_type_share": type_share,
    "filter_sort_chunks": filter_sort,
    "export_csv_json": export,
    "count_words_cjk": lambda s, d: documents(s, d).select("doc_id", (T.word_count(F.col("text")) + F.regexp_count("text", F.lit(r"[\x{4e00}-\x{9fff}]"))).cast("long").alias("words")),
}

ORACLE = {
    "chunk_character": windows_sql(500, 450),
    "chunk_sliding_window": windows_sql(300, 100),
    "chunk_stream": f"""
WITH seg AS (SELECT doc_id, text, length(text)::BIGINT AS n, unnest(range(0, (length(text) + 1999) // 2000)) * 2000 AS b FROM documents),
pos AS (SELECT doc_id, text, b, m, unnest(range(0, CASE WHEN m <= 500 THEN 1 ELSE ((m - 500 + 449) // 450) + 1 END)) * 450 AS w FROM (SELECT *, least(n - b, 2000) AS m FROM seg)),
cut AS (SELECT doc_id, b + w AS s, b + least(w + 500, m) AS e, {strip_sql('substring(text, (b + w + 1)::BIGINT, least(500, m - w)::BIGINT)')} AS content FROM pos)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, content, s AS start, e AS "end", length(content)::BIGINT AS char_count, {WORDS.format('content')}::BIGINT AS word_count FROM cut WHERE content <> ''""",
    "chunk_parent": f"WITH {PARENTS} SELECT doc_id, {COLS}, parent_id FROM parents",
    "chunk_child": f"WITH {PARENTS}, {CHILDREN} SELECT doc_id, parent_id, {COLS} FROM kids",
    "parent_child_link": f"WITH {PARENTS}, {CHILDREN} SELECT parents.parent_id, count(kids.parent_id) AS child_count, coalesce(string_agg(kids.chunk_index::VARCHAR, ',' ORDER BY kids.chunk_index), '') AS child_ids FROM parents LEFT JOIN kids USING (parent_id) GROUP BY parents.parent_id",
    "parent_child_statistics": f"""WITH {PARENTS}, {CHILDREN}, b AS (SELECT * FROM (VALUES (0, '0-200'), (1, '200-500'), (2, '500-800'), (3, '800-1200'), (4, '1200-')) t(i, size_range)),
c AS (SELECT CASE WHEN char_count < 200 THEN 0 WHEN char_count < 500 THEN 1 WHEN char_count < 800 THEN 2 WHEN char_count < 1200 THEN 3 ELSE 4 END AS i, count(*) AS n FROM kids GROUP BY 1),
p AS (SELECT count(*) AS parents, floor(avg(char_count))::BIGINT AS avg_parent_size FROM parents), k AS (SELECT count(*) AS children FROM kids)
SELECT size_range, coalesce(n, 0) AS n, parents, children, avg_parent_size, round(children / parents, 6) AS avg_children FROM b LEFT JOIN c USING (i), p, k""",
    "parent_child_tree": f"WITH {PARENTS}, {CHILDREN} SELECT parents.doc_id, parents.parent_id, parents.char_count AS value, coalesce(sum(kids.char_count), 0)::BIGINT AS child_value FROM parents LEFT JOIN kids USING (parent_id) GROUP BY ALL",
    "chunk_structured_records": rf"""
WITH l AS (SELECT doc_id, text, {LINES} AS lines FROM documents),
k AS (SELECT * FROM l WHERE strpos(text, chr(10) || chr(10)) = 0 AND len(lines) > 1 AND (len(list_filter(lines, lambda x: regexp_matches(x, '^[^:]{{2,100}}:[ \t\n\r\f\x0B]*.+$'))) / len(lines) > 0.5
  OR (list_sum(list_transform(lines, lambda x: length(x))) / len(lines) > 50 AND list_min(list_transform(lines, lambda x: length(x))) > 30)))
SELECT doc_id, unnest(range(0, len(lines))) AS chunk_index, unnest(lines) AS content, length(unnest(lines))::BIGINT AS char_count FROM k""",
    "parents_page": f"WITH {PARENTS}, {CHILDREN} SELECT p.doc_id, p.parent_id, p.chunk_index, p.char_count, k.chunk_index AS child_index, k.char_count AS child_chars FROM parents p LEFT JOIN kids k USING (parent_id) WHERE p.chunk_index BETWEEN 2 AND 3",
    "chunk_sentences": f"""WITH {SENTS}, l AS (SELECT doc_id, text, list(sentence ORDER BY sentence_index) AS l FROM sents JOIN documents USING (doc_id) GROUP BY ALL),
e AS (SELECT doc_id, text, list_transform(l, lambda s: {{done: []::STRUCT(c VARCHAR, a BIGINT)[], held: s, size: length(s)::BIGINT, pos: 0::BIGINT}}) AS e FROM l),
r AS (SELECT doc_id, length(text) AS n, list_reduce(e, lambda a, b: CASE WHEN a.size + b.size >= 300
  THEN {{done: list_append(a.done, {{c: a.held, a: a.pos}}), held: b.held, size: b.size, pos: (a.pos + strpos(substring(text, a.pos + 1), b.held) - 1)::BIGINT}}
  ELSE {{done: a.done, held: a.held || ' ' || b.held, size: (a.size + b.size)::BIGINT, pos: a.pos}} END) AS r FROM e),
u AS (SELECT doc_id, n, unnest(list_append(r.done, {{c: r.held, a: r.pos}})) AS c, unnest(range(0, len(r.done) + 1)) AS chunk_index, len(r.done) AS last FROM r)
SELECT doc_id, chunk_index, c.c AS content, c.a AS start, (CASE WHEN chunk_index = last THEN n ELSE c.a + length(c.c) END)::BIGINT AS "end", length(c.c)::BIGINT AS char_count FROM u""",
    "split_sentences": f"WITH {SENTS} SELECT doc_id, sentence_index, sentence FROM sents",
    "tfidf_sentences": f"WITH {SENTS}, {TERMS} SELECT doc_id, sentence_index, term, round(weight, 6) AS weight FROM w",
    "adjacent_sentence_similarity": f"""WITH {SENTS}, {TERMS},
norms AS (SELECT doc_id, sentence_index, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY ALL),
num AS (SELECT a.doc_id, a.sentence_index, sum(a.weight * b.weight) AS num FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.sentence_index = b.sentence_index + 1 AND a.term = b.term GROUP BY ALL)
SELECT s.doc_id, s.sentence_index, round(CASE WHEN n1.norm * n2.norm > 0 THEN coalesce(num, 0) / (n1.norm * n2.norm) ELSE 0 END, 6) AS similarity
FROM sents s LEFT JOIN num USING (doc_id, sentence_index) LEFT JOIN norms n1 USING (doc_id, sentence_index) LEFT JOIN norms n2 ON n2.doc_id = s.doc_id AND n2.sentence_index = s.sentence_index - 1 WHERE s.sentence_index > 0""",
    "chunk_statistics": f"WITH {CHUNKS} SELECT doc_id, count(*) AS chunks, round(avg(char_count), 6) AS avg_size, max(char_count) AS max_size, min(char_count) AS min_size, sum(char_count)::BIGINT AS total_size FROM chunks GROUP BY doc_id",
    "chunk_preview": f"WITH {CHUNKS} SELECT doc_id, chunk_index, content, n AS total_chunks FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks) WHERE chunk_index < 5",
    "chunk_coverage": f"""WITH {CHUNKS}, m AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM chunks WHERE "end" > start)
SELECT doc_id, sum(greatest(0, "end" - greatest(start, coalesce(seen, start))))::BIGINT AS covered FROM m GROUP BY doc_id""",
    "chunk_size_histogram": f"WITH {CHUNKS} SELECT CASE WHEN char_count < 200 THEN '0-200' WHEN char_count < 500 THEN '200-500' WHEN char_count < 800 THEN '500-800' WHEN char_count < 1200 THEN '800-1200' ELSE '1200-' END AS size_range, count(*) AS n, sum(char_count)::BIGINT AS chars FROM chunks GROUP BY 1",
    "chunk_type_share": f"WITH {CHUNKS} SELECT chunk_type, n, round(n * 100.0 / sum(n) OVER (), 2) AS percent FROM (SELECT CASE WHEN char_count < 100 THEN 'short' ELSE 'text' END AS chunk_type, count(*) AS n FROM chunks GROUP BY 1)",
    "filter_sort_chunks": f"WITH {CHUNKS} SELECT doc_id, chunk_index, char_count, row_number() OVER (PARTITION BY doc_id ORDER BY char_count DESC, chunk_index) AS place FROM chunks WHERE char_count >= 200",
    "export_csv_json": f"WITH {CHUNKS} SELECT doc_id, chunk_index + 1 AS sequence, content, word_count AS token_count FROM chunks",
    "count_words_cjk": rf"SELECT doc_id, ({WORDS.format('text')} + len(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]')))::BIGINT AS words FROM documents",
}
