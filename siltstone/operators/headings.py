"""Heading structure of texts with Markdown or HTML headings: sections, paths, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators.chunking import chunk_paragraph


#: An HTML heading on one line.
HTML = r"(?i)<h([1-6])>(.*?)</h\1>"
FOUND = "array<struct<at:int,level:int,title:string>>"


def _html_headings(line: Column) -> Column:
    """Headings of one line with their offsets: the pieces between matches and the matches take turns."""
    gaps = F.transform(F.split(line, HTML, -1), F.length)
    whole = F.transform(F.regexp_extract_all(line, F.lit(HTML), F.lit(0)), F.length)
    each = F.arrays_zip(gaps.alias("gap"), whole.alias("len"), F.regexp_extract_all(line, F.lit(HTML), F.lit(1)).alias("level"), F.regexp_extract_all(line, F.lit(HTML), F.lit(2)).alias("title"))
    walk = F.aggregate(
        each,
        F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("found")),
        lambda s, m: F.struct(
            (s["at"] + m["gap"] + F.coalesce(m["len"], F.lit(0))).alias("at"),
            F.when(m["len"].isNull(), s["found"]).otherwise(F.concat(s["found"], F.array(F.struct((s["at"] + m["gap"]).alias("at"), m["level"].cast("int").alias("level"), T.strip(m["title"]).alias("title"))))).alias("found"),
        ),
        lambda s: s["found"],
    )
    return F.when(F.lower(line).contains("</h"), walk).otherwise(F.array().cast(FOUND))


def heading_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, level, title, seq): Markdown and HTML headings with their offset; lines carry a running sum of lengths, by document."""
    line = df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    at = F.coalesce(F.sum(F.length("line") + 1).over(W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    mark = F.struct(F.lit(0).alias("at"), F.length(F.regexp_extract("line", r"^(#{1,6})", 1)).alias("level"), T.strip(F.regexp_extract("line", r"^#{1,6}[ \t]+(.+)$", 1)).alias("title"))
    found = F.concat(F.when(F.col("line").rlike(r"^#{1,6}[ \t]+.+$"), F.array(mark)).otherwise(F.array().cast(FOUND)), _html_headings(F.col("line")))
    rows = line.withColumn("_line", at.cast("long")).select(key, "_line", F.explode(found).alias("h"))
    seq = F.row_number().over(W.partitionBy(key).orderBy("start")).cast("long")
    return rows.select(key, (F.col("_line") + F.col("h.at")).alias("start"), F.col("h.level").cast("long").alias("level"), F.col("h.title").alias("title")).withColumn("seq", seq)


def heading_trails(h: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds trail: titles of the enclosing headings and the heading's own. A heading of a level ends the deeper and equal ones before it."""
    w = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    out = h
    for lv in range(1, 7):
        out = out.withColumn(f"_t{lv}", F.last(F.when(F.col("level") == lv, F.struct("seq", "title")), ignorenulls=True).over(w))
        out = out.withColumn(f"_s{lv}", F.max(F.when(F.col("level") < lv, F.col("seq"))).over(w))
    parts = [F.when((F.col("level") >= lv) & F.col(f"_t{lv}").isNotNull() & (F.col(f"_t{lv}.seq") > F.coalesce(F.col(f"_s{lv}"), F.lit(0))), F.col(f"_t{lv}.title")) for lv in range(1, 7)]
    return out.withColumn("trail", F.array_compact(F.array(*parts))).select(*h.columns, "trail")


def heading_paths(h: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds path: the titles of `heading_trails`, joined."""
    return heading_trails(h, key).withColumn("path", F.array_join("trail", " > ")).drop("trail")


def sections(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One chunk a heading: from it to the next; texts with fewer than two headings give none (see `sections_or_paragraphs`). Text before the first
    heading is left out."""
    h = heading_paths(heading_rows(df, key, text), key)
    w = W.partitionBy(key)
    h = h.withColumn("n", F.count(F.lit(1)).over(w)).filter("n >= 2").withColumn("_next", F.lead("start").over(w.orderBy("seq")))
    x = h.join(df.select(key, text), key)
    body = T.strip(F.substring(text, (F.col("start") + 1).cast("int"), (F.coalesce("_next", F.length(text).cast("long")) - F.col("start")).cast("int")))
    return x.select(key, (F.col("seq") - 1).alias("chunk_index"), "level", "title", "path", "start", body.alias("content"))


#: Characters of content, headings aside, under which a section is joined to its neighbour.
SHORT = 100
SECTION = "struct<level:long,title:string,path:string,start:long,content:string,merged:array<string>>"


def merge_short_sections(sections: DataFrame, key: str = "doc_id", least: int = SHORT) -> DataFrame:
    """Sections of a document in order; one with fewer than `least` characters of content takes in the next one, if that lies deeper, else goes to the
    one before, if it lies deeper than that. A joined section keeps its first heading and the lesser level, and lists the headings it took in.

    One document's sections meet in one row: they are pieces of one text.
    """
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), T.strip), lambda x: (x != "") & ~x.rlike(r"^#{1,6}[ \t\n\r\f\x0B]+"))
    pure = lambda c: F.aggregate(lines(c), F.lit(0), lambda n, x: n + F.length(x))
    each = F.struct("level", "title", "path", "start", "content", F.array().cast("array<string>").alias("merged"))
    rows = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", each.alias("s")))).alias("_all"))

    def joined(a: Column, b: Column) -> Column:
        return F.struct(F.least(a["level"], b["level"]).alias("level"), a["title"].alias("title"), a["path"].alias("path"), a["start"].alias("start"), F.concat(a["content"], F.lit("\n\n"), b["content"]).alias("content"), F.concat(a["merged"], F.array(b["title"])).alias("merged"))

    def closed(done: Column, cur: Column) -> Column:
        last = F.element_at(done, -1)
        up = (pure(cur["content"]) < least) & (F.size(done) > 0) & (cur["level"] > F.try_element_at(done, F.lit(-1))["level"])
        return F.when(up, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined(last, cur)))).otherwise(F.concat(done, F.array(cur)))

    def step(state: Column, x: Column) -> Column:
        done, cur = state["done"], state["cur"]
        down = (pure(cur["content"]) < least) & (x["s"]["level"] > cur["level"])
        return F.struct(F.when(down, done).otherwise(closed(done, cur)).alias("done"), F.when(down, joined(cur, x["s"])).otherwise(x["s"]).alias("cur"))

    first = F.struct(F.array().cast(f"array<{SECTION}>").alias("done"), F.element_at("_all", 1)["s"].cast(SECTION).alias("cur"))
    walk = F.aggregate(F.slice("_all", 2, F.size("_all")), first, step, lambda s: closed(s["done"], s["cur"]))
    out = rows.select(key, F.posexplode(walk).alias("chunk_index", "s"))
    return out.select(key, F.col("chunk_index").cast("long").alias("chunk_index"), "s.level", "s.title", "s.path", "s.start", "s.content", F.array_join("s.merged", " > ").alias("merged_headings"))


def sections_or_paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = SHORT) -> DataFrame:
    """The sections, short ones joined (`least` 0: none is), and the paragraph chunks of every text with fewer than two headings (fallback true; level, title,
    path and merged_headings are null)."""
    headed = heading_rows(df, key, text).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select(key)
    rest = chunk_paragraph(df.join(headed, key, "left_anti"), text=text, keep=(key,))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("level", "long"), ("title", "string"), ("path", "string"))]
    rest = rest.select(key, "chunk_index", *none, F.col("start").cast("long").alias("start"), "content", F.lit(None).cast("string").alias("merged_headings"), F.lit(True).alias("fallback"))
    own = sections(df, key, text)
    own = merge_short_sections(own, key, least) if least else own.withColumn("merged_headings", F.lit(""))
    return own.withColumn("fallback", F.lit(False)).unionByName(rest)


def heading_parents(h: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seq, parent): the nearest earlier heading of a smaller level; null at the top."""
    w = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    before = [F.max(F.when(F.col("level") == lv, F.col("seq"))).over(w) for lv in range(1, 6)]
    named = h.select("*", *[b.alias(f"_b{i}") for i, b in enumerate(before, 1)])
    up = F.greatest(*[F.when(F.col("level") > i, F.col(f"_b{i}")) for i in range(1, 6)])
    return named.select(key, "seq", up.alias("parent"))


def inject_paths(chunks: DataFrame, h: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, path, section_title, parent_heading): path, title and enclosing title of the last heading at or before each chunk's start; an empty path and nulls before the
    first (an as-of join by document: one union and one window)."""
    trail = heading_trails(h, key).select(key, F.col("start").alias("at"), F.lit(0).alias("kind"), "trail", F.lit(None).cast("long").alias("chunk_index"))
    own = chunks.select(key, F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("trail"), "chunk_index")
    w = W.partitionBy(key).orderBy("at", "kind", "chunk_index").rowsBetween(W.unboundedPreceding, 0)
    x = trail.unionByName(own).withColumn("trail", F.last("trail", ignorenulls=True).over(w)).filter("kind = 1")
    return x.select(key, "chunk_index", F.coalesce(F.array_join("trail", " > "), F.lit("")).alias("path"), F.try_element_at("trail", F.lit(-1)).alias("section_title"), F.try_element_at("trail", F.lit(-2)).alias("parent_heading"))
