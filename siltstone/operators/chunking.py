"""Chunkers: (id, text) rows to one row a chunk, with index, content, start and end.

Windows are arithmetic, so they are generated and cut inside the JVM; only folds whose next step depends on the last
(paragraph and sentence merging) run as Arrow functions, a document at a time. No chunker shuffles.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

#: The white space of `functions.text.SPACE`.
BLANKS = " \t\n\r\f\x0b"
CHUNK = "array<struct<content:string,start:long,end:long,records:boolean>>"


def _check(size: int, step: int) -> None:
    if not 0 < step <= size:
        raise ValueError(f"step {step} must be from 1 to the window size {size}")


def window_starts(n: Column, size: int, step: int) -> Column:
    """Starts of the windows over n characters: the last is the first that reaches the end; none for an empty text."""
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)) + 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: (i * step).cast("long"))).otherwise(F.array().cast("array<long>"))


def _numbered(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """Chunks (content, start, end) whose stripped content is not empty, numbered from 0 in order."""
    full = F.filter(F.transform(chunks, lambda c: F.struct(F.btrim(c["content"], F.lit(BLANKS)).alias("content"), c["start"].alias("start"), c["end"].alias("end"))), lambda c: c["content"] != "")
    rows = df.select(*keep, F.posexplode(full).alias("chunk_index", "c"))
    return rows.select(*keep, F.col("chunk_index").cast("long").alias("chunk_index"), F.col("c.content").alias("content"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.length("c.content").cast("long").alias("char_count"), T.word_count(F.col("c.content")).alias("word_count"))


def chunk_windows(df: DataFrame, size: int = 500, step: int = 450, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Sliding windows. Contents are stripped, offsets are those before stripping; empty windows take no index."""
    _check(size, step)
    t = F.col(text)
    at = lambda whole, start, length: F.substring(whole, (start + 1).cast("int"), length.cast("int"))
    # characters are counted once a text, not once a window; and as a character is found by reading the text from its start, windows are cut
    # from runs of as many windows as there are runs
    def run(n: Column, count: Column, many: Column, r: Column) -> Column:
        first = (r * many).cast("long")
        windows = F.sequence(F.lit(0).cast("long"), F.least(many.cast("long"), count - first) - 1)
        cut = lambda part: F.transform(windows, lambda i: F.struct(at(part, i * step, F.lit(size)).alias("content"), ((first + i) * step).alias("start"), F.least((first + i) * step + size, n).alias("end")))
        return once(at(t, first * step, many * step + size), cut)

    def runs(n: Column, count: Column) -> Column:
        return once(F.ceil(F.sqrt(count)).cast("long"), lambda many: F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(count / many).cast("long") - 1), lambda r: run(n, count, many, r))))

    cut = once(F.length(t).cast("long"), lambda n: F.when(n > 0, once(F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("long"), lambda count: runs(n, count))).otherwise(F.lit(None)))
    return _numbered(df, cut, list(keep))


def chunk_character(df: DataFrame, size: int = 500, overlap: int = 50, **kw) -> DataFrame:
    return chunk_windows(df, size, size - overlap, **kw)


def chunk_stream(df: DataFrame, segment: int = 100_000, size: int = 500, overlap: int = 50, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Segments of `segment` characters chunked alone (windows don't cross segments), positions in the whole text; index by document."""
    t = F.col("text")
    segments = window_starts(F.length(t).cast("long"), segment, segment)
    step = size - overlap

    def cut(s: Column) -> Column:
        n = F.least(F.length(t).cast("long") - s, F.lit(segment).cast("long"))
        return F.transform(window_starts(n, size, step), lambda w: F.struct(F.substring(t, (s + w + 1).cast("int"), F.least(F.lit(size).cast("long"), n - w).cast("int")).alias("content"), (s + w).alias("start"), (s + F.least(w + size, n)).alias("end")))

    return _numbered(df, F.flatten(F.transform(segments, cut)), list(keep))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with `value` evaluated once a row, however often `then` names it (inside a lambda Spark evaluates each mention)."""
    return F.element_at(F.transform(F.array(value), then), 1)


def last_break(window: Column, marks: tuple[str, ...], after: Column) -> Column:
    """Length of `window` up to and with the first character of the last of any of `marks` that begins after position `after` (0-based); null if none does."""
    def hits(back: Column) -> Column:
        n = F.length(back)
        end = lambda size: lambda at: F.when((at > 0) & (n - at - size + 1 > after), n - at - size + 2)
        hit = [once(F.locate(m[::-1], back), end(len(m))) for m in marks]
        return F.greatest(*hit, F.lit(None).cast("int")) if len(hit) > 1 else hit[0]

    return once(F.reverse(window), hits)


def chunk_parent(df: DataFrame, size: int = 2000, overlap: int = 200, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Parents end at the last sentence or paragraph mark in the last fifth of their window, if it has one; starts don't move, so text after a
    shortened end can be left out where the cut is longer than the overlap."""
    _check(size, size - overlap)
    t = F.col(text)
    n = F.length(t).cast("long")

    def cut(s: Column) -> Column:
        return once(F.substring(t, (s + 1).cast("int"), F.lit(size)), lambda w: once(end(w, s), lambda e: F.struct(F.substring(w, F.lit(1), e.cast("int")).alias("content"), s.alias("start"), (s + e).alias("end"))))

    def end(w: Column, s: Column) -> Column:
        return F.when(s + size < n, F.coalesce(last_break(w, ("。", ". ", "\n\n"), F.lit(int(size * 0.8))).cast("long"), F.lit(size).cast("long"))).otherwise(n - s)

    out = _numbered(df, F.transform(window_starts(n, size, size - overlap), cut), list(keep))
    return out.withColumn("parent_id", F.concat_ws("-", *keep, "chunk_index"))


def chunk_child(parents: DataFrame, size: int = 500, overlap: int = 50, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Children of parents: windows that end at the last blank or line end after four fifths; positions in the document are the parent's start
    plus the offset in the parent's (stripped) content."""
    _check(size, size - overlap)
    t = F.col("content")
    n = F.length(t).cast("long")

    def cut(s: Column) -> Column:
        return once(F.substring(t, (s + 1).cast("int"), F.lit(size)), lambda w: once(end(w, s), lambda e: F.struct(F.substring(w, F.lit(1), e.cast("int")).alias("content"), s.alias("start"), (s + e).alias("end"))))

    def end(w: Column, s: Column) -> Column:
        return F.when(s + size < n, F.coalesce(last_break(w, (" ", "\n"), F.lit(int(size * 0.8))).cast("long"), F.lit(size).cast("long"))).otherwise(n - s)

    src = parents.select(*keep, "parent_id", F.col("start").alias("parent_start"), "content")
    out = _numbered(src, F.transform(window_starts(n, size, size - overlap), cut), [*keep, "parent_id", "parent_start"])
    return out.withColumn("start", F.col("start") + F.col("parent_start")).withColumn("end", F.col("end") + F.col("parent_start")).drop("parent_start")


def parent_child_link(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Every parent with the number and the indexes of its children; 0 and none where it has none."""
    own = children.groupBy("parent_id").agg(F.count(F.lit(1)).alias("child_count"), F.array_sort(F.collect_list("chunk_index")).alias("child_ids"))
    return parents.select("parent_id").join(own, "parent_id", "left").select("parent_id", F.coalesce("child_count", F.lit(0)).cast("long").alias("child_count"), F.coalesce(F.array_join(F.transform("child_ids", lambda x: x.cast("string")), ","), F.lit("")).alias("child_ids"))


def parent_child_statistics(parents: DataFrame, children: DataFrame) -> DataFrame:
    """One row a size bucket of children (left-closed, empty ones too), with the totals beside it."""
    bounds = [0, 200, 500, 800, 1200]
    bucket = F.lit(0)
    for i, b in enumerate(bounds[1:], 1):
        bucket = F.when(F.col("char_count") >= b, i).otherwise(bucket)
    spark = parents.sparkSession
    names = spark.createDataFrame([(i, f"{b}-{bounds[i + 1] if i + 1 < len(bounds) else ''}") for i, b in enumerate(bounds)], "bucket int, size_range string")
    sizes = children.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    totals = parents.agg(F.count(F.lit(1)).alias("parents"), F.coalesce(F.floor(F.avg("char_count")), F.lit(0)).cast("long").alias("avg_parent_size")).crossJoin(children.agg(F.count(F.lit(1)).alias("children")))
    out = names.join(F.broadcast(sizes), "bucket", "left").crossJoin(F.broadcast(totals))
    return out.select("size_range", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "parents", "children", "avg_parent_size", F.when(F.col("parents") > 0, F.round(F.col("children") / F.col("parents"), 6)).otherwise(F.lit(0.0)).alias("avg_children"))


def is_record_text(text: Column) -> Column:
    """Texts of records: no blank line between paragraphs, and over half of the lines are `key: value`, or lines are long (mean over 50) and
    none is short (all over 30)."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda s: s != "")
    n = F.size(lines)
    keyed = F.size(F.filter(lines, lambda s: s.rlike(r"^[^:]{2,100}:[ \t\n\r\f\x0B]*.+$")))
    long = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x)) / n
    return (~text.contains("\n\n")) & (n > 1) & ((keyed / n > 0.5) | ((long > 50) & F.forall(lines, lambda s: F.length(s) > 30)))


def chunk_structured_records(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One chunk a non-empty line of record texts; other texts give none."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda s: s != "")
    rows = df.filter(is_record_text(F.col("text"))).select(*keep, F.posexplode(lines).alias("chunk_index", "content"))
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long")).withColumn("char_count", F.length("content").cast("long"))


def chunk_statistics(chunks: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Count and average, largest, least and total size of the chunks of each document."""
    c = F.col("char_count")
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(c), 6).alias("avg_size"), F.max(c).alias("max_size"), F.min(c).alias("min_size"), F.sum(c).alias("total_size"))


def chunk_preview(chunks: DataFrame, first: int = 5) -> DataFrame:
    """The first chunks of every document, with the number that it has in all."""
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    return chunks.filter(F.col("chunk_index") < first).join(n, "doc_id")


def _fold(df: DataFrame, fold: Callable[[str], list[tuple[str, int, int, bool]]], text: str, keep: tuple[str, ...]) -> DataFrame:
    """Applies a function of one whole text to each document; it returns (content, start, end, flag) tuples."""
    @F.pandas_udf(CHUNK)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([[{"content": c, "start": s, "end": e, "records": r} for c, s, e, r in fold(t or "")] for t in p])

    rows = df.select(*keep, F.posexplode(run(text)).alias("chunk_index", "c"))
    return rows.select(*keep, F.col("chunk_index").cast("long").alias("chunk_index"), F.col("c.content").alias("content"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.records").alias("records"), F.length("c.content").cast("long").alias("char_count"))


def paragraphs(text: str, least: int = 100, most: int = 1000) -> list[tuple[str, int, int, bool]]:
    """Paragraphs merged greedily: flushed before one that would pass `most` (blank lines between them not counted) and as soon as `least` is
    reached; one over `most` is cut. Record texts give a chunk a line."""
    import re

    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if "\n\n" not in text and len(lines) > 1:
        keyed = sum(1 for x in lines if re.match(r"[^:]{2,100}:\s*.+$", x))
        if keyed / len(lines) > 0.5 or (sum(map(len, lines)) / len(lines) > 50 and all(len(x) > 30 for x in lines)):
            out, at = [], 0
            for x in lines:
                at = text.index(x, at)
                out.append((x, at, at + len(x), True))
                at += len(x)
            return out
    spans, at = [], 0
    for gap in [*re.finditer(r"\n\s*\n", text), None]:
        end = gap.start() if gap else len(text)
        body = text[at:end]
        if body.strip():
            s = at + len(body) - len(body.lstrip())
            spans.append((s, s + len(body.strip())))
        at = gap.end() if gap else end
    out, held, size = [], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            out.append(("\n\n".join(text[a:b] for a, b in held), held[0][0], held[-1][1], False))
        held, size = [], 0

    for a, b in spans:
        if b - a > most:
            flush()
            out.extend((text[i : min(i + most, b)], i, min(i + most, b), False) for i in range(a, b, most))
            continue
        if held and size + b - a > most:
            flush()
        held.append((a, b))
        size += b - a
        if size >= least:
            flush()
    flush()
    return out


def chunk_paragraph(df: DataFrame, least: int = 100, most: int = 1000, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return _fold(df, lambda t: paragraphs(t, least, most), text, keep)


def split_sentences_py(text: str) -> list[str]:
    import re

    return [s.strip() for s in re.split(r"[。！？.!?]\s*", text) if s.strip()]


def merged_sentences(text: str, least: int = 300) -> list[tuple[str, int, int, bool]]:
    """Sentences joined by blanks. Where a sentence would bring the chunk to `least` characters (blanks not counted) the chunk ends before it. A chunk starts
    where its first sentence is found; it ends as far on as its content is long, the last one at the end of the text."""
    out, held, size, at = [], [], 0, 0
    for s in split_sentences_py(text):
        if held and size + len(s) >= least:
            body = " ".join(held)
            out.append((body, at, at + len(body), False))
            held, size, at = [], 0, text.find(s, at)
        held.append(s)
        size += len(s)
    if held:
        out.append((" ".join(held), at, len(text), False))
    return out


def chunk_sentences(df: DataFrame, least: int = 300, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return _fold(df, lambda t: merged_sentences(t, least), text, keep).drop("records")


def grouped_sentences(text: str, sents: list[str], likeness: Callable[[int], float], least: int, most: int, similar: float) -> list[tuple[str, int, int, bool]]:
    """Adjacent sentences joined while their likeness (of sentence i to the one before) is at least `similar` and the chunk fits `most`, or while the chunk is under
    `least` and fits 1.5 `most`; blanks are not counted. Positions are those of the first and last sentence; the last chunk ends with the text."""
    out, held, size, at = [], [sents[0]], len(sents[0]), 0

    def close(end: int | None) -> None:
        start = text.find(held[0], at)
        out.append((" ".join(held), start, text.find(held[-1], at) + len(held[-1]) if end is None else end, False))

    for i, s in enumerate(sents[1:], 1):
        longer = size + len(s)
        if (likeness(i) >= similar and longer <= most) or (size < least and longer <= most * 1.5):
            held.append(s)
            size = longer
        else:
            close(None)
            at = text.find(s, at)
            held, size = [s], len(s)
    close(len(text))
    return out


def semantic_chunks(text: str, least: int = 300, most: int = 1200, similar: float = 0.3) -> list[tuple[str, int, int, bool]]:
    """`grouped_sentences` by TF-IDF cosine. Fewer than two sentences, or one chunk of a text over 1.5 `most`: sentence merging instead."""
    import math
    import re
    from collections import Counter

    sents = split_sentences_py(text)
    if len(sents) < 2:
        return merged_sentences(text, least)
    bags = [Counter(re.findall(r"[一-鿿]|[a-zA-Z]+", s.lower())) for s in sents]
    df = Counter(t for b in bags for t in b)
    idf = {t: math.log(len(sents) / (n + 1)) for t, n in df.items()}
    vecs = [{t: n / sum(b.values()) * idf[t] for t, n in b.items()} for b in bags]

    def cos(i: int) -> float:
        a, b = vecs[i - 1], vecs[i]
        num = sum(v * b[t] for t, v in a.items() if t in b)
        den = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
        return num / den if den else 0.0

    out = grouped_sentences(text, sents, cos, least, most, similar)
    return merged_sentences(text, least) if len(out) == 1 and len(text) > most * 1.5 else out


def embedding_chunks(text: str, least: int = 300, most: int = 1200, similar: float = 0.7, dim: int = 64) -> list[tuple[str, int, int, bool]]:
    """`grouped_sentences` by the cosine of the sentences' hashed embeddings. Fewer than two sentences, or one without a token: by TF-IDF instead."""
    import hashlib
    import math
    import re

    sents, vecs = split_sentences_py(text), []
    for s in sents:
        v = [0.0] * dim
        for w in re.findall(r"[一-鿿]|[a-zA-Z0-9]+", s.lower()):
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:8], 16) % dim] += 1.0 if h[8] < "8" else -1.0
        vecs.append(v)
    if len(sents) < 2 or not all(any(v) for v in vecs):
        return semantic_chunks(text, least, most)

    def cos(i: int) -> float:
        a, b = vecs[i - 1], vecs[i]
        return sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))

    return grouped_sentences(text, sents, cos, least, most, similar)


def chunk_semantic_tfidf(df: DataFrame, least: int = 300, most: int = 1200, similar: float = 0.3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return _fold(df, lambda t: semantic_chunks(t, least, most, similar), text, keep).drop("records")


def chunk_semantic_embedding(df: DataFrame, least: int = 300, most: int = 1200, similar: float = 0.7, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """By embeddings, else by TF-IDF, else by sentences: each where the one before has nothing to go by."""
    return _fold(df, lambda t: embedding_chunks(t, least, most, similar), text, keep).drop("records")


def parents_page(parents: DataFrame, children: DataFrame, page: int, size: int, with_children: bool = True) -> DataFrame:
    """One page of each document's parents in order, each with its children (index and length) where wanted."""
    wanted = parents.filter((F.col("chunk_index") >= (page - 1) * size) & (F.col("chunk_index") < page * size)).select("doc_id", "parent_id", "chunk_index", "char_count")
    if not with_children:
        return wanted
    kids = children.select("parent_id", F.col("chunk_index").alias("child_index"), F.col("char_count").alias("child_chars"))
    return wanted.join(kids, "parent_id", "left").select("doc_id", "parent_id", "chunk_index", "char_count", "child_index", "child_chars")


def sentence_rows(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return df.select(*keep, F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "sentence")).withColumn("sentence_index", F.col("sentence_index").cast("long"))


def _word_lists(sents: DataFrame) -> DataFrame:
    """(doc_id, sentences): a document's sentences as (index, its words joined by blanks), in one row. The only shuffle of what follows: all of it stays within a document."""
    words = F.array_join(T.tokens(F.col("sentence"), T.WORD), " ")
    return sents.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("sentence_index").alias("i"), F.coalesce(words, F.lit("")).alias("words"))).alias("sentences"))


def _tfidf(sentences: list[dict]) -> dict[int, dict[str, float]]:
    """Weights of the words of each sentence that has any; rows of one index are one sentence."""
    tf: dict[int, Counter] = {}
    for s in sentences:
        if s["words"]:
            tf.setdefault(s["i"], Counter()).update(s["words"].split(" "))
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log(len(sentences) / (n + 1)) for t, n in df.items()}
    return {i: {t: n / total * idf[t] for t, n in c.items()} for i, c in tf.items() for total in (c.total(),)}


#: Documents whose weights are made before they are handed on.
AT_ONCE = 32


def _per_document(lists: DataFrame, rows: Callable[[list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """What `rows` yields of each document's sentences, after its doc_id."""
    kind = lists.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for at in range(0, p.num_rows, AT_ONCE):
                q = p.slice(at, AT_ONCE)
                found, place = [], []
                for k, s in enumerate(q.column("sentences").to_pylist()):
                    n = len(found)
                    found.extend(rows(s))
                    place.extend([k] * (len(found) - n))
                if found:
                    yield pa.RecordBatch.from_arrays([q.column("doc_id").take(pa.array(place, pa.int64())), *[pa.array(c) for c in zip(*found, strict=True)]], ["doc_id", *[f.split()[0] for f in schema.split(", ")]])

    return lists.mapInArrow(run, f"doc_id {kind}, {schema}")


def tfidf_sentences(sents: DataFrame) -> DataFrame:
    """(doc_id, sentence_index, term, weight): tf times ln(N / (df + 1)) with N and df counted in the document; weights can be negative. Rows without a document have none."""
    def rows(sentences: list[dict]) -> Iterator[tuple]:
        return ((i, t, x) for i, w in _tfidf(sentences).items() for t, x in w.items())

    return _per_document(_word_lists(sents.filter("doc_id IS NOT NULL")), rows, "sentence_index long, term string, weight double")


def adjacent_similarity(sents: DataFrame) -> DataFrame:
    """Cosine of every sentence (from the second) with the one before; 0 without a common term or with a zero norm, and for rows without a document."""
    def rows(sentences: list[dict]) -> Iterator[tuple]:
        w = _tfidf(sentences)
        norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in w.items()}
        for s in sentences:
            i, den = s["i"], norm.get(s["i"], 0.0) * norm.get(s["i"] - 1, 0.0)
            if i > 0:
                yield i, sum(x * w[i - 1][t] for t, x in w[i].items() if t in w[i - 1]) / den if den > 0 else 0.0

    out = _per_document(_word_lists(sents), rows, "sentence_index long, similarity double")
    return out.withColumn("similarity", F.when(F.col("doc_id").isNull(), 0.0).otherwise(F.round("similarity", 6)))


def chunk_coverage(chunks: DataFrame) -> DataFrame:
    """Share of a document that its chunks cover: touching and overlapping ranges count once, empty ones not."""
    from pyspark.sql import Window as W

    r = chunks.filter("end > start")
    w = W.partitionBy("doc_id").orderBy("start", "end")
    seen = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(seen, F.col("start"))))
    return r.withColumn("_fresh", fresh).groupBy("doc_id").agg(F.sum("_fresh").cast("long").alias("covered"))


def size_histogram(chunks: DataFrame) -> DataFrame:
    """Chunks by size bucket (left-closed)."""
    c = F.col("char_count")
    b = F.when(c < 200, "0-200").when(c < 500, "200-500").when(c < 800, "500-800").when(c < 1200, "800-1200").otherwise("1200-")
    return chunks.groupBy(b.alias("size_range")).agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("chars"))
