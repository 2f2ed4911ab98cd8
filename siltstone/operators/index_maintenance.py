"""Changes to an index, and the texts that go to the embedder. Updates are a delete and an insert by key: one anti-join and one union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(index: DataFrame, rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """`index` with `rows` in place of those with the same key, and the rest of `rows` added."""
    return index.join(rows.select(key), key, "left_anti").unionByName(rows.select(*index.columns))


def delete(index: DataFrame, keys: DataFrame, key: str = "vec_id") -> DataFrame:
    return index.join(keys.select(key), key, "left_anti")


def multimodal_text(kind: Column, text: Column, caption: Column) -> Column:
    """What is embedded of a chunk: images by their caption, tables and code with a label, texts as they are."""
    # The labels.
    return F.when(kind == "image", F.concat(F.lit("[图片] "), F.coalesce(caption, F.substring(text, 1, 150)))).when(kind == "table", F.concat(F.lit("[表格] "), text)).when(kind == "code", F.concat(F.lit("[代码] "), text)).otherwise(text)


def prepare_chunk_text(kind: Column, content: Column, alt: Column, caption: Column, before: Column, after: Column, has_path: Column, loaded: Column) -> Column:
    """Text that a multimodal model gets for a chunk. Pictures with a path: caption, description and 200 characters of context on either side, each marked; where
    the picture could not be loaded, the same unmarked in one line with 150 characters. Other chunks, and pictures with nothing to say, keep their content."""
    said = lambda c, x: F.when(F.coalesce(c, F.lit("")) != "", x)
    last = lambda c, n: F.when(F.length(c) > n, F.right(c, F.lit(n))).otherwise(c)
    named = F.when(alt != "Image", alt)
    marked = F.concat_ws("\n", said(caption, F.concat(F.lit("图片标题: "), caption)), said(named, F.concat(F.lit("图片描述: "), named)), said(before, F.concat(F.lit("前文: "), last(before, 200))), said(after, F.concat(F.lit("后文: "), F.left(after, F.lit(200)))))
    plain = F.concat_ws(" ", said(caption, caption), said(named, named), said(before, last(before, 150)), said(after, F.left(after, F.lit(150))))
    text = F.when(F.coalesce(loaded, F.lit(False)), marked).otherwise(plain)
    return F.when((kind == "image") & F.coalesce(has_path, F.lit(False)) & (text != ""), text).otherwise(content)


def contextual_prefix(chunks: DataFrame, contexts: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The context of each chunk on a line before it; chunks without one stay. contexts: (key, context)."""
    x = chunks.join(contexts, key, "left")
    return x.withColumn("content", F.when(F.length("context") > 0, F.concat_ws("\n", "context", "content")).otherwise(F.col("content"))).drop("context")


def finite(c: Column) -> Column:
    """0 for null, NaN and infinite numbers."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)
