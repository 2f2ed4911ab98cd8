"""Column expressions over text. All offsets are code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]"
#: One Han character, or a run of ASCII letters and digits (accented letters split tokens).
TOKEN = r"[\x{4e00}-\x{9fff}]|[a-zA-Z0-9]+"
#: As TOKEN, without digits.
WORD = r"[\x{4e00}-\x{9fff}]|[a-zA-Z]+"
SENTENCE_END = r"[。！？.!?][ \t\n\r\f\x0B]*"


def with_value(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with `value` evaluated once a row: a column named in the function of an array is else evaluated anew at each of its elements."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(c: Column) -> Column:
    """Without white space at both ends (`trim` alone takes only blanks)."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def words(c: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(c, rf"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def tokens(c: Column, pattern: str = TOKEN) -> Column:
    """Lower-case tokens in order, repeats included."""
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def sentences(c: Column) -> Column:
    """Sentences in order, without their end marks; decimals split too; empty ones dropped."""
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: s != "")


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams; none for shorter texts."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, n)))).otherwise(F.array().cast("array<string>"))


def content_hash(c: Column) -> Column:
    """sha256:hex; 64 zeros for an empty or null text."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit("sha256:" + "0" * 64)).otherwise(F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256)))
