"""Secret scans over an incremental blob ledger (DataFrame functions only).

A blob is a distinct text, named by its SHA-256. A ledger is two Parquet tables in a shared folder: `scanned`
(blob, rule, version) and `findings` (blob, rule, version, start, end). A scan content-addresses every historical
version of every path, keeps the (blob, rule-version) pairs that the ledger hasn't seen, runs the rules on those blobs
alone, appends both tables, and joins the findings back to all paths and versions that hold the blob.

Positions are code points, ends exclusive. They come from the pieces between matches (`split`) and the matches
(`regexp_extract_all`): both walk the same leftmost, non-overlapping matches, so running lengths give every start.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import set_aside, workdir


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans. pattern: a regular expression; (?i) folds ASCII letters alone, as in Java. probe: a cheap pattern that every text with
    a match has. group, least: the group whose length must reach `least`, else the match is dropped (it still consumes text)."""

    kind: str
    pattern: str
    probe: str
    group: int
    least: int
    version: int = 1


#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The method's own rules, beside the base.
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"

RULES = (
    Rule("assign", ASSIGN, r"(?i)password|passwd|secret|token|api_?key", 2, 8),
    Rule("access", ACCESS, r"AKIA[A-Z0-9]{12}", 0, 16),
    Rule("hex", HEX, r"[0-9a-f]{32}", 0, 32),
    Rule("pem", PEM, r"-----BEGIN ", 0, 0),
    Rule("jwt", JWT, r"eyJ", 0, 0),
)
BASE = ("assign", "access", "hex")


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start: int, end: int>> of the rule's matches in `text`; empty where there is none."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    # gap i precedes match i, so a match starts after all gaps up to its own and all matches before it
    walk = F.aggregate(
        F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("len"), F.transform(part, F.length).alias("part")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found")),
        lambda s, m: F.struct(
            (s["at"] + m["gap"] + F.coalesce(m["len"], F.lit(0))).alias("at"),
            F.when(m["part"] >= rule.least, F.concat(s["found"], F.array(F.struct((s["at"] + m["gap"]).alias("start"), (s["at"] + m["gap"] + m["len"]).alias("end"))))).otherwise(s["found"]).alias("found"),
        ),
        lambda s: s["found"],
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(text.rlike(rule.probe), walk).otherwise(none)


class Ledger:
    """The ledger in folder `path` (made when first written). Rules are scanned once per blob and version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except Exception as e:  # a ledger that nothing was written to yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, rule string, version int")

    def findings(self) -> DataFrame:
        return self._read("findings", "blob string, rule string, version int, start int, `end` int")

    def scan(self, texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> int:
        """Scan what is unseen of `texts` (columns blob, text); returns the number of blobs scanned.

        One row per new blob reaches the rules: copies are merged before and after the shuffle. A blob is marked
        as scanned only after its findings are written: after a lost run it is scanned again, finds the same, and equal findings count once.
        """
        blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
        seen = self.scanned()
        done = seen.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("done"))
        fresh = blobs.join(done, "blob", "left") if seen.head(1) else blobs.withColumn("done", F.lit(None).cast("array<string>"))
        name = lambda r: f"{r.kind}@{r.version}"
        known = F.coalesce("done", F.array().cast("array<string>"))
        fresh = fresh.filter(F.size(F.array_except(F.array(*[F.lit(name(r)) for r in rules]), known)) > 0)
        todo = lambda r: ~F.array_contains(known, name(r))
        hit = fresh.select("blob", F.array(*[F.when(todo(r), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("at"))) for r in rules]).alias("per_rule"))
        batch = workdir(self.spark, "ledger-batch")
        hit.select("blob", F.filter("per_rule", lambda x: x.isNotNull()).alias("per_rule")).write.parquet(batch)
        got = self.spark.read.parquet(batch).select("blob", F.inline("per_rule"))
        got.select("blob", "rule", "version", F.inline("at")).write.mode("append").parquet(f"{self.path}/findings")
        got.select("blob", "rule", "version").write.mode("append").parquet(f"{self.path}/scanned")
        return self.spark.read.parquet(batch).count()


def scan_history(history: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, keep_text: bool = False) -> DataFrame:
    """history: any columns and `text` (null: empty), one row per path and version. Without `keep_text` the text goes. Adds blob and found: array<struct<kind, start, end>>,
    sorted by start, then kind as listed in `rules`; empty arrays where nothing was found. Repeated rows each get theirs. Own columns named blob or found
    go on as name_own. An empty table gives no rows."""
    history = set_aside(history, ["blob", "found"])
    body = F.coalesce("text", F.lit(""))
    named = history.withColumn("blob", F.sha2(body.cast("binary"), 256))
    ledger.scan(named.select("blob", body.alias("text")), rules)
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    wanted = None
    for r in rules:
        c = (F.col("rule") == r.kind) & (F.col("version") == r.version)
        wanted = c if wanted is None else wanted | c
    found = (
        ledger.findings().filter(wanted).groupBy("blob")
        .agg(F.sort_array(F.collect_set(F.struct(F.col("start"), order[F.col("rule")].alias("turn"), F.col("rule").alias("kind"), F.col("end")))).alias("found"))
    )
    none = F.array().cast("array<struct<start:int,turn:int,kind:string,end:int>>")
    paths = named if keep_text else named.drop("text")
    return paths.join(found.hint("shuffle_hash") if keep_text else found, "blob", "left").withColumn("found", F.coalesce("found", none))


def redacted(scanned: DataFrame) -> DataFrame:
    """Replaces each found span of `text` by [kind]. A span that begins inside an earlier one is swallowed by it. Null stays null."""
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(
        "found",
        start,
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]")).alias("out")),
        ).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return scanned.withColumn("text", F.when(F.size("found") > 0, cut).otherwise(text))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan_history(docs, Ledger(spark, workdir(spark, "ledger")))
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return out.select("doc_id", *[n(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _spelled(pattern: str) -> str:
    """A pattern that begins with (?i), with each of its ASCII letters outside classes and escapes as a class of both cases: SQL's engine would fold letters beyond ASCII too."""
    if not pattern.startswith("(?i)"):
        return pattern
    return re.sub(r"\\x[0-9a-f]{2}|\\.|\[[^\]]*\]|[a-z]", lambda m: m[0] if len(m[0]) > 1 else f"[{m[0].upper()}{m[0]}]", pattern[4:])


def _sql() -> str:
    q = lambda s: _spelled(s).replace("'", "''")
    parts = []
    for i, r in enumerate(RULES):
        parts.append(f"""
  SELECT blob, {i} AS turn, '{r.kind}' AS kind, gaps, whole, part, {r.least} AS least FROM (
    SELECT blob, string_split_regex(text, '{q(r.pattern)}') AS gaps, regexp_extract_all(text, '{q(r.pattern)}', 0) AS whole,
      regexp_extract_all(text, '{q(r.pattern)}', {r.group}) AS part FROM blobs WHERE regexp_matches(text, '{q(r.probe)}'))""")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS blob FROM documents),
blobs AS (SELECT DISTINCT blob, text FROM docs),
raw AS ({' UNION ALL '.join(parts)}),
each AS (SELECT blob, turn, kind, gaps, whole, part, least, unnest(range(1, len(whole) + 1)) AS i FROM raw),
places AS (SELECT blob, turn, kind, length(part[i]) AS n, least, length(whole[i]) AS w,
  list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS s FROM each),
found AS (SELECT blob, turn, kind, s::BIGINT AS s, (s + w)::BIGINT AS e FROM places WHERE n >= least),
per AS (SELECT blob, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, turn) FILTER (WHERE turn < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, turn) AS spans FROM found GROUP BY blob)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per USING (blob)
"""


ORACLE = _sql()
