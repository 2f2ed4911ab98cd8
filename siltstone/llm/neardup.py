"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Every text's shingles are runs of five lower-case words. Document frequencies of all documents are counted in a table of
   SKETCH hashed counters (bounded, whatever the corpus). Shingles that share a counter share its sum, so in a very large corpus the
   rarest shingles look commoner than they are and all weights draw together: at 1e10 documents of 300 shingles idf is at most 1.1, not 1.25.
2. A shingle weighs tf * idf with idf = 1 + RARITY * ln(N / df) / ln(N + 2), from 1 to 1 + RARITY: common passages weigh less, but not so
   much that the few own words of a member of a large group of copies outweigh all that it shares with the group.
3. SAMPLES consistent weighted samples of each distinct text are banded. Small buckets give all their pairs; a large one gives pairs of each
   member with a few representatives: some random, and the member that meets most others in its bands. So pairs grow with the rows.
4. Pairs whose samples agree often enough are verified by the exact weighted Jaccard similarity of their whole texts.
5. Verified links are joined to classes by large-star and small-star rounds, each written to the shared folder.
6. The members of large buckets that still hold several classes are joined exactly: two texts of the least similarity share a shingle among
   the rarest of each, and what follows that shingle in both leaves room for it. At first each text meets some members of the class that has most of such
   a shingle's list, and classes that are linked so become one; then all pairs of different classes are compared. Their links complete the classes.
Texts with the same words in the same order are one node from the start; copies are never expanded into pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import broadcast_if, discard, kept, small_batches, staged
from siltstone.llm.textvec import mix, shingles

WORDS, SIMILARITY = 5, 0.8
#: Samples and rows of a band: a pair at 0.8 meets in some band but for (1 - 0.8^2)^12 < 5e-6.
SAMPLES, ROWS = 24, 2
#: Samples that must agree before the exact comparison: a pair at 0.8 has fewer with probability below 2e-6.
AGREE = 10
SKETCH, BLOCKS = 1 << 20, 64
#: Buckets up to this size give all pairs; larger ones pairs with representatives.
SMALL, RANDOM = 8, 1
#: Members of one shingle's list that one part of it holds; members of a list's largest class that all others of the list are compared with first.
PART, CENTRAL = 2048, 8
TABLE = 1 << 16
RARITY = 0.25


def node_key(text: str | None) -> str | None:
    """One key for one sequence of words (lower case, white space folded); null without words."""
    words = (text or "").lower().split()
    return xxhash.xxh3_128_hexdigest(" ".join(words).encode("utf-8", "surrogatepass")) if words else None


def _draws() -> tuple[np.ndarray, np.ndarray]:
    """Tables of 1/r, beta, r and ln c for every sample, and the odd factors that pick a row for a shingle."""
    rng = np.random.default_rng(20240601)
    r, c, beta = rng.gamma(2, 1, (SAMPLES, TABLE)), rng.gamma(2, 1, (SAMPLES, TABLE)), rng.random((SAMPLES, TABLE))
    odd = rng.integers(1 << 62, (1 << 63) - 1, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.stack([1 / r, beta, r, np.log(c)], 2).astype(np.float32), odd


def samples(h: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Consistent weighted samples (32 bits each) of sets of weighted shingles laid end to end; `first` has each set's start."""
    table, odd = kept("neardup", _draws)
    lnw = np.log(w).astype(np.float32)
    out = np.empty((len(first), SAMPLES), dtype=np.uint32)
    for k in range(SAMPLES):
        row = table[k][(h * odd[k] >> np.uint64(48)).astype(np.int64)]
        t = np.floor(lnw * row[:, 0] + row[:, 1])
        a = row[:, 3] - row[:, 2] * (t - row[:, 1] + 1)
        # least a first; equal a: least identity
        bits = a.view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        ident = (h.astype(np.uint32) ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)))
        out[:, k] = np.minimum.reduceat(bits.astype(np.uint64) << np.uint64(32) | ident, first).astype(np.uint32)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    x = np.arange(SAMPLES // ROWS, dtype=np.uint64)[None, :] + np.uint64(1)
    x = np.repeat(x, len(sig), 0)
    for r in range(ROWS):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, r::ROWS].astype(np.uint64))
    return x.view(np.int64)


def frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """The table of document frequencies and the number of documents. Tasks send compressed blocks of counters, which are summed in two levels."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n, met = np.zeros(SKETCH, dtype=np.int64), 0, []
        held = 0
        for p in parts:
            n += len(p)
            for t in p[text]:
                if t:
                    met.append(np.unique(shingles(t, WORDS)))
                    held += len(met[-1])
                if held > 500_000:
                    sums += np.bincount((np.concatenate(met) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                    met, held = [], 0
        if met:
            sums += np.bincount((np.concatenate(met) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        if n:
            part = TaskContext.get().partitionId()
            yield pd.DataFrame({"block": np.arange(BLOCKS, dtype=np.int32), "part": np.int32(part % 32), "n": np.where(np.arange(BLOCKS) == 0, n, 0), "counts": [_pack(x) for x in sums.reshape(BLOCKS, -1)]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH // BLOCKS, dtype=np.int64)
        for x in rows["counts"]:
            total += _unpack(x)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "part": np.int32(0), "n": [int(rows["n"].sum())], "counts": [_pack(total)]})

    schema = "block int, part int, n long, counts binary"
    got = docs.select(text).mapInPandas(count, schema).groupBy("block", "part").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema).collect()
    df, n = np.zeros((BLOCKS, SKETCH // BLOCKS), dtype=np.int64), 0
    for r in got:
        df[r["block"]] = _unpack(r["counts"])
        n += r["n"]
    return df.reshape(-1), n


def _pack(x: np.ndarray) -> bytes:
    small = int(x.max(initial=0) < 65536)
    return bytes([small]) + zlib.compress(x.astype("<u2" if small else "<i8").tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(bytes(b)[1:]), dtype="<u2" if b[0] else "<i8").astype(np.int64)


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """idf of every counter: 1 for what all documents share, up to 1 + RARITY for what one has."""
    return (1 + RARITY * np.log(max(n, 1) / np.clip(df, 1, max(n, 1))) / np.log(n + 2)).astype(np.float32)


def _idf(idf: np.ndarray, h: np.ndarray) -> np.ndarray:
    return idf[(h & np.uint64(SKETCH - 1)).astype(np.int64)]


def signatures(docs: DataFrame, idf, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keep, node, sig, bands); keep: long columns. sig (SAMPLES little-endian 32-bit numbers) and bands only where a task meets a node first."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for p in parts:
            for i in range(0, len(p), 128):
                q = p.iloc[i : i + 128]
                keys = [node_key(t) for t in q[text]]
                sig: list = [None] * len(keys)
                band: list = [None] * len(keys)
                todo = []
                for j, k in enumerate(keys):
                    if k is not None and k not in seen:
                        seen.add(k)
                        todo.append(j)
                if len(seen) > 200_000:
                    seen.clear()  # a second signature is the same as the first
                if todo:
                    hs, ws = zip(*[np.unique(shingles(q[text].iloc[j], WORDS), return_counts=True) for j in todo], strict=True)
                    sizes = np.array([len(h) for h in hs])
                    h = np.concatenate(hs)
                    s = samples(h, np.concatenate(ws) * _idf(idf.value, h), np.concatenate([[0], sizes.cumsum()[:-1]]))
                    for j, x, y in zip(todo, s, bands(s), strict=True):
                        sig[j], band[j] = x.astype("<u4").tobytes(), y
                yield pd.DataFrame({c: q[c].to_numpy() for c in keep} | {"node": keys, "sig": sig, "bands": band})

    return docs.select(*keep, text).mapInPandas(run, ", ".join(f"`{c}` long" for c in keep) + ", node string, sig binary, bands array<long>")


def buckets(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets of several nodes (bucket, n, representatives) and their members (bucket, node, n); nodes: (node, bands)."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    order = [F.xxhash64(F.lit(s), F.col("node")) for s in range(RANDOM)]
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.struct(o.alias("h"), F.col("node").alias("node"))).alias(f"r{s}") for s, o in enumerate(order)]).filter("n > 1")
    sizes = staged(sizes, "neardup-buckets")
    return sizes, staged(rows.join(sizes.select("bucket", "n"), "bucket"), "neardup-members")


def candidates(sizes: DataFrame, met: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of nodes that share a bucket: all of a small one, those with the representatives of a large one."""
    small = met.filter(F.col("n") <= SMALL)
    left = small.select(F.col("node").alias("a"), "bucket")
    right = small.select(F.col("node").alias("b"), "bucket")
    pairs = left.join(right, "bucket").filter("a < b").select("a", "b")
    large = met.filter(F.col("n") > SMALL)
    # the member that meets most others over all its bands is nearest to the middle of its group
    central = large.groupBy("node").agg(F.sum("n").alias("meets"))
    middle = large.join(central, "node").groupBy("bucket").agg(F.max(F.struct("meets", "node")).alias("r"))
    reps = sizes.filter(F.col("n") > SMALL).select("bucket", F.explode(F.array(*[F.col(f"r{s}.node") for s in range(RANDOM)])).alias("rep"))
    reps = reps.unionByName(middle.select("bucket", F.col("r.node").alias("rep"))).distinct()
    far = large.select("bucket", "node").join(reps, "bucket").filter("node <> rep").select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b"))
    return pairs.unionByName(far).distinct()


def agreeing(pairs: DataFrame, nodes: DataFrame, least: int = AGREE) -> DataFrame:
    """Pairs of which at least `least` samples agree."""
    @F.pandas_udf("int")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        a = np.frombuffer(b"".join(map(bytes, x)), dtype="<u4").reshape(-1, SAMPLES)
        b = np.frombuffer(b"".join(map(bytes, y)), dtype="<u4").reshape(-1, SAMPLES)
        return pd.Series((a == b).sum(1).astype(np.int32))

    a = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(a, "a").join(b, "b").filter(agree("sig_a", "sig_b") >= least).select("a", "b")


def text_vectors(docs: DataFrame, texts: DataFrame, needed: DataFrame, name: str, text: str = "text", most_broadcast: int = 1 << 19) -> DataFrame:
    """(node, vector), one row for each node of `needed`, sorted 32-bit shingles. A document of every node is read again; docs: (_uid, text); texts: (node, _uid), one row a node.

    A _uid can name many rows: repeated ids, and all copies of a text without an id. A task makes one vector of a node; of several tasks' vectors that of the first stays."""
    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: set[str] = set()
        at = TaskContext.get().partitionId() << 24
        for p in parts:
            for i in range(0, len(p), 256):
                q = p.iloc[i : i + 256]
                if len(made) > 200_000:
                    made.clear()
                    at += 1  # what is made again counts as another task's
                keep = []
                for t, k in zip(q[text], q["node"], strict=True):
                    new = k not in made and node_key(t) == k  # a repeated id can stand for another text
                    keep.append(new)
                    if new:
                        made.add(k)
                q = q[keep]
                yield pd.DataFrame({"node": q["node"], "place": np.full(len(q), at), "vector": [np.sort(shingles(t, WORDS).astype(np.uint32)).astype("<u4").tobytes() for t in q[text]]})

    needed = staged(texts.join(needed.select("node"), "node", "left_semi").select("node", "_uid"), f"{name}-needed")
    texts = docs.select("_uid", text).join(F.broadcast(needed) if needed.count() <= most_broadcast else needed, "_uid")
    made = staged(texts.mapInPandas(vectors, "node string, place long, vector binary"), f"{name}-vectors")
    several = made.groupBy("node").agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("node", "_first")
    several = staged(several, f"{name}-several")
    return made.join(broadcast_if(several, most_broadcast // 4), "node", "left").filter("_first IS NULL OR place = _first").select("node", "vector")


def _weighted(b: bytes, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a vector and their weights."""
    u, c = np.unique(np.frombuffer(bytes(b), dtype="<u4"), return_counts=True)
    return u, c * w[(u & np.uint32(SKETCH - 1)).astype(np.int64)].astype(np.float64)


def verified(pairs: DataFrame, vector: DataFrame, idf, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of the pairs whose weighted Jaccard similarity is at least `similarity`; vector: (node, vector)."""
    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = idf.value

        def load(b: bytes) -> tuple[np.ndarray, np.ndarray, float]:
            u, x = _weighted(b, w)
            return u, x, x.sum()

        for p in parts:
            last, keep = (None, None), []
            for a, b, x, y in zip(p["a"], p["b"], p["vector_a"], p["vector_b"], strict=True):
                if last[0] != b:
                    last = (b, load(y))
                (u, wu, su), (v, wv, sv) = load(x), last[1]
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                same = v[at] == u
                low = np.minimum(wu[same], wv[at[same]]).sum()
                j = low / (su + sv - low)
                if j >= similarity:
                    keep.append((a, b, float(j)))
            yield pd.DataFrame(keep, columns=["a", "b", "similarity"])

    a = vector.select(F.col("node").alias("a"), F.col("vector").alias("vector_a"))
    b = vector.select(F.col("node").alias("b"), F.col("vector").alias("vector_b"))
    return pairs.join(a, "a").join(b, "b").mapInPandas(compare, "a string, b string, similarity double").distinct()


def unsettled(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root) of the members of large buckets that hold several classes; classes: (node, root)."""
    large = met.filter(F.col("n") > SMALL).select("bucket", "node").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = large.groupBy("bucket").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi").select("bucket")
    return large.join(several, "bucket").groupBy("node").agg(F.first("root").alias("root"))


def prefixes(vector: DataFrame, nodes: DataFrame, idf, similarity: float = SIMILARITY) -> DataFrame:
    """(token, node, root, weight, rest, short): the rarest shingles of each text, the weight of the text and of what is left of it from there on; nodes: (node, root).

    Shingles go from the rarest to the commonest. Two texts of weights u <= v at `similarity` have at least need = similarity / (1 + similarity) * (u + v)
    in common, which is 2 * similarity / (1 + similarity) of u (`short`) and `similarity` of v or more. So their first common shingle has at least that much of each
    text from it onwards, and at least `need` of both (`_room`).
    """
    share = _share(similarity)

    def prefix(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = idf.value
        for p in parts:
            for i in range(0, len(p), 256):
                q, out = p.iloc[i : i + 256], []
                for b in q["vector"]:
                    u, x = _weighted(b, w)
                    order = np.lexsort((u, -_idf(w, u)))
                    rest = x[order][::-1].cumsum()[::-1]
                    n = int((rest >= similarity * (1 - 1e-6) * rest[0]).sum())
                    out.append((u[order][:n].astype(np.int64), rest[:n], np.full(n, rest[0]), rest[:n] >= 2 * share * rest[0]))
                if out:
                    times = [len(t) for t, *_ in out]
                    token, rest, weight, short = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pd.DataFrame({"token": token, "node": np.repeat(q["node"].to_numpy(), times), "root": np.repeat(q["root"].to_numpy(), times), "weight": weight, "rest": rest, "short": short})

    return vector.join(nodes, "node").mapInPandas(prefix, "token long, node string, root string, weight double, rest double, short boolean")


def _share(similarity: float) -> float:
    return similarity / (1 + similarity) * (1 - 1e-6)


def _room(similarity: float, weights: tuple[Column, Column], rests: tuple[Column, Column]) -> Column:
    return _share(similarity) * (weights[0] + weights[1]) <= F.least(*rests)


def central_pairs(each: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows of `prefixes` whose shingle texts of several roots share, and distinct pairs (a, b): each text with CENTRAL random ones of the root that has most of a shingle's list.

    Most texts outside a large class are near one of these, so that a class and its neighbours are not met in all their pairs: pairs grow with the rows."""
    drawn = [F.min(F.struct(F.xxhash64(F.lit(s), F.col("token"), F.col("node")).alias("h"), "node", "weight", "rest")).alias(f"c{s}") for s in range(CENTRAL)]
    by_root = each.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"), *drawn)
    members = F.array_distinct(F.transform(F.array(*[f"c{s}" for s in range(CENTRAL)]), lambda c: F.struct(c["node"].alias("node"), c["weight"].alias("weight"), c["rest"].alias("rest"))))
    most = F.max_by(F.struct("root", members.alias("central")), F.struct("n", "root"))
    lists = staged(by_root.groupBy("token").agg(F.count(F.lit(1)).alias("roots"), most.alias("most")).filter("roots > 1").select("token", "most.*"), "neardup-lists")
    shared = staged(each.join(lists.select("token"), "token", "left_semi"), "neardup-shared")
    met = shared.join(lists.withColumnRenamed("root", "_most"), "token").filter("root <> _most")
    near = F.filter("central", lambda c: _room(similarity, (F.col("weight"), c["weight"]), (F.col("rest"), c["rest"])))
    pairs = met.select("node", F.explode(F.transform(near, lambda c: c["node"])).alias("other"))
    return shared, pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def prefix_pairs(each: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different roots, among them all whose similarity is at least `similarity`; each: rows of `prefixes`."""
    lists = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi")
    lists = staged(lists.select("token", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "neardup-lists")
    rows = each.join(lists, "token")
    cols = ["node", "root", "weight", "rest"]
    left = rows.filter("short").select("token", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"b_{c}") for c in cols])
    later = F.struct("a_weight", "a_node") < F.struct("b_weight", "b_node")
    room = _room(similarity, (F.col("a_weight"), F.col("b_weight")), (F.col("a_rest"), F.col("b_rest")))
    pairs = left.join(right, ["token", "part"]).filter((F.col("a_root") != F.col("b_root")) & later & room)
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(root, to): roots of `nodes` (node, root) that links (a, b) join to another, with the least root of their new class. So only roots go through `components`."""
    a, b = (nodes.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    between = links.select("a", "b").join(a, "a").join(b, "b").filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    return components(between).select(F.col("node").alias("root"), F.col("root").alias("to")).filter("root <> to")


def rerooted(nodes: DataFrame, moved: DataFrame, most_broadcast: int = 1 << 17) -> DataFrame:
    """Rows with a column root, each with the root that `moved` (of `joined`) gives its own."""
    cols = [F.coalesce("to", "root").alias("root") if c == "root" else F.col(c) for c in nodes.columns]
    return nodes.join(broadcast_if(moved, most_broadcast), "root", "left").select(*cols)


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): every linked node and the least node of its class. links: (a, b). Nodes without a link are absent."""
    edges, before = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars"), None
    for _ in range(rounds):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == before:
            break
        before = (now["n"], now["s"])
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, old = staged(large, "stars"), edges
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = staged(small, "stars")
        discard(old, large)
    else:
        raise RuntimeError("classes did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Rows from which a text counts as hot; at most 1000 texts can be.
HOT = 1000


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id, class_size, n_links, node, class_key), one row for each row of `docs`.

    class_id is the least id of the class (null if no row of it has one). node is the key of the row's words and class_key the least node of its
    class: unique, where ids repeat and class_id may not be; both are null for null texts and texts without words, which are classes of their own. n_links
    counts the found links of the row's text to different texts: in a large bucket pairs inside one class need not all be tested. Texts
    with the same words share a node, repeated rows included. An empty table gives no rows; other columns of `docs` are left out, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # rows without an id are told apart by their text
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("_uid"), text)
    df, n = frequencies(docs, text)
    idf = spark.sparkContext.broadcast(weights(df, n))
    rows = staged(signatures(docs, idf, ("_id", "_uid"), text), "neardup-signatures")
    nodes = staged(rows.filter(F.col("sig").isNotNull()).groupBy("node").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands")), "neardup-nodes")
    texts = staged(rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("_id").alias("least"), F.min("_uid").alias("_uid"), F.count(F.lit(1)).alias("rows")), "neardup-texts")
    sizes, met = buckets(nodes.select("node", "bands"))
    pairs = staged(agreeing(candidates(sizes, met), nodes.select("node", "sig")), "neardup-pairs")
    paired = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = staged(verified(pairs, text_vectors(docs, texts, paired, "neardup", text), idf, similarity), "neardup-links")
    discard(nodes, sizes, pairs)
    classes = components(links)
    rest = staged(unsettled(met, classes), "neardup-unsettled")
    if not rest.isEmpty():
        vector = text_vectors(docs, texts, rest, "neardup-unsettled", text)
        each = staged(prefixes(vector, rest, idf, similarity), "neardup-prefixes")
        shared, central = central_pairs(each, similarity)
        discard(each)
        for turn in ("central", "all"):
            pairs = staged(central if turn == "central" else prefix_pairs(shared, similarity), "neardup-pairs")
            found = staged(verified(pairs, vector, idf, similarity), "neardup-links")
            discard(pairs)
            if not found.isEmpty():
                links = links.unionByName(found)
                moved = staged(joined(rest, found), "neardup-moved")
                # texts without a link are absent from `classes`
                alone = rest.join(classes, "node", "left_anti").select("node", "root")
                classes = rerooted(classes.unionByName(alone), moved)
                rest, shared = rerooted(rest, moved), rerooted(shared, moved)
        discard(vector)
        links = links.dropDuplicates(["a", "b"])
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    # one row a distinct text first, so that large classes meet as few rows
    each = texts.join(classes, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = each.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"))
    each = each.join(whole, "root").select("node", "rows", F.col("root").alias("class_key"), "class_id", "class_size", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    each = staged(each, "neardup-classes")
    # hot texts, at most 1000, meet their rows where these are; the others' rows are dealt by text
    hot = each.filter(F.col("rows") > F.lit(max(HOT, n // 1000))).drop("rows")
    own = rows.select("_id", "node")
    here = own.join(F.broadcast(hot), "node")
    there = own.join(F.broadcast(hot.select("node")), "node", "left_anti").join(each.drop("rows"), "node", "left")
    out = here.unionByName(there)
    return out.select(F.col("_id").alias(id_col), F.when(F.col("class_key").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "node", "class_key")


def representatives(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, one for each class of `near_duplicates(docs)`: the least id (a null one last), then node; of rows alike in both the
    one of the least text hash, and of equal texts any one. Rows without words all stay."""
    named = lambda i, node: F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), node)
    first = F.min(F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).cast("long").alias("id"), "node")).alias("first")
    kept = classes.filter("class_key IS NOT NULL").groupBy("class_key").agg(first)
    kept = staged(kept.select(named(F.col("first.id"), F.col("first.node")).alias("_key")), "neardup-kept")

    @F.pandas_udf("string")
    def key(x: pd.Series) -> pd.Series:
        return pd.Series([node_key(t) for t in x], dtype="object")

    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(text).alias("_tie"), named(F.col(id_col), key(text)).alias("_key"))
    # repeated rows become one where they are read, so a hot one sends one row a task
    each = rows.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.min_by("_row", "_tie").alias("_row"))
    return each.join(kept, "_key", "left_semi").select("_row.*").unionByName(rows.filter(F.col("_key").isNull()).select("_row.*"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "class_id", "class_size", "n_links", "class_key")
