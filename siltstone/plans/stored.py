"""The written index of all chunks that the search queries read.

It is written once for a session and input, and later queries of the session read it: the key holds length and time of the file of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import dense as D
from siltstone.operators import index_store as X
from siltstone.operators.storage import Folder, shared_folder
from siltstone.plans.common import chunks, questions

DIM, METRIC = D.DIM, "raw_cosine"
_built: dict[tuple, tuple[X.Store, str]] = {}


def embedded(s, d):
    """All chunks with their hashed vectors (null where a text has none)."""
    c = chunks(s, d).select("doc_id", "chunk_id", "chunk_index", F.col("content").alias("text"))
    return c.withColumn("embedding", D.hashed(F.col("text")))


def index(s, d) -> tuple[X.Store, str]:
    """The store with the index of all chunks, and the collection's name."""
    source = Folder(s, d)
    status = source.files.getFileStatus(source.at("documents.parquet"))
    key = (s.sparkContext.applicationId, d, status.getModificationTime(), status.getLen())
    if key not in _built or not Folder(s, _built[key][0].folder).exists("indexes"):
        store = X.Store(s, shared_folder(s, "index"))
        _built[key] = (store, store.build("documents", embedded(s, d), DIM, METRIC, "idx_documents"))
    return _built[key]


def vectors(s, d):
    return D.hash_vectors(questions(s, d), "query_id", "query").withColumnRenamed("embedding", "q")


def sparse_top(s, d, n=20, drop_ratio=0.0):
    """The n best chunks of every benchmark item by BM25, with the lightest share `drop_ratio` of each chunk's weights left out."""
    return X.sparse_search(*index(s, d), questions(s, d), n, drop_ratio=drop_ratio).select("query_id", "chunk_id", "score", "rank")


def dense_top(s, d, n=20):
    """The n nearest chunks of every benchmark item."""
    return X.dense_search(*index(s, d), vectors(s, d), n).select("query_id", "chunk_id", "score", "rank")
