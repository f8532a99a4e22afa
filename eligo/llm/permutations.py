"""Approximate nearest neighbours by a permutation index, nearness being the inner product.

A bounded sample of the vectors serves as pivots. Every vector is represented by its ORDERED nearest pivots in order; it is
posted in the inverted files of its first POSTED pivots. A query visits the files of its nearest pivots, of which
``visited`` says how many: more with more pivots, so that true neighbours stay within reach as tables grow. It ranks a file's entries by the footrule distance of the two orders, and takes the exact inner product of the first of them, the
share RERANKED (no fewer than LEAST). The best of all files are the answer.

Equal vectors are one entry, with their smallest ids, so a very common vector neither fills a file nor crowds out others.
A file with many entries or many queries is cut into blocks, and every block of one meets every block of the other, so no
task's share grows with the corpus. Their number is known from counts per file. The pivots (at most MAX_PIVOTS, and of
the order of the root of the number of vectors, so that files stay short) go along with the tasks; small tables have one
pivot, hence one file, and are searched whole.

Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of different lengths never
meet. Repeated rows (the same vec_id and embedding) are one candidate; rows that share only the one or the other are candidates
of their own. A query is not its own candidate, and other rows with its id are none either. Ties go to the smaller vec_id. An empty table gives an empty table. Only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eligo.session import cut_lineage

c = F.col

K = 20
ORDERED = 32
POSTED = 8
VISITED = 24  # at least
VISITED_ROOT = 1.6  # times the root of the number of pivots, above 225 pivots
RERANKED = 0.5
LEAST = 200
MAX_PIVOTS = 16_384
BLOCK_ENTRIES = 20_000
BLOCK_QUERIES = 2_000


def usable(embedding: Column) -> Column:
    """Finite and not zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision, the same for the same vectors wherever they are taken."""
    return (a.astype(np.float64) * b.astype(np.float64)).sum(axis=-1)


def orders(vectors: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """Each vector's m nearest pivots, the nearest first."""
    out = np.empty((len(vectors), m), np.int32)
    for at in range(0, len(vectors), 1024):
        near = -(vectors[at:at + 1024].astype(np.float64) @ pivots.T.astype(np.float64))
        some = np.argpartition(near, m - 1, axis=1)[:, :m] if m < len(pivots) else np.tile(np.arange(m), (len(near), 1))
        some.sort(axis=1)  # ties: the smaller pivot number
        out[at:at + 1024] = np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)
    return out


def footrule(query: np.ndarray, entries: np.ndarray, n_pivots: int) -> np.ndarray:
    """Footrule distances (up to the query's own constant) of one order to many; a pivot that an order lacks is at place m."""
    m = entries.shape[1]
    place = np.full(n_pivots, m, np.int32)
    place[query] = np.arange(m)
    at = place[entries]
    return (np.abs(at - np.arange(m, dtype=np.int32)) - (m - at)).sum(axis=1)


def visited(n_pivots: int) -> int:
    """Files that a query visits. A fixed number would reach a share of the table that shrinks as pivots grow."""
    return min(n_pivots, max(VISITED, math.ceil(VISITED_ROOT * math.sqrt(n_pivots))))


def _represent(pivots: np.ndarray, m: int, files: int):
    """A row per file that a vector goes to: the file's pivot, the order's first m and the rest."""
    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vectors = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            n = min(files, len(pivots))
            order = orders(vectors, pivots, max(m, n))
            rows = pa.array(np.repeat(np.arange(b.num_rows), n))
            taken = b.take(rows)
            packed = pa.array([o.tobytes() for o in order[:, :m].astype(np.int16)], pa.binary()).take(rows)
            yield pa.RecordBatch.from_arrays([pa.array(order[:, :n].ravel(), pa.int32()), packed, *taken.columns],
                                             names=["pivot", "ranks", *taken.schema.names])
    return represent


def _search(k: int, n_pivots: int, m: int):
    def search(key, queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(entries):
            found = np.frombuffer(b"".join(entries["ranks"]), np.int16).reshape(-1, m)
            vectors, members, cls = np.stack(entries["embedding"].to_numpy()), entries["members"].to_numpy(), entries["cls"].to_numpy()
            for q, vector, ranks in zip(queries["query_id"], queries["embedding"], queries["ranks"]):
                far = footrule(np.frombuffer(ranks, np.int16), found, n_pivots)
                first = max(LEAST, math.ceil(RERANKED * len(far)))
                some = np.arange(len(far)) if len(far) <= first else np.argpartition(far, first - 1)[:first]
                score = inner(vectors[some], vector[None, :])
                # one more than k vectors: one may stand for the query alone
                best = np.lexsort(([members[i][0] for i in some], -score))[:k + 1]
                out += [(q, score[i], members[some[i]], cls[some[i]]) for i in best]
        return pd.DataFrame(out, columns=["query_id", "score", "members", "cls"])
    return search


def _one_dimension(vectors: DataFrame, every: int, k: int, real: str) -> DataFrame:
    ranked = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.distinct().withColumn("_n", F.row_number().over(ranked)).filter(c("_n") <= k + 1)  # one of them may be the query
    classes = cut_lineage(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).withColumn(
        "cls", F.xxhash64("embedding")), "ann-vectors")
    n = classes.count()
    n_pivots = 1 if n <= 256 else min(MAX_PIVOTS, math.ceil(math.sqrt(n)))
    sample = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(n_pivots).collect()
    pivots = np.array([r[0] for r in sample], np.float32 if real == "float" else np.float64)
    m = min(ORDERED, len(pivots))

    kind = f"pivot int, ranks binary, embedding array<{real}>"
    entries = classes.mapInArrow(_represent(pivots, m, POSTED), f"{kind}, members array<long>, cls long")
    asked = vectors.filter(c("vec_id") % every == 0).select("embedding", c("vec_id").alias("query_id")).distinct()
    queries = asked.mapInArrow(_represent(pivots, m, visited(len(pivots))), f"{kind}, query_id long")
    entries, queries = cut_lineage(entries, "ann-entries"), cut_lineage(queries, "ann-queries")

    # as many blocks of a file as its counts ask for
    n_entries = entries.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_ENTRIES).cast("int").alias("n_e"))
    n_queries = queries.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("n_q"))
    blocks = cut_lineage(n_entries.join(n_queries, "pivot"), "ann-blocks")

    def cut(rows: DataFrame, own: str, other: str, of: str, to: str, by: str) -> DataFrame:
        return rows.join(blocks, "pivot").withColumn(of, F.pmod(F.xxhash64(by, F.lit(1)), c(own)).cast("int")).withColumn(
            to, F.explode(F.sequence(F.lit(0), c(other) - 1))).drop("n_e", "n_q")

    entries, queries = cut(entries, "n_e", "n_q", "e", "q", "embedding"), cut(queries, "n_q", "n_e", "q", "e", "query_id")
    found = queries.groupBy("pivot", "e", "q").cogroup(entries.groupBy("pivot", "e", "q")).applyInPandas(
        _search(k, n_pivots, m), "query_id long, score double, members array<long>, cls long")
    best = Window.partitionBy("query_id").orderBy(c("score").desc(), "vec_id")
    pairs = found.select("query_id", "score", "cls", F.explode("members").alias("vec_id")).filter("query_id != vec_id").distinct()
    return pairs.withColumn("rank", F.row_number().over(best)).filter(c("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row whose vec_id is divisible by ``every``."""
    real = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"  # no digit is lost
    fine = vectors.select("vec_id", c("embedding").cast(f"array<{real}>").alias("embedding")).filter(
        c("vec_id").isNotNull() & usable(c("embedding")))
    lengths = [r[0] for r in fine.select(F.size("embedding")).distinct().collect()]
    parts = [_one_dimension(fine.filter(F.size("embedding") == d), every, k, real) for d in sorted(lengths)]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
