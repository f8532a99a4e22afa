"""A stored index for cosine search: an inverted file over trained cells, with product-quantized residuals.

Training takes a bounded sample (SAMPLE rows, those with the least hash of their id); every row is indexed. A vector goes
to the cell of the nearest centroid, and what is left of it is kept as one byte per SUB components, the nearest entry of
that part's codebook. Rows are filed by cell, so that a search reads the folders it probes.

A search meets the codes first: the vectors they stand for are multiplied with the queries that probe their cell. Only the
best of these are compared by their own vectors. Cells are gathered into shards of SHARD_ROWS rows, a cell with more than that
is cut by a hash of the ids; a shard and a block of queries are one task, which takes both steps.

Cells follow the square root of the rows; the probed share of them falls slowly with their number. Vectors that are null, of
another length or of length zero are not indexed and match nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eligo.operators.vectors import HITS, dots, hits_frame, matrix, nearest, rank_hits, unit
from eligo.session import cut_lineage

c = F.col
SAMPLE = 32_768
SUB = 4            # components to a byte of code
BOOK = 256
ROUNDS = 8
SHARD_ROWS = 262_144
QUERY_BLOCK = 16_384
COLUMNS = {"codes": "code binary", "vectors": "embedding array<double>", "rows": "code binary, embedding array<double>"}
SHORTLIST = 20     # vectors compared for each one asked for


@dataclass(frozen=True)
class Index:
    path: str
    dim: int
    centroids: np.ndarray      # cell, component; of length one
    books: np.ndarray          # part, entry, component
    rows: np.ndarray           # per cell
    spark: SparkSession

    def table(self, name: str) -> DataFrame:
        """``codes``, ``vectors`` or both as ``rows``: columns of one table."""
        return self.spark.read.schema(f"scheme_id string, {COLUMNS[name]}, cell int").parquet(f"{self.path}/rows")

    @property
    def probes(self) -> int:
        """Cells a search reads the codes of: recall is measured with these."""
        return min(len(self.rows), math.ceil(2.5 * len(self.rows) ** 0.7))

    def shards(self) -> tuple[np.ndarray, np.ndarray]:
        """Per cell its first shard and in how many shards it lies."""
        parts = np.maximum(1, -(-self.rows // SHARD_ROWS))
        first, at, room = np.zeros(len(parts), np.int64), -1, 0
        for i, n in enumerate(self.rows.tolist()):
            if parts[i] > 1 or n > room:
                at, room = at + 1, SHARD_ROWS
            first[i], room = at, room - n
            if parts[i] > 1:
                at, room = at + int(parts[i]) - 1, 0
        return first, parts


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row, in bounded blocks."""
    half = 0.5 * (centres ** 2).sum(1)
    size = max(1, (1 << 24) // max(1, len(centres)))
    return np.concatenate([np.empty(0, np.int64), *((x[i:i + size] @ centres.T - half).argmax(1) for i in range(0, len(x), size))])


def _means(x: np.ndarray, k: int, rng, unit_length: bool) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        total, n = np.zeros_like(centres), np.bincount(own, minlength=k)[:, None]
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True) if unit_length else n
        centres = np.where((n > 0) & (size > 0), total / np.where(size > 0, size, 1), centres)
    return centres


def _parts(x: np.ndarray) -> np.ndarray:
    """Rows cut into parts of SUB components, the last one filled up with zeros."""
    more = -x.shape[1] % SUB
    return np.pad(x, ((0, 0), (0, more))).reshape(len(x), -1, SUB)


def train(sample: np.ndarray, cells: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the cells and codebooks of the residuals, from unit vectors."""
    rng = np.random.default_rng(seed)
    centroids = _means(sample, cells, rng, True)
    left = _parts(sample - centroids[_nearest(sample, centroids)])
    return centroids, np.stack([_means(left[:, m], BOOK, rng, False) for m in range(left.shape[1])])


def encode(x: np.ndarray, centroids: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and code of unit vectors."""
    cell = _nearest(x, centroids)
    left = _parts(x - centroids[cell])
    return cell, np.stack([_nearest(left[:, m], books[m]) for m in range(len(books))], axis=1).astype(np.uint8)


def build(corpus: DataFrame, path: str, dim: int, cells: int | None = None, seed: int = 7) -> Index:
    """Trains on a sample of ``corpus`` (scheme_id, embedding), files all of it under ``path``."""
    spark = corpus.sparkSession
    sized = corpus.select(c("scheme_id").cast("string").alias("scheme_id"), c("embedding").cast("array<double>").alias("embedding")).where(
        (F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0))
    sized = cut_lineage(sized, "ann-corpus")
    first = sized.orderBy(F.xxhash64("scheme_id"), "scheme_id").limit(SAMPLE).select("embedding").toArrow()  # a bound on what the driver gets
    sample = np.array(first.column(0).combine_chunks().flatten(), dtype=float).reshape(-1, dim)
    if not len(sample):
        sample = np.eye(1, dim)
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centroids, books = train(sample, cells or max(1, round(math.sqrt(sized.count()))), seed)

    def coded(batches):
        for b in batches:
            x, ok = unit(matrix(b["embedding"])) if len(b) else (np.empty((0, dim)), slice(0))
            cell, code = encode(x, centroids, books)
            yield pd.DataFrame({"scheme_id": b["scheme_id"][ok], "embedding": b["embedding"][ok], "cell": cell.astype("int32"),
                                "code": [row.tobytes() for row in code]})

    coded_rows = cut_lineage(sized.mapInPandas(coded, "scheme_id string, embedding array<double>, cell int, code binary"), "ann-coded")
    filed, rows = _dealt(coded_rows, len(centroids))
    filed.write.partitionBy("cell").mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(i, x.tolist(), int(n)) for i, (x, n) in enumerate(zip(centroids, rows))],
                          "cell int, centroid array<double>, rows long").write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(m, i, x.tolist()) for m, book in enumerate(books) for i, x in enumerate(book)],
                          "part int, entry int, value array<double>").write.mode("overwrite").parquet(f"{path}/books")
    return Index(path, dim, centroids, books, rows, spark)


def _dealt(coded: DataFrame, cells: int) -> tuple[DataFrame, np.ndarray]:
    """Rows dealt by cell, a large cell over several tasks, so that a folder gets few files; and the rows of each cell."""
    rows = np.zeros(cells, np.int64)
    for r in coded.groupBy("cell").count().collect():
        rows[r["cell"]] = r["count"]
    parts = F.array(*(F.lit(int(-(-n // SHARD_ROWS)) or 1) for n in rows))
    return coded.repartition("cell", F.pmod(F.xxhash64("scheme_id"), F.get(parts, c("cell")))), rows


def load(spark: SparkSession, path: str) -> Index:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    books = spark.read.parquet(f"{path}/books").orderBy("part", "entry").collect()
    centroids = np.array([r["centroid"] for r in cells])
    values = np.array([r["value"] for r in books]).reshape(-1, BOOK, SUB)
    return Index(path, centroids.shape[1], centroids, values, np.array([r["rows"] for r in cells]), spark)


# ---- search

def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")


def _shard_of(index: Index) -> Column:
    """Shard of a filed row; ``cell`` and ``scheme_id`` tell it. There is one entry per cell."""
    first, parts = index.shards()
    where, cut = (F.array(*(F.lit(int(x)) for x in v)) for v in (first, parts))
    return (F.get(where, c("cell")) + F.pmod(F.xxhash64("scheme_id"), F.get(cut, c("cell"))).cast("int")).alias("shard")


def _asked(queries: DataFrame, index: Index, probes: int, blocks: int) -> DataFrame:
    """query_id, embedding (of length one), block, and the cells probed."""
    centroids = index.centroids

    def probed(batches):
        for b in batches:
            x, ok = unit(matrix(b["embedding"])) if len(b) else (np.empty((0, index_dim)), slice(0))
            near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes].astype("int32")
            yield pd.DataFrame({"query_id": b["query_id"][ok], "block": b["block"][ok], "embedding": list(x), "cells": list(near)})

    index_dim = index.dim
    rows = queries.select(c("query_id").cast("string").alias("query_id"), c("embedding").cast("array<double>").alias("embedding")).where(
        (F.size("embedding") == index.dim) & F.exists("embedding", lambda x: x != 0)).withColumn("block", _block(blocks))
    return rows.mapInPandas(probed, "query_id string, block int, embedding array<double>, cells array<int>")


def _to_shards(asked: DataFrame, index: Index) -> DataFrame:
    """A row per query and shard that holds a cell it probes."""
    first, parts = index.shards()
    lists = F.array(*(F.array(*(F.lit(int(a + i)) for i in range(int(n)))) for a, n in zip(first, parts)))
    return asked.withColumn("shard", F.explode(F.array_distinct(F.flatten(F.transform("cells", lambda x: F.get(lists, x))))))


def decoded(cell: np.ndarray, code: np.ndarray, centroids: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for."""
    left = np.concatenate([books[m][code[:, m]] for m in range(len(books))], axis=1)
    return centroids[cell] + left[:, :centroids.shape[1]]


def top_k(queries: DataFrame, index: Index, k: int, probes: int | None = None, shortlist: int | None = None) -> DataFrame:
    """(query_id, rank, scheme_id, similarity): the k nearest of each query's shortlist.

    ``probes`` cells' codes are read and the ``shortlist`` best of them compared by their vectors. ``shortlist=0`` compares
    all vectors of the probed cells; with all cells probed the answer is exact. Unless given they are the index's.
    """
    probes = min(index.probes if probes is None else probes, len(index.rows))
    size = SHORTLIST * k if shortlist is None else shortlist
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = cut_lineage(_asked(queries, index, probes, blocks), "ann-queries")
    # only the folders of cells that some query probes are read; their number is bounded by the cells
    cells = [r["cell"] for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]
    probed = c("cell").isin(cells) if len(cells) < len(index.rows) else F.lit(True)
    vectors = index.table("rows" if size else "vectors").where(probed).withColumn("shard", _shard_of(index))
    centroids, books, some_cells = index.centroids, index.books, probes < len(index.rows)

    def compare(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(vs):
            return hits_frame(*[np.empty(0, object)] * 2, *[np.empty(0, int)] * 2, np.empty(0)).assign(far=0.0)
        vs = vs.sort_values("scheme_id", ignore_index=True)
        q, (x, _), cell, use = matrix(qs["embedding"]), unit(matrix(vs["embedding"])), vs["cell"].to_numpy(), None
        if some_cells:
            use = np.zeros((len(q), len(centroids)), bool)
            np.put_along_axis(use, np.stack(qs["cells"].tolist()), True, axis=1)
        if size:
            code = np.frombuffer(b"".join(vs["code"]), np.uint8).reshape(len(vs), -1)
            r, p, near = nearest(q, decoded(cell, code, centroids, books), size, cell, use, digits=None)
            s = np.round(dots(q, x, r, p), 6)
        else:
            r, p, s = nearest(q, x, k, cell, use)
            near = s
        return hits_frame(qs["query_id"].to_numpy(), vs["scheme_id"].to_numpy(), r, p, s).assign(far=-near)

    spread = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hits = _to_shards(asked, index).groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInPandas(
        compare, f"{HITS}, far double")
    if size:  # a shard knows its own shortlist only
        w = Window.partitionBy("query_id").orderBy("far", "scheme_id")
        hits = hits.withColumn("_nth", F.row_number().over(w)).where(c("_nth") <= size)
    return rank_hits(hits, k)
