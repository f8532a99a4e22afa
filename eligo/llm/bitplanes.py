"""Centroid clustering with exact integer distances from bit planes.

Components become whole numbers, floor(SCALE * x). A vector of 64 of them is kept as its bit planes: bit j of plane b is
bit b of component j in two's complement, so a plane is one uint64 and the last plane weighs negative. The dot product of
two vectors is the sum over pairs of planes of both weights times the number of bits their AND has set; distances follow
from dot products, all in integers.

1. Vectors are packed once into a table of planes, as many as each needs (a shorter one is widened by repeating its last
   plane, which keeps its value).
2. A round assigns all vectors and adds up each cluster within a task; a task sends one row per cluster, and the sums of
   all tasks meet by cluster. Only the centroids (K rows) pass the driver.

The k kept vectors with the least sha256 of `1:<vec_id>` are the first centroids, fewer if there are not so many; equal ids
come in an order of their planes, and a null id hashes as null, which comes last. Vectors that are null, have another
length, or hold a null, NaN or infinite component take no part. Repeated rows are vectors of their own. Equal distances go
to the smaller centroid number; a cluster without vectors keeps its centroid. An empty table, or one without such vectors,
gives an empty table. Components beyond 2 ** LIMIT_BITS after scaling would not fit the 64-bit distances and are an error.
Only vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.session import cut_lineage

c = F.col

WIDTH = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
LIMIT_BITS = 27
BLOCK = 16_384  # vectors worked on at a time


def needed(x: np.ndarray) -> np.ndarray:
    """How many planes each row of integers needs."""
    return np.frexp(np.maximum(x, -(x + 1)).max(axis=1, initial=0).astype(float))[1] + 1


def to_planes(x: np.ndarray) -> np.ndarray:
    """(n, 64) integers as (n, planes) uint64, with the fewest planes that hold all of them."""
    size = int(needed(x).max(initial=1))
    bits = (x[:, None, :] >> np.arange(size)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def from_planes(planes: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8)
    bits = np.unpackbits(raw, axis=2, bitorder="little")
    return np.einsum("b,nbj->nj", weights(planes.shape[1]), bits, dtype=np.int64)


def weights(size: int) -> np.ndarray:
    """Of the planes: powers of two, the last one negative."""
    w = np.int64(1) << np.arange(size, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def widened(planes: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([planes, np.repeat(planes[:, -1:], size - planes.shape[1], axis=1)], axis=1)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of ``a`` with the one vector ``b``, both as planes."""
    out = np.zeros(len(a), np.int64)
    for i, x in enumerate(weights(a.shape[1])):
        for j, y in enumerate(weights(len(b))):
            out += x * y * np.bitwise_count(a[:, i] & b[j]).astype(np.int64)
    return out


def squares(a: np.ndarray) -> np.ndarray:
    """Dot product of every row with itself."""
    out, w = np.zeros(len(a), np.int64), weights(a.shape[1])
    for i in range(a.shape[1]):
        out += w[i] * w[i] * np.bitwise_count(a[:, i]).astype(np.int64)
        for j in range(i):
            out += 2 * w[i] * w[j] * np.bitwise_count(a[:, i] & a[:, j]).astype(np.int64)
    return out


def assign(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the first of equals, and its squared distance."""
    own, best, where = squares(planes), None, np.zeros(len(planes), np.int32)
    centres = to_planes(centroids)
    norms = squares(centres)
    for k in range(len(centroids)):
        d = own - 2 * dots(planes, centres[k]) + norms[k]
        if best is None:
            best = d
        else:
            nearer = d < best
            where[nearer] = k
            best = np.where(nearer, d, best)
    return where, best


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            some = b.slice(at, BLOCK)
            x = np.floor(SCALE * pc.list_flatten(some.column("v")).to_numpy(zero_copy_only=False).reshape(-1, WIDTH))
            if np.abs(x).max(initial=0) >= 2.0 ** LIMIT_BITS:
                raise ValueError(f"a component is beyond 2 ** {LIMIT_BITS} / {SCALE}")
            x = x.astype(np.int64)
            cells = [p[:n].tobytes() for p, n in zip(to_planes(x).astype("<u8"), needed(x).tolist())]
            yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array(cells, pa.binary())], names=["vec_id", "planes"])


def packed(embeddings: DataFrame) -> DataFrame:
    """vec_id and planes of the vectors that take part."""
    v = c("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    whole = embeddings.select(c("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") == WIDTH) & finite)
    return whole.mapInArrow(_pack, "vec_id long, planes binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Bounded blocks and their planes, all widened to the most that one of the block has."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            some = b.slice(at, BLOCK)
            cells = some.column("planes")
            sizes = pc.binary_length(cells).to_numpy(zero_copy_only=False) // 8
            out = np.zeros((len(sizes), sizes.max()), "<u8")
            for size in np.unique(sizes):
                rows = sizes == size
                out[rows] = widened(np.frombuffer(b"".join(cells.filter(pa.array(rows)).to_pylist()), "<u8").reshape(-1, size), sizes.max())
            yield some, out


def _sums(centroids: np.ndarray):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, planes in _blocks(batches):
            where, _ = assign(planes, centroids)
            n += np.bincount(where, minlength=len(centroids))
            np.add.at(total, where, from_planes(planes))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), *(pa.array(total[some, j], pa.int64()) for j in range(WIDTH))],
            names=["cluster", "n", *(f"x{j}" for j in range(WIDTH))])
    return sums


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of each cluster's mean, in whole numbers of any size."""
    names = [f"x{j}" for j in range(WIDTH)]
    parts = vectors.mapInArrow(_sums(centroids), "cluster int, n long, " + ", ".join(f"{x} long" for x in names))
    rows = parts.groupBy("cluster").agg(*(F.sum(c(x).cast("decimal(38,0)")).alias(x) for x in ("n", *names))).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"]] = [int(r[x]) // int(r["n"]) for x in names]
    return out


def seeds(vectors: DataFrame, k: int) -> np.ndarray:
    """The components of the k vectors with the least hash of their id."""
    h = F.sha2(F.concat(F.lit("1:"), c("vec_id").cast("string")), 256)
    ranked = vectors.withColumn("h", h).orderBy(c("h").asc_nulls_last(), _by_components()).limit(k)
    found = [from_planes(np.frombuffer(bytes(r["planes"]), "<u8")[None, :])[0] for r in ranked.select("planes").collect()]
    return np.array(found, np.int64).reshape(-1, WIDTH)


def _by_components():
    """An order of packed vectors; equal vectors have equal planes."""
    return F.struct(F.octet_length("planes"), F.hex("planes"))


def _assigned(centroids: np.ndarray):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, planes in _blocks(batches):
            where, distance = assign(planes, centroids)
            yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array(where, pa.int32()), pa.array(distance, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])
    return assigned


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every vector that takes part, written, and the centroids."""
    vectors = cut_lineage(packed(embeddings), "bitplanes-vectors")
    centroids = seeds(vectors, k)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    return cut_lineage(vectors.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "bitplanes-clusters"), centroids


def digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the distances' sums over clusters and over all, and the centroids' digests; k rows go to each task."""
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    per = F.array(*(F.lit(sums.get(i, 0)).cast("long") for i in range(max(1, len(centroids)))))
    text = F.array(*(F.lit(x) for x in digests(centroids) or [""]))
    return found.select("vec_id", "cluster", "distance", F.get(per, c("cluster")).alias("cluster_inertia"),
                        F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(text, c("cluster")).alias("centroid_sha256"))
