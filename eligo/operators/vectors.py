"""Embedding text, embedding and exact cosine search; ann.py has the index."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eligo import constants as K
from eligo.functions import text as X
from eligo.operators.dedup import best_per_key

c = F.col
TEXT_LIMIT = 2000      # fixed value: characters of embedding text stored
QUERY_BLOCK = 4096     # query vectors sent to the tasks at a time
GRID_QUERIES = 16_384   # with more queries than that, at most so many of them
GRID_VECTORS = 65_536   # and so many vectors meet in one task
TILE, STRIP = 512, 4096  # queries and vectors multiplied at a time
HASHED = "hashed-tf"   # model name of the default embedding


def embedding_text(df: DataFrame) -> Column:
    """Up to 18 labelled lines; absent fields give no line."""
    have = set(df.columns)

    def line(label: str, value: Column, when: Column) -> Column:
        return F.when(when, F.concat(F.lit(label), value))

    def text(label: str, name: str, limit: int | None = None) -> Column | None:
        if name not in have:
            return None
        return line(label, F.left(c(name), F.lit(limit)) if limit else c(name), X.filled(c(name)))

    def listed(label: str, name: str, also: Column | None = None, limit: int | None = None):
        if name not in have:
            return None
        values = F.slice(c(name), 1, limit) if limit else c(name)
        cond = F.coalesce(F.size(c(name)) > 0, F.lit(False))
        return line(label, F.array_join(values, ", "), cond if also is None else cond & also)

    def on(words: str, name: str):
        return F.when(c(name), F.lit(words)) if name in have else None

    other_name = None
    if "short_name" in have:
        other_name = line("Also known as: ", c("short_name"),
                          X.filled(c("short_name")) & (c("short_name") != c("name")))
    lines = [
        text("Scheme: ", "name"),
        other_name,
        text("Ministry: ", "ministry"),
        text("Department: ", "department"),
        text("Description: ", "description", 500),
        listed("Beneficiaries: ", "beneficiary_types"),
        listed("Target gender: ", "gender_eligibility", ~F.array_contains("gender_eligibility", "Any")),
        listed("Social categories: ", "social_categories"),
        listed("Business types: ", "business_types"),
        text("Eligibility: ", "eligibility_text", 400),
        text("Benefits: ", "benefits_text", 300),
        listed("States: ", "states", limit=5),
        text("Government level: ", "government_level"),
        text("Funding type: ", "funding_type"),
        on("Udyam registration required", "udyam_required"),
        on("Startup focused scheme", "startup_requirements"),
        on("Farmer / agricultural scheme", "farmer_requirements"),
        on("Artisan / handicraft scheme", "artisan_requirements"),
    ]
    return F.concat_ws("\n", *[x for x in lines if x is not None])


def worth_embedding(min_quality: int = K.MIN_QUALITY_FOR_EMBEDDING) -> Column:
    return c("data_quality_score") >= min_quality


def hashed_embedding(df: DataFrame, text: str, dim: int = 768) -> DataFrame:
    """Adds ``embedding``: word counts hashed to ``dim`` places, unit length.

    Needs no model and no pass over the corpus, so documents and queries embed
    alike. Blank text has no embedding.
    """
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim)
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    out = df.withColumn("_text", F.coalesce(c(text), F.lit("")))
    for stage in (words, counts, unit):
        out = stage.transform(out)
    return out.withColumn(
        "embedding", F.when(F.size("_words") > 0, vector_to_array("_unit", "float32"))
    ).drop("_text", "_words", "_counts", "_unit")


def embed(df: DataFrame, text: str, model: Callable | None = None, name: str = HASHED,
          dim: int = 768) -> DataFrame:
    """Adds ``embedding``, ``embedding_dim`` and ``embedding_model``.

    ``model`` is a pandas UDF from text to array<float>; without one the hashed
    embedding is used. Where the model gives null, dimension is 0 and the model
    name is blank.
    """
    out = df.withColumn("embedding", model(c(text))) if model else hashed_embedding(df, text, dim)
    got = c("embedding").isNotNull()
    return out.withColumns({
        "embedding_dim": F.when(got, F.size("embedding")).otherwise(0),
        "embedding_model": F.when(got, F.lit(name)).otherwise(""),
    })


def to_embed(schemes: DataFrame, stored: DataFrame, model: str = HASHED) -> DataFrame:
    """Schemes good enough to embed whose content the model has not embedded yet."""
    done = stored.where(c("embedding_model") == model).select(
        c("scheme_id").alias("id"), "content_hash").distinct()
    return schemes.where(worth_embedding()).join(done, ["id", "content_hash"], "left_anti")


def embedding_rows(schemes: DataFrame, model: Callable | None = None, name: str = HASHED,
                   dim: int = 768) -> DataFrame:
    """Rows of the embedding table for good enough schemes; failures give none."""
    texts = schemes.where(worth_embedding())
    rows = embed(texts.withColumn("embedding_text", embedding_text(texts)), "embedding_text", model, name, dim)
    return rows.where(c("embedding").isNotNull()).select(
        c("id").alias("scheme_id"), "content_hash", "embedding_model", "embedding_dim",
        F.left("embedding_text", F.lit(TEXT_LIMIT)).alias("embedding_text"), "embedding")


def store(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Embeddings filed by model and dimension, which searches prune on."""
    rows.withColumn("dim", c("embedding_dim")).write.mode(mode).partitionBy("embedding_model", "dim").parquet(path)


def one_per_model(embeddings: DataFrame, newest: str) -> DataFrame:
    """One embedding per scheme and model: the newest by the column given."""
    return best_per_key(embeddings, ["scheme_id", "embedding_model"],
                        [c(newest).desc(), F.xxhash64("embedding").asc()])


# ---- search -----------------------------------------------------------------

HITS = "query_id string, scheme_id string, similarity double"


def matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(m, axis=1)
    ok = norms > 0
    return m[ok] / norms[ok, None], ok


class Best:
    """The k best (similarity, id) per query seen so far, ties by id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.sims = [np.empty(0)] * queries
        self.ids = [np.empty(0, dtype=str)] * queries
        self.floor = np.full(queries, -np.inf)

    def add(self, sims: np.ndarray, ids: np.ndarray) -> None:
        """Rows of ``sims`` are vectors, columns queries; -inf is no hit."""
        better = (sims >= self.floor) & (sims > -np.inf)
        for j in np.nonzero(better.any(axis=0))[0]:
            new = better[:, j]
            self.add_to(j, sims[new, j], ids[new])

    def add_to(self, j: int, sims: np.ndarray, ids: np.ndarray) -> None:
        """Hits of query ``j`` alone."""
        s, i = np.append(self.sims[j], sims), np.append(self.ids[j], ids)
        order = np.lexsort((i, -s))[:self.k]
        self.sims[j], self.ids[j] = s[order], i[order]
        if len(order) == self.k:
            self.floor[j] = s[order[-1]]

    def frame(self, query_ids: list) -> pd.DataFrame:
        asked = np.repeat(np.array(query_ids, dtype=object), np.array([len(i) for i in self.ids], dtype=int))
        found = np.concatenate([np.empty(0, dtype=object), *self.ids])
        return pd.DataFrame({
            "query_id": pd.Series(asked, dtype=object),
            "scheme_id": pd.Series(found, dtype=object),
            "similarity": np.concatenate([np.empty(0), *self.sims]),
        })


def _scan(corpus: DataFrame, query_ids: list, vecs, k: int) -> DataFrame:
    """Best k of every corpus partition against one block of queries.

    The corpus is read once and not shuffled: the block goes to the tasks, and
    each task returns at most k rows per query.
    """
    q, _ = unit(matrix(vecs))
    dim = q.shape[1]

    def read(batches):
        best = Best(len(query_ids), k)
        for pdf in batches:
            if len(pdf):
                x, ok = unit(matrix(pdf["embedding"]))
                best.add(np.round(x @ q.T, 6), pdf["scheme_id"].to_numpy()[ok].astype(str))
        yield best.frame(query_ids)

    rows = corpus.where(c("embedding").isNotNull() & (F.size("embedding") == dim)).select("scheme_id", "embedding")
    return rows.mapInPandas(read, HITS)


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """Final ranks: a scheme counts once per query, by its best vector."""
    once = hits.groupBy("query_id", "scheme_id").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(c("similarity").desc(), c("scheme_id").asc())
    return once.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


def active_vectors(embeddings: DataFrame, schemes: DataFrame) -> DataFrame:
    """Vectors of active schemes."""
    live = schemes.where(c("status") == "active").select(c("id").alias("scheme_id"))
    return embeddings.join(live, "scheme_id", "left_semi")


def cosine_top_k(queries: DataFrame, corpus: DataFrame, k: int = K.SEARCH_LIMIT,
                 block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, scheme_id, similarity): the exact k nearest per query.

    ``queries`` has query_id and embedding, ``corpus`` scheme_id and embedding
    with one row per scheme (see :func:`one_per_model`). Vectors of length zero
    and null ones match nothing.
    """
    asked = queries.where(c("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).select(
        c("query_id").cast("string").alias("query_id"), "embedding")
    head = asked.limit(block + 1).collect()  # one more than a block holds: a bound whatever the number of queries
    if not head:
        return rank_hits(queries.sparkSession.createDataFrame([], HITS), k)
    if len(head) <= block:
        return rank_hits(_scan(corpus, [r.query_id for r in head], [r.embedding for r in head], k), k)
    return rank_hits(_grid(asked, corpus, k, asked.count()), k)


def dots(q: np.ndarray, x: np.ndarray, r: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of rows ``r`` of ``q`` with rows ``p`` of ``x``, in bounded blocks."""
    size = 1 << 16
    return np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", q[r[a:a + size]], x[p[a:a + size]]) for a in range(0, len(r), size))])


def nearest(q: np.ndarray, x: np.ndarray, k: int, cell: np.ndarray | None = None, use: np.ndarray | None = None,
            digits: int | None = 6, thin: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``x``, inner product rounded to ``digits``) of the ``k`` nearest for every row of ``q``, equal
    ones by their place in ``x``.

    Products are taken in single precision first, a tile at a time; only what may be among the best, given that precision's
    error, is taken again in double. What is worth a look is guessed from every ``thin``-th row; queries that the guess
    leaves with too few are worked out without it. With ``use`` (row of ``q``, cell) a query meets the rows of its cells only.
    """
    error = 1.2e-7 * (x.shape[1] + 4) * np.linalg.norm(x, axis=1).max(initial=0) * np.linalg.norm(q, axis=1).max(initial=0)
    margin = 2 * error + (10.0 ** -digits if digits is not None else 0)
    if use is None:
        place, starts = np.arange(len(x)), [(0, len(x), None)]
    else:
        place = np.argsort(cell, kind="stable")
        own, first = np.unique(cell[place], return_index=True)
        starts = list(zip(first.tolist(), [*first[1:].tolist(), len(x)], own.tolist()))
    strips = [(a, min(a + STRIP, end), o) for begin, end, o in starts for a in range(begin, end, STRIP)]
    met = np.full(len(q), len(x)) if use is None else use @ np.bincount(cell, minlength=use.shape[1])
    nth_thin = math.ceil(k / thin + 4 * math.sqrt(k / thin) + 4) if thin else 0
    sample = place[::thin] if thin and len(x) // thin > nth_thin else place[:0]
    fast, fast_q = x[place].astype(np.float32), q.astype(np.float32)
    out = []
    for at in range(0, len(q), TILE):
        tile = np.arange(at, min(at + TILE, len(q)))
        floor = np.full(len(tile), -np.inf)
        if len(sample):
            some = fast_q[tile] @ fast[::thin].T
            if use is not None:
                some[~use[np.ix_(tile, cell[sample])]] = -np.inf
            floor = np.partition(some, -nth_thin, axis=1)[:, -nth_thin].astype(float) - margin
        kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        new: list[tuple[np.ndarray, np.ndarray]] = []

        def settled():
            r, p = (np.concatenate([np.empty(0, np.int64), *(part[m] for part in new)]) for m in (0, 1))
            s = dots(q, x, tile[r], p)
            if digits is not None:
                s = np.round(s, digits)
            r, p, s = (np.concatenate([a, b]) for a, b in zip(kept, (r, p, s)))
            order = np.lexsort((p, -s, r))
            r, p, s = r[order], p[order], s[order]
            nth = np.arange(len(r)) - np.searchsorted(r, np.arange(len(tile)))[r]
            full = nth == k - 1
            floor[r[full]] = np.maximum(floor[r[full]], s[full] - margin)
            return r[nth < k], p[nth < k], s[nth < k]

        for begin, end, o in strips:
            rows = np.arange(len(tile)) if o is None else np.flatnonzero(use[tile, o])
            if not len(rows):
                continue
            some = fast_q[tile[rows]] @ fast[begin:end].T
            bare = floor[rows] == -np.inf
            if end - begin > k and bare.any():
                floor[rows[bare]] = np.partition(some[bare], -k, axis=1)[:, -k] - margin
            r, p = np.divmod(np.flatnonzero(some >= floor[rows, None].astype(np.float32)), end - begin)
            new.append((rows[r], place[p + begin]))
            if sum(len(r) for r, _ in new) > 2 * k * len(tile):
                kept, new = settled(), []
        r, p, s = settled()
        short = np.flatnonzero(np.bincount(r, minlength=len(tile)) < np.minimum(k, met[tile])) if len(sample) else []
        if len(short):
            again = nearest(q[tile[short]], x, k, cell, None if use is None else use[tile[short]], digits, 0)
            well = ~np.isin(r, short)
            r, p, s = (np.concatenate([a[well], b]) for a, b in zip((r, p, s), (short[again[0]], *again[1:])))
        out.append((tile[r], p, s))
    return tuple(np.concatenate([np.empty(0, t), *(part[m] for part in out)]) for m, t in enumerate((np.int64, np.int64, float)))


def hits_frame(query_ids: np.ndarray, ids: np.ndarray, r: np.ndarray, p: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_id": query_ids[r], "scheme_id": ids[p], "similarity": s})


def _grid(asked: DataFrame, corpus: DataFrame, k: int, queries: int) -> DataFrame:
    """Blocks of queries against blocks of the corpus, a pair of blocks per task.

    Both sides are cut by a hash of their ids, so blocks are even however the data is skewed. Blocks are as large as a task
    may hold, since each side is sent once per block of the other, and smaller only if that leaves fewer pairs of blocks
    than partitions. A pair returns at most k rows per query.
    """
    vectors = corpus.count()
    edge = max(1, math.ceil(math.sqrt(queries * vectors / int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    query_blocks, cuts = -(-queries // min(edge, GRID_QUERIES)), max(1, -(-vectors // min(edge, GRID_VECTORS)))

    def block_of(col: str, n: int) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = asked.select("query_id", "embedding", block_of("query_id", query_blocks).alias("qb")).withColumn("cb", every(cuts))
    v = corpus.where(c("embedding").isNotNull()).select(
        "scheme_id", "embedding", block_of("scheme_id", cuts).alias("cb")).withColumn("qb", every(query_blocks))

    def pair(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        found = []
        vs, width = vs.sort_values("scheme_id", ignore_index=True), qs["embedding"].map(len)
        for dim in width.unique():
            some, near = qs[width == dim], vs[vs["embedding"].map(len) == dim]
            if len(near):
                m, asks = unit(matrix(some["embedding"]))
                x, ok = unit(matrix(near["embedding"]))
                found.append(hits_frame(some["query_id"].to_numpy()[asks], near["scheme_id"].to_numpy()[ok], *nearest(m, x, k)))
        return pd.concat(found, ignore_index=True) if found else hits_frame(*[np.empty(0, object)] * 2, *[np.empty(0, int)] * 2, np.empty(0))

    return q.groupBy("qb", "cb").cogroup(v.groupBy("qb", "cb")).applyInPandas(pair, HITS)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found."""
    hit = found.select("query_id", "scheme_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "scheme_id"], "left").agg(
        F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def hydrate(ranked: DataFrame, responses: DataFrame) -> DataFrame:
    """Ranked ids with their response rows, one join for all queries.

    ``ranked`` is the short side: k rows per query.
    """
    return responses.join(ranked.withColumnRenamed("scheme_id", "id"), "id")
