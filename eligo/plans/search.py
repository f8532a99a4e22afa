"""Search by vector, with the keyword and the plain listing behind it. Queries are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eligo import constants as K
from eligo.functions import text as X
from eligo.operators import catalog, trigrams, vectors
from eligo.session import cut_lineage

c = F.col


def _order():
    return [*(c(f).desc() for f in catalog.LISTING_ORDER), c("id").asc()]


def keyword_top(schemes: DataFrame, queries: DataFrame, index: trigrams.Index, limit: int = K.SEARCH_LIMIT) -> DataFrame:
    """(query_id, rank, scheme_id) of the keyword listing of every query (query_id, text), over active schemes.

    ``index`` is the trigram index of the catalog's text columns; only rows that match a query meet the catalog, and each
    task passes on at most ``limit`` rows per query.
    """
    active = schemes.where(catalog.status_is("active")).select("id", *catalog.LISTING_ORDER)
    hits = trigrams.matches(queries, index).join(active, "id")
    w = Window.partitionBy("query_id").orderBy(*_order())
    return hits.withColumn("rank", F.row_number().over(w)).where(c("rank") <= limit).select(
        "query_id", "rank", c("id").alias("scheme_id"))


def plain_top(schemes: DataFrame, queries: DataFrame, limit: int = K.SEARCH_LIMIT) -> DataFrame:
    """(query_id, rank, scheme_id): the first page of active schemes for every query; the page travels as one array."""
    page = catalog.page_of(schemes.where(catalog.status_is("active")), limit=limit).select("id", *catalog.LISTING_ORDER)
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(*_order())))
    ids = ranked.agg(F.sort_array(F.collect_list(F.struct("rank", c("id").alias("scheme_id")))).alias("page"))
    return queries.select("query_id", F.inline(ids.scalar()))


def hybrid(schemes: DataFrame, embeddings: DataFrame, queries: DataFrame, index: trigrams.Index,
           limit: int = K.SEARCH_LIMIT) -> DataFrame:
    """(query_id, rank, scheme_id, method) for queries (query_id, text, embedding).

    A blank text gets the plain listing. A text with a vector is searched by
    vector. One without a vector, or whose vector finds nothing, falls back to
    the keyword listing.
    """
    queries = queries.withColumn("query_id", c("query_id").cast("string"))
    blank = ~F.coalesce(X.filled(F.trim("text")), F.lit(False))
    worded = queries.where(~blank)
    corpus = vectors.active_vectors(embeddings, schemes)
    found = cut_lineage(vectors.cosine_top_k(worded, corpus, limit).select("query_id", "rank", "scheme_id"), "hybrid-vectors")
    rest = worded.join(found.select("query_id").distinct(), "query_id", "left_anti")
    parts = {"listing": plain_top(schemes, queries.where(blank), limit), "vector": found,
             "keyword": keyword_top(schemes, rest, index, limit)}
    out = None
    for method, rows in parts.items():
        rows = rows.withColumn("method", F.lit(method))
        out = rows if out is None else out.unionByName(rows)
    return out
