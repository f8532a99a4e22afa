"""The source dimension: nine rows, joined to landed fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo import constants as K

c = F.col
SOURCES = (
    "source_id string, name string, type string, authority_level string, terms_status string, "
    "enabled boolean, priority int, category_filter array<string>, ordinal int"
)


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, i) for i, row in enumerate(K.SOURCE_ROWS)], SOURCES)


def enabled(dim: DataFrame, priority_max: int = 10) -> DataFrame:
    """Enabled sources up to a priority; order by (priority, ordinal)."""
    return dim.where(c("enabled") & (F.coalesce("priority", F.lit(99)) <= priority_max))


def api_only(dim: DataFrame) -> DataFrame:
    return dim.where(c("enabled") & (c("type") == "api"))


def unknown_ids(requested: DataFrame, dim: DataFrame) -> DataFrame:
    """Requested source ids the registry does not have."""
    return requested.select("source_id").distinct().join(F.broadcast(dim), "source_id", "left_anti")


def pick(dim: DataFrame, source_ids: list[str] | None, priority_max: int = 10) -> DataFrame:
    """The requested sources, or all enabled ones; an unknown id is an error."""
    if not source_ids:
        return enabled(dim, priority_max)
    asked = list(dict.fromkeys(source_ids))
    found = dim.where(c("source_id").isin(asked))
    if found.count() < len(asked):
        known = {r.source_id for r in found.select("source_id").collect()}
        raise ValueError(f"unknown sources: {[i for i in asked if i not in known]}")
    return found


def expand(dim: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per entry url, in source order, then list order.

    The registry is a few rows of code, so it is broadcast and no source's
    entries have to meet in one task.
    """
    return entries.join(F.broadcast(dim), "source_id").select(
        "source_id", "priority", "ordinal", F.posexplode("urls").alias("url_index", "url"))


def without_urls(dim: DataFrame, entries: DataFrame) -> DataFrame:
    listed = entries.where(F.size("urls") > 0).select("source_id").distinct()
    return dim.join(listed, "source_id", "left_anti")
