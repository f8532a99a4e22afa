"""Duplicate keys, in-batch dedup, membership in the catalog, near names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eligo.functions import text as X

c = F.col


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("dedup_key", record_key())


def record_key() -> Column:
    return X.dedup_key(c("scheme_code"), c("government_level"), c("name"), c("ministry"))


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order.

    Spark keeps only each map task's first row per key before the shuffle, so
    a key with a third of all rows sends one row per task, not its whole group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup(df: DataFrame, order: str = "ingest_ord") -> DataFrame:
    """Per key the record of highest quality, the earliest among equals."""
    return best_per_key(with_key(df), ["dedup_key"], [c("data_quality_score").desc(), c(order).asc()])


def losers(df: DataFrame, kept: DataFrame, order: str = "ingest_ord") -> DataFrame:
    """The records dedup dropped. ``order`` is unique, so this join has no hot key."""
    return with_key(df).join(kept.select(order), order, "left_anti")


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows, distinct keys and duplicates of a batch, in one row.

    Counts are taken per key first: that is combined on the map side, so no
    key's rows ever meet in one task.
    """
    per_key = with_key(df).groupBy("dedup_key").agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("*").alias("unique_keys"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("duplicates"),
    )


def existing_keys(catalog: DataFrame) -> DataFrame:
    return catalog.select(record_key().alias("dedup_key")).distinct()


def split_new(batch: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with a new key, records whose key the catalog has)."""
    return batch.join(keys, "dedup_key", "left_anti"), batch.join(keys, "dedup_key", "left_semi")


def near_names(names: DataFrame, col: str = "name_key") -> DataFrame:
    """Distinct names that another name nearly equals, for human review.

    Two names are near when dropping at most one character from each makes
    them equal. Every name is spread over its own drop-one texts; a text that
    two names share flags both. Work grows with the length of the names: no
    pair of names is ever formed, whatever the number of near copies.

    ``review_low`` and ``review_high`` bound the names that share a text with
    this one; ``links`` counts the shared texts.
    """
    keys = names.select(col).where(X.filled(c(col))).distinct()
    spread = keys.select(col, F.explode(X.near_keys(c(col))).alias("near"))
    shared = (
        spread.groupBy("near").agg(F.min(col).alias("low"), F.max(col).alias("high"))
        .where("low <> high")
    )
    return (
        spread.join(shared, "near")
        .groupBy(col)
        .agg(F.min("low").alias("review_low"), F.max("high").alias("review_high"),
             F.count("*").alias("links"))
    )
