"""Merging a batch into the catalog: actions, merge, children, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligo.functions import lists as L
from eligo.functions import text as X
from eligo.operators.dedup import best_per_key, with_key
from eligo.operators.normalize import snapshot

c = F.col
MERGED_BY = "ingestion_pipeline"


def scheme_id(key: Column) -> Column:
    """An id that follows from the key, so a job run twice gives the same."""
    return F.left(F.sha2(key, 256), F.lit(32))


def keyed(catalog: DataFrame) -> DataFrame:
    """The catalog with its dedup key: four columns read where that is all asked for."""
    return catalog if "dedup_key" in catalog.columns else with_key(catalog)


def record_hash(records: DataFrame) -> Column:
    """A hash of what a record says, whatever else was in its payload and whenever it came."""
    aside = {"content_hash", "payload_hash", "created_at", "updated_at", "verified_at", "id", "slug", "data_version", "source_url"}
    return F.sha2(snapshot(records.drop(*aside)), 256)


REVIEWED = ("verification_status", "verified_at")


def plan(batch: DataFrame, catalog: DataFrame, incremental: bool = True, keep_better: bool = False) -> DataFrame:
    """The batch with ``action``: insert, update or skip.

    Both sides come down to one row per key, so the join has no hot key, and
    only key, id, hash and a few more columns of the catalog are read. A record is
    skipped when its content hash is known and unchanged. A catalog's ``created_at`` comes
    along as ``stored_created_at``, so that an update keeps it.

    With ``keep_better`` a record of another source than the stored one replaces it only if its quality is no less, and
    what a reviewer has verified stays verified.
    """
    have = set(catalog.columns) if keep_better else set()
    created = [c("created_at").alias("stored_created_at")] if "created_at" in catalog.columns else []
    own = [c(x).alias(f"_{x}") for x in ("data_quality_score", "source_url", *REVIEWED) if x in have]
    stored = best_per_key(keyed(catalog).select(
        "dedup_key", c("id").alias("_id"), c("content_hash").alias("_hash"),
        (c("data_version") if "data_version" in catalog.columns else F.lit(1)).alias("_version"), *created, *own,
    ), ["dedup_key"], [c("_id").asc()])
    same = F.coalesce(c("content_hash") == c("_hash"), F.lit(False)) & F.lit(incremental)
    if {"data_quality_score", "source_url"} <= have:
        other = ~c("source_url").eqNullSafe(c("_source_url"))
        same = same | (other & F.coalesce(c("data_quality_score") < c("_data_quality_score"), F.lit(False)))
    action = F.when(c("_id").isNull(), "insert").when(same, "skip").otherwise("update")
    joined = batch.join(stored, "dedup_key", "left")
    if set(REVIEWED) <= have:
        seen = c("_verified_at").isNotNull()
        joined = joined.withColumns({x: F.when(seen, c(f"_{x}")).otherwise(c(x)) for x in REVIEWED if x in joined.columns})
    return joined.withColumns({
        "action": action,
        "id": F.coalesce("_id", scheme_id(c("dedup_key"))),
        "data_version": F.when(c("_id").isNull(), 1).otherwise(c("_version") + F.when(same, 0).otherwise(1)),
    }).drop("_id", "_hash", "_version", *(f"_{x}" for x in ("data_quality_score", "source_url", *REVIEWED)))


def merge(catalog: DataFrame, planned: DataFrame) -> DataFrame:
    """The catalog after the batch: untouched rows and the written ones."""
    written = planned.where("action <> 'skip'").drop("action", "stored_created_at")
    untouched = keyed(catalog).join(written.select("dedup_key"), "dedup_key", "left_anti")
    return untouched.unionByName(written, allowMissingColumns=True)


def with_slug(planned: DataFrame) -> DataFrame:
    return planned.withColumn("slug", X.unique_slug(c("slug"), F.left("id", F.lit(8))))


# ---- child tables: one narrow explode each ----------------------------------

def children(records: DataFrame, array: str) -> DataFrame:
    """One row per element: scheme_id, position, the element's fields."""
    return records.select(c("id").alias("scheme_id"), F.posexplode(array).alias("position", "_e")).select(
        "scheme_id", "position", "_e.*")


def rules(records: DataFrame) -> DataFrame:
    return children(records, "eligibility_rules").withColumns({
        "value_list": L.or_empty(c("value_list")),
        "logical_group": F.coalesce("logical_group", F.lit("AND")),
        "required": F.coalesce("required", F.lit(True)),
    })


def benefits(records: DataFrame) -> DataFrame:
    return children(records, "benefits_structured").withColumns({
        "amount": c("amount").cast("decimal(15,2)"), "percentage": c("percentage").cast("decimal(5,2)"),
    })


def documents(records: DataFrame) -> DataFrame:
    return children(records, "documents")


def locations(records: DataFrame) -> DataFrame:
    """A row per state; a scheme without states is national."""
    return records.select(c("id").alias("scheme_id"), F.explode_outer("states").alias("state_name")).withColumn(
        "geography_type", F.when(c("state_name").isNull(), "national").otherwise("state"))


def provenance(records: DataFrame, checked_at: Column) -> DataFrame:
    return records.select(
        c("id").alias("scheme_id"),
        F.coalesce(X.text_or(c("source_url"), c("official_source_url")), F.lit("")).alias("source_url"),
        "source_type", c("source_name").alias("publisher"), checked_at.alias("checked_at"),
        c("payload_hash" if "payload_hash" in records.columns else "content_hash").alias("content_hash"),
        F.lit(200).alias("http_status"),
        F.when(c("source_type") == "api", "primary").otherwise("secondary").alias("authority_level"),
    )


def versions(planned: DataFrame, created_at: Column) -> DataFrame:
    """A snapshot per inserted or changed record, numbered by its data version."""
    written = planned.where("action <> 'skip'")
    first = c("data_version") == 1
    return written.select(
        c("id").alias("scheme_id"), c("data_version").alias("version_number"),
        snapshot(written.drop("action", "id", "data_version", "stored_created_at")).alias("snapshot"),
        F.when(first, "Initial import").otherwise("Content changed").alias("change_summary"),
        F.lit(MERGED_BY).alias("changed_by"), created_at.alias("created_at"),
    )


def next_versions(changed: DataFrame, history: DataFrame) -> DataFrame:
    """The number each changed scheme's next version gets.

    The history's maximum is taken per scheme on the map side first, so a
    scheme with a long history sends one row per task.
    """
    last = history.groupBy("scheme_id").agg(F.max("version_number").alias("_last"))
    return changed.select("scheme_id").distinct().join(last, "scheme_id", "left").select(
        "scheme_id", (F.coalesce("_last", F.lit(0)) + 1).alias("version_number"))
