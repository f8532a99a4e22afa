"""Catalog roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
TOP_MINISTRIES = 5


def total(schemes: DataFrame) -> DataFrame:
    return schemes.agg(F.count("*").alias("total"))


def count_by(schemes: DataFrame, col: str) -> DataFrame:
    """Rows per value; null is a group of its own."""
    return schemes.groupBy(col).agg(F.count("*").alias("count"))


def top_ministries(schemes: DataFrame, n: int = TOP_MINISTRIES) -> DataFrame:
    return (
        count_by(schemes.where(c("ministry").isNotNull()), "ministry")
        .orderBy(c("count").desc(), c("ministry").asc()).limit(n)
    )


def overview(schemes: DataFrame, n: int = TOP_MINISTRIES) -> DataFrame:
    """All roll-ups as rows of (section, key, count), from two scans.

    Grouping sets count total, status and verification status in one; what is
    shuffled is one row per group and task. The ministries are ranked apart,
    so that their groups need not be carried beside the others.
    """
    sets = schemes.select("status", "verification_status").groupingSets(
        [[], ["status"], ["verification_status"]], "status", "verification_status",
    ).agg(F.count("*").alias("count"), F.grouping_id().alias("gid"))
    # gid has a bit per column that is rolled up: status 2, verification 1
    section = F.when(c("gid") == 3, "total_schemes").when(c("gid") == 1, "by_status").otherwise("by_verification")
    rows = sets.select(section.alias("section"), F.coalesce("status", "verification_status").alias("key"), "count")
    top = top_ministries(schemes, n).select(F.lit("top_ministries").alias("section"), c("ministry").alias("key"), "count")
    return rows.unionByName(top)


# ---- maintained roll-ups ----------------------------------------------------

CELL = ["status", "verification_status", "ministry"]


def rollup(schemes: DataFrame) -> DataFrame:
    """Counts per status, verification status and ministry, from which all roll-ups above follow."""
    return schemes.groupBy(*CELL).agg(F.count("*").alias("count"))


def delta(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """What a run changes: the counts of the rows it wrote less those of the rows it replaced."""
    new = rollup(after)
    if before is None:
        return new
    both = new.unionByName(rollup(before).withColumn("count", -c("count")))
    return both.groupBy(*CELL).agg(F.sum("count").alias("count")).where("count <> 0")


def overview_of(deltas: DataFrame, n: int = TOP_MINISTRIES) -> DataFrame:
    """:func:`overview` from the deltas of all runs; the catalog is not read."""
    cells = deltas.groupBy(*CELL).agg(F.sum("count").alias("count")).where("count > 0")

    def by(section: str, key: str | None, rows: DataFrame = cells) -> DataFrame:
        name = c(key) if key else F.lit(None).cast("string")
        return rows.groupBy(name.alias("key")).agg(F.sum("count").alias("count")).select(F.lit(section).alias("section"), "key", "count")

    top = by("top_ministries", "ministry", cells.where(c("ministry").isNotNull())).orderBy(c("count").desc(), c("key").asc()).limit(n)
    return by("total_schemes", None).unionByName(by("by_status", "status")).unionByName(
        by("by_verification", "verification_status")).unionByName(top)
