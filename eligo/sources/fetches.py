"""Landed payloads: outcome, hash, change detection, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.schemas import FETCHES

c = F.col


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FETCHES).parquet(path)


def stream_fetches(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(FETCHES).option("maxFilesPerTrigger", max_files).parquet(path)


def land(fetches: DataFrame, path: str, mode: str = "append") -> None:
    """Payloads filed by source, so that each parser reads its own folder only."""
    fetches.write.mode(mode).partitionBy("source_id").parquet(path)


def is_ok() -> Column:
    return F.coalesce(c("status").between(200, 299), F.lit(False)) & c("error").isNull()


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def error_text() -> Column:
    """What went wrong: the recorded error, or the status itself from 400 up."""
    return F.coalesce(c("error"), F.when(c("status") >= 400, F.concat(F.lit("HTTP "), c("status").cast("string"))),
                      F.lit("None"))


def failure_message() -> Column:
    return F.concat(F.lit("Fetch failed "), c("url"), F.lit(": HTTP "),
                    F.coalesce(c("status").cast("string"), F.lit("None")), F.lit(" — "), error_text())


def latest_hashes(provenance: DataFrame) -> DataFrame:
    """(url, content_hash) as last recorded; combined on the map side."""
    return provenance.groupBy(c("source_url").alias("url")).agg(
        F.max_by("content_hash", "checked_at").alias("content_hash"))


def classify(fetches: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Adds ``content_hash`` and ``outcome``: ok, unchanged or failed.

    ``known`` holds one hash per url. Without it nothing is unchanged and no
    join is made. A url fetched over and over is a hot key on the left side of
    the join, which adaptive execution splits.
    """
    hashed = fetches.withColumn("content_hash", F.when(is_ok(), content_hash(c("content"))))
    if known is None:
        same = F.lit(False)
    else:
        seen = known.select("url", c("content_hash").alias("_known"))
        hashed = hashed.join(seen, "url", "left")
        same = F.coalesce(c("content_hash") == c("_known"), F.lit(False))
    out = F.when(~is_ok(), "failed").when(same, "unchanged").otherwise("ok")
    return hashed.withColumn("outcome", out).drop("_known")


def decoded(content: Column) -> Column:
    """UTF-8 text; bytes that are none become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))
