"""Record checks: errors block a record, warnings travel with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligo import constants as K
from eligo.functions import text as X

c = F.col


def _messages(*cases: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, msg) for cond, msg in cases]))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def name_errors() -> list[tuple[Column, Column]]:
    return [
        (~X.filled(c("name")), F.lit("Missing required field: name")),
        (X.filled(c("name")) & (F.length("name") < 5), _text("Scheme name too short: '", c("name"), "'")),
    ]


def quality_errors(min_quality: int = K.MIN_QUALITY) -> list[tuple[Column, Column]]:
    score = F.coalesce(c("data_quality_score"), F.lit(0))
    return [(score < min_quality,
             _text("Data quality score ", score.cast("string"), f" below minimum {min_quality}"))]


def status_known() -> Column:
    return ~X.filled(c("status")) | c("status").isin(K.VALID_STATUSES)


def url_warnings() -> list[tuple[Column, Column]]:
    return [
        (X.filled(c(f)) & ~X.valid_url(c(f)), _text(f"Invalid URL format in {f}: ", c(f)))
        for f in K.URL_FIELDS
    ]


def missing_warnings() -> list[tuple[Column, Column]]:
    return [(~X.filled(c(f)), F.lit(f"Recommended field missing: {f}")) for f in K.RECOMMENDED_FIELDS]


def _unverified() -> Column:
    return F.coalesce(c("verification_status") == "VERIFIED_OFFICIAL", F.lit(False)) & c("verified_at").isNull()


def validate(df: DataFrame, min_quality: int = K.MIN_QUALITY) -> DataFrame:
    """Adds ``errors``, ``warnings`` and ``valid``; repairs both status columns."""
    absent = [f for f in (*K.URL_FIELDS, *K.RECOMMENDED_FIELDS, "status", "verification_status")
              if f not in df.columns]
    df = df.withColumns({f: F.lit(None).cast("string") for f in dict.fromkeys(absent)})
    if "verified_at" not in df.columns:
        df = df.withColumn("verified_at", F.lit(None).cast("timestamp"))
    repaired = F.when(status_known(), c("status")).otherwise("unknown")
    errors = _messages(*name_errors(), *quality_errors(min_quality))
    warnings = _messages(
        (~status_known(), _text("Unknown status '", c("status"), "' — will be set to 'unknown'")),
        *url_warnings(),
        *missing_warnings(),
        ((repaired == "discontinued") & ~X.filled(c("description")),
         F.lit("Discontinued scheme has no description")),
        (_unverified(),
         F.lit("VERIFIED_OFFICIAL but no verified_at timestamp — resetting to OFFICIAL_NEEDS_REVIEW")),
    )
    return df.withColumns({
        "errors": errors,
        "warnings": warnings,
        "status": repaired,
        "verification_status": F.when(_unverified(), "OFFICIAL_NEEDS_REVIEW")
        .otherwise(c("verification_status")),
    }).withColumn("valid", F.size("errors") == 0)


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and invalid ones with ``validation_errors``."""
    return (
        checked.where("valid"),
        checked.where("not valid").withColumn("validation_errors", c("errors")),
    )


def liveness(urls: DataFrame, statuses: DataFrame) -> DataFrame:
    """Each ``url`` with its recorded ``status`` and whether that is 2xx or 3xx.

    ``statuses`` holds the latest status per url. A url without one has
    status 0 and is not live.
    """
    seen = statuses.select("url", c("status").alias("http_status"))
    return urls.join(seen, "url", "left").withColumns({
        "http_status": F.coalesce("http_status", F.lit(0)),
        "live": F.coalesce(c("http_status").between(200, 399), F.lit(False)),
    })
