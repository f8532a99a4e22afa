"""The seed catalog: scan and its two projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo import schemas as S
from eligo.functions import lists as L
from eligo.functions import numbers as N
from eligo.functions import text as X
from eligo.operators import conform

c = F.col
SEED_QUALITY = 70  # fixed value


def read_seed(spark: SparkSession, path: str, array_file: bool = True) -> DataFrame:
    """Records of a JSON array file, or of JSON lines; none if there is no file."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return spark.createDataFrame([], S.SEED)
    return spark.read.schema(S.SEED).option("multiLine", array_file).json(path)


def to_canonical(seeds: DataFrame) -> DataFrame:
    """Seed records as canonical ones, without rules and benefits."""
    s = conform(seeds, S.SEED)

    def off(name: str):
        return F.coalesce(c(name), F.lit(False)).alias(name)

    return s.select(
        "id", "name", "scheme_code", "ministry", "department", "implementing_agency",
        F.coalesce("government_level", F.lit("central")).alias("government_level"), "funding_type",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("eligibility_text", F.lit("")).alias("eligibility_text"),
        *[L.or_empty(c(f)).alias(f)
          for f in ("states", "beneficiary_types", "social_categories", "gender_eligibility")],
        off("disability_eligibility"), "age_min", "loan_amount_max", "subsidy_percentage", "grant_amount",
        off("udyam_required"), off("startup_requirements"),
        L.or_empty(c("eligible_business_types")).alias("business_types"),
        "application_url", "official_application_url", "source_name", "source_url",
        "official_source_url",
        F.coalesce("source_type", F.lit("official_portal")).alias("source_type"),
        F.coalesce("verification_status", F.lit("OFFICIAL_NEEDS_REVIEW")).alias("verification_status"),
        F.lit("active").alias("status"), F.lit(SEED_QUALITY).alias("data_quality_score"),
        F.lit(True).alias("is_seed"),
        F.array().cast(_array(S.RULE)).alias("eligibility_rules"),
        F.array().cast(_array(S.BENEFIT)).alias("benefits_structured"),
        (N.nonzero(c("loan_amount_max")) | N.nonzero(c("subsidy_percentage"))).alias("financial_benefit"),
    )


def _array(schema) -> str:
    return f"array<{schema.simpleString()}>"


def to_response(seeds: DataFrame) -> DataFrame:
    """Seed records as listing responses."""
    s = conform(seeds, S.SEED)
    genders = F.filter(L.or_empty(c("gender_eligibility")), lambda g: g != "Any")

    def money(name: str, kind: str):
        return F.when(N.nonzero(c(name)), c(name).cast(kind))

    return s.select(
        "id", c("name").alias("title"),
        F.coalesce(X.text_or(c("ministry")), F.lit("Government of India")).alias("ministry_or_org"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.concat(L.or_empty(c("social_categories")), genders).alias("target_demographics"),
        L.or_empty(c("eligible_business_types")).alias("eligible_business_types"),
        money("loan_amount_max", "decimal(15,2)").alias("max_funding_amount"),
        money("subsidy_percentage", "decimal(5,2)").alias("subsidy_percentage"),
        "application_url",
        F.coalesce("udyam_required", F.lit(False)).alias("requires_udyam"),
        F.coalesce("age_min", F.lit(18)).alias("min_age"),
        "scheme_code", F.lit("active").alias("status"),
        F.coalesce("government_level", F.lit("central")).alias("government_level"),
        F.coalesce("funding_type", F.lit("central_sector")).alias("funding_type"),
        *[L.or_empty(c(f)).alias(f)
          for f in ("states", "beneficiary_types", "gender_eligibility", "social_categories")],
        F.coalesce("disability_eligibility", F.lit(False)).alias("disability_eligibility"),
        F.coalesce("udyam_required", F.lit(False)).alias("udyam_required"),
        F.coalesce("verification_status", F.lit("OFFICIAL_NEEDS_REVIEW")).alias("verification_status"),
        "source_name", "source_url", "official_source_url",
        F.lit(SEED_QUALITY).alias("data_quality_score"),
    )
