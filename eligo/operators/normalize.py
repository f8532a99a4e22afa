"""Raw records to canonical records: one narrow pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eligo import constants as K
from eligo import schemas as S
from eligo.functions import lists as L
from eligo.functions import numbers as N
from eligo.functions import text as X
from eligo.operators import conform

c = F.col


# ---- structured children, built from the canonical columns -----------------

def _structs(schema: StructType, cases: list[tuple[str, dict[str, str]]]) -> Column:
    """Structs of the cases whose condition holds, in the order given.

    Conditions and fields are SQL over the canonical columns; a field that a
    case does not name is null.
    """
    def build(fields: dict[str, str]) -> str:
        return ", ".join(
            f"'{f.name}', cast({fields.get(f.name, 'null')} as {f.dataType.simpleString()})" for f in schema.fields)

    whens = ", ".join(f"case when {cond} then named_struct({build(fields)}) end" for cond, fields in cases)
    return F.expr(f"array_compact(array({whens}))")


def rule_list(source: str) -> Column:
    """At most nine atomic eligibility rules of a canonical record.

    ``source`` names the column with the text the rules were read from.
    """
    head, extracted = f"left({source}, 200)", f"concat('Extracted from: ', left({source}, 200))"

    def rule(cond, kind, op, field, required, value="null", values="null", text=head):
        return cond, {
            "rule_type": f"'{kind}'", "operator": f"'{op}'", "field": f"'{field}'", "value": value,
            "value_list": values, "logical_group": "'AND'", "required": str(required).lower(),
            "source_text": text,
        }

    restricted = "size(gender_eligibility) > 0 and not array_contains(gender_eligibility, 'Any')"
    return _structs(S.RULE, [
        rule("age_min <> 0", "age", "gte", "age", True, "age_min", text=extracted),
        rule("age_max <> 0", "age", "lte", "age", True, "age_max", text=extracted),
        rule(restricted, "gender", "in", "gender", True, values="gender_eligibility"),
        rule("size(social_categories) > 0", "social_category", "in", "social_category", False,
             values="social_categories"),
        rule("income_limit <> 0", "income", "lte", "annual_income", True, N.plain_float_sql("income_limit")),
        rule("udyam_required", "udyam", "eq", "is_udyam_registered", False, "'true'"),
        rule("disability_eligibility", "disability", "eq", "is_differently_abled", False, "'true'"),
        rule("size(states) > 0", "state", "in", "state", True, values="states", text="'Geographic scope'"),
        rule("size(business_types) > 0", "business_type", "in", "business_type", False,
             values="business_types"),
    ])


def benefit_list() -> Column:
    """At most four benefits from the money columns."""
    def money(col, kind, text):
        return f"{col} <> 0", {
            "benefit_type": f"'{kind}'", "amount": col,
            "description": f"concat('{text}', format_number({col}, 0))",
        }

    def share(col, kind, text):
        return f"{col} <> 0", {
            "benefit_type": f"'{kind}'", "percentage": col,
            "description": f"concat('{text}', {N.plain_float_sql(col)}, '%')",
        }

    return _structs(S.BENEFIT, [
        money("loan_amount_max", "loan", "Loan up to ₹"),
        share("subsidy_percentage", "subsidy", "Capital subsidy up to "),
        money("grant_amount", "grant", "Grant of ₹"),
        share("interest_subvention", "interest_subvention", "Interest subvention of "),
    ])


def document_list() -> Column:
    """At most ten documents an applicant needs, four of them always."""
    def doc(cond, name, mandatory=True, conditional=False, condition=None):
        return cond, {
            "document_name": name, "mandatory": str(mandatory).lower(),
            "conditional": str(conditional).lower(),
            "condition": f"'{condition}'" if condition else "null",
        }

    caste = "concat('Caste / Community Certificate (', array_join(social_categories, '/'), ')')"
    return _structs(S.DOCUMENT, [
        *[doc("true", f"'{name}'") for name in K.BASE_DOCUMENTS],
        doc("arrays_overlap(social_categories, array('SC', 'ST', 'OBC'))", caste,
            condition="Required for SC/ST/OBC applicants"),
        doc("disability_eligibility", "'Disability Certificate (UDID / Medical Board)'", False, True,
            "Required for PwD/Divyang applicants"),
        doc("udyam_required", "'Udyam Registration Certificate'",
            condition="Obtain free at udyamregistration.gov.in"),
        doc("startup_requirements", "'Startup Registration / DPIIT Recognition'", False, True),
        doc("farmer_requirements", "'Land Records / Khasra-Khatauni'"),
        doc("income_limit <> 0", "'Income Certificate (from competent authority)'"),
    ])


def quality_score() -> Column:
    """0 to 100 points for what a canonical record has filled in."""
    points = [
        ("name <> ''", 15),
        ("length(description) > 50", 15),
        ("ministry <> ''", 10),
        ("length(eligibility_text) > 30", 15),
        ("benefits_text <> '' or size(benefits_structured) > 0", 10),
        ("official_application_url <> ''", 10),
        ("official_source_url <> ''", 10),
        ("age_min <> 0 or size(social_categories) > 0 or size(gender_eligibility) > 0", 10),
        ("source_type = 'api'", 5),
    ]
    total = " + ".join(f"case when {cond} then {n} else 0 end" for cond, n in points)
    return F.expr(f"least({total}, 100)")


def initial_verification() -> Column:
    trusted = (c("source_type") == "api") & c("_source_id").isin(K.VERIFIED_API_SOURCES)
    return F.when(trusted, "OFFICIAL_NEEDS_REVIEW").otherwise("SECONDARY_NEEDS_VERIFICATION")


# ---- the pass ---------------------------------------------------------------

# canonical name -> its spellings; the first that holds a value wins
CLEANED = {
    "name": ["name", "title"],
    "scheme_code": ["scheme_code", "schemeId"],
    "description": ["description", "schemeDescription"],
    "ministry": ["ministry", "nodal_ministry"],
    "department": ["department"],
    "implementing_agency": ["implementing_agency", "implementingAgency"],
    "enterprise_size": ["enterprise_size"],
    "benefits_text": ["benefits_text", "benefits", "schemeDetails"],
    "application_url": ["application_url", "applyLink"],
    "application_steps": ["application_steps", "howToApply"],
    "source_name": ["source_name", "_source_id"],
    "source_url": ["source_url", "_source_url"],
}
AS_GIVEN = {
    "raw_short_name": ["short_name"],
    "raw_status": ["status"],
    "raw_funding_type": ["funding_type"],
    "raw_level": ["government_level"],
    "raw_scope": ["rural_urban_scope"],
    "raw_eligibility": ["eligibility_text"],
    "raw_age_min": ["age_min"],
    "raw_age_max": ["age_max"],
    "loan_amount_min": ["loan_amount_min"],
    "loan_amount_max": ["loan_amount_max", "max_funding_amount"],
    "subsidy_amount": ["subsidy_amount"],
    "subsidy_percentage": ["subsidy_percentage"],
    "grant_amount": ["grant_amount"],
    "interest_subvention": ["interest_subvention"],
    "raw_income": ["income_limit", "annualIncome"],
    "raw_official_application_url": ["official_application_url"],
    "raw_official_source_url": ["official_source_url"],
}
LISTS = {
    "raw_states": ["states", "state"],
    "raw_genders": ["gender_eligibility", "gender"],
    "raw_categories": ["social_categories", "caste"],
    "raw_beneficiaries": ["beneficiary_types", "targetBeneficiary"],
    "raw_business": ["business_types", "sector", "categories"],
}


def resolve_aliases(raw: DataFrame) -> DataFrame:
    """One column per meaning: the first spelling that holds a value wins."""
    def given(names):
        return "coalesce(" + ", ".join(f"nullif(`{n}`, '')" for n in names) + ")"

    def listed(names):
        some = ", ".join(f"case when size(`{n}`) > 0 then `{n}` end" for n in names)
        return f"coalesce({some}, cast(array() as array<string>))"

    return conform(raw, S.RAW).selectExpr(
        "ingest_ord", "content_hash", "_source_id", "collateral_requirement",
        *[f"{X.clean_sql(given(names))} as {out}" for out, names in CLEANED.items()],
        *[f"{given(names)} as {out}" for out, names in AS_GIVEN.items()],
        *[f"{listed(names)} as {out}" for out, names in LISTS.items()],
        "coalesce(disability_eligibility, false) as raw_disability",
        *[f"coalesce({f}, false) as {f}" for f in K.FLAG_WORDS],
        f"{X.clean_sql(chr(96) + 'source_type' + chr(96))} as raw_source_type",
    ).withColumn("source_type", F.expr("coalesce(nullif(raw_source_type, ''), 'unknown')")).drop("raw_source_type")


def _bad_age() -> Column:
    """An age is given but is no number."""
    def bad(name: str) -> Column:
        return c(name).isNotNull() & N.parse_int(c(name)).isNull()

    return bad("raw_age_min") | bad("raw_age_max")


def quarantine(raw: DataFrame) -> DataFrame:
    """Named records whose age cannot be read, kept apart for repair."""
    return resolve_aliases(raw).where(X.filled(c("name")) & _bad_age())


def normalize(raw: DataFrame, whole_words: bool = False) -> DataFrame:
    """Raw records to canonical records.

    Nameless records are dropped, records with an unreadable age go to
    :func:`quarantine`. A pure projection: it adds no shuffle to its input.
    """
    df = resolve_aliases(raw).where(X.filled(c("name")) & ~_bad_age())
    # texts of some thousand characters are looked through for many words: each is lowered once, in a projection of its own
    df = df.withColumn("elig", F.coalesce(c("raw_eligibility"), c("description"))).withColumns({
        "low_description": X.lowered(c("description")), "low_raw": X.lowered(c("raw_eligibility"))})
    df = df.withColumn("low", F.when(c("raw_eligibility").isNotNull(), c("low_raw")).otherwise(c("low_description")))
    df = df.withColumns({f"{name}_text": text for name, text in N.number_texts(c("elig"), c("low")).items()})
    low, low_description = c("low"), c("low_description")
    df = df.select(
        "ingest_ord", "content_hash", "_source_id", "elig",
        "name",
        F.coalesce(c("raw_short_name"), X.short_name(c("name"))).alias("short_name"),
        X.slug(c("name")).alias("slug"),
        "scheme_code",
        X.status_of(c("raw_status")).alias("status"),
        "description", "ministry", "department", "implementing_agency",
        X.map_contained(c("raw_funding_type"), K.FUNDING_TYPES, "").alias("funding_type"),
        X.map_contained(c("raw_level"), K.GOVERNMENT_LEVELS, "central").alias("government_level"),
        L.trim_items(c("raw_states")).alias("states"),
        F.when(c("raw_scope").isNotNull(), X.rural_urban(c("raw_scope")))
        .otherwise(X.rural_urban(c("description"), low_description)).alias("rural_urban_scope"),
        L.genders(c("raw_genders"), c("elig"), low).alias("gender_eligibility"),
        L.social_categories(c("raw_categories"), c("elig"), whole_words, low).alias("social_categories"),
        (c("raw_disability") | X.has_any(c("raw_eligibility"), K.DISABILITY_WORDS, c("low_raw")))
        .alias("disability_eligibility"),
        L.trim_items(c("raw_beneficiaries")).alias("beneficiary_types"),
        F.when(c("raw_age_min").isNotNull(), N.parse_int(c("raw_age_min")))
        .otherwise(N.age_min(c("age_min_text"))).alias("age_min"),
        F.when(c("raw_age_max").isNotNull(), N.parse_int(c("raw_age_max")))
        .otherwise(N.age_max(c("age_max_text"))).alias("age_max"),
        *[N.parse_amount(c(a)).alias(a)
          for a in ("loan_amount_min", "loan_amount_max", "subsidy_amount", "grant_amount")],
        *[N.parse_float(c(p)).alias(p) for p in ("subsidy_percentage", "interest_subvention")],
        N.parse_bool(c("collateral_requirement")).alias("collateral_requirement"),
        F.coalesce(F.nullif(N.parse_amount(c("raw_income")), F.lit(0.0)), N.income_limit(c("income_text")))
        .alias("income_limit"),
        F.lit("annual").alias("income_limit_period"),
        L.business_types(c("raw_business"), c("description"), whole_words, low_description).alias("business_types"),
        *[(c(f) | X.has_any(c("elig"), words, low)).alias(f) for f, words in K.FLAG_WORDS.items()],
        "enterprise_size",
        F.when(c("raw_eligibility").isNotNull(), X.clean(c("raw_eligibility"))).otherwise(c("description"))  # that is clean
        .alias("eligibility_text"),
        "benefits_text", "application_url",
        X.clean(F.coalesce(c("raw_official_application_url"), c("application_url")))
        .alias("official_application_url"),
        "application_steps", "source_name", "source_url",
        X.clean(F.coalesce(c("raw_official_source_url"), c("source_url"))).alias("official_source_url"),
        "source_type",
        initial_verification().alias("verification_status"),
    )
    df = df.withColumns({
        "eligibility_rules": rule_list("elig"),
        "benefits_structured": benefit_list(),
        "financial_benefit": N.nonzero(c("loan_amount_max")) | N.nonzero(c("subsidy_percentage"))
        | N.nonzero(c("grant_amount")),
    })
    return df.withColumns({
        "documents": document_list(),
        "data_quality_score": quality_score(),
    }).drop("elig")


def matches_category(word: str) -> Column:
    """A word anywhere in name, ministry, description head, types or categories."""
    text = F.concat_ws(
        " ", c("name"), c("ministry"), F.left(c("description"), F.lit(200)),
        F.array_join("business_types", " "), F.array_join("social_categories", " "),
    )
    return F.lower(text).contains(word.lower())


def in_category(df: DataFrame, word: str) -> DataFrame:
    """The records that match a category.

    They come out of a generator: a filter would be pushed below the pass and work out its columns a second time, over and
    over where they build on each other.
    """
    hit = F.struct(matches_category(word).alias("_hit"))
    return df.select("*", F.inline(F.filter(F.array(hit), lambda r: r["_hit"]))).drop("_hit")


def snapshot(df: DataFrame) -> Column:
    """A record as JSON, without its in-flight columns."""
    inner = {"_raw", "_source_id", "ingest_ord", "dedup_key", "errors", "warnings", "valid"}
    return F.to_json(F.struct(*[c(n) for n in df.columns if n not in inner]))

