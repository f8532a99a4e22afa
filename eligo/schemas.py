"""Explicit schemas for every table and in-flight record."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _B, _I, _D, _L = T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType(), T.LongType()
STRINGS = T.ArrayType(T.StringType())
MONEY, PERCENT = T.DecimalType(15, 2), T.DecimalType(5, 2)


def struct(**cols) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


RULE = struct(
    rule_type=_S, operator=_S, field=_S, value=_S, value_min=_S, value_max=_S,
    value_list=STRINGS, logical_group=_S, required=_B, source_text=_S,
)
BENEFIT = struct(benefit_type=_S, amount=_D, percentage=_D, unit=_S, description=_S, conditions=_S)
DOCUMENT = struct(
    document_name=_S, mandatory=_B, conditional=_B, condition=_S, issuing_authority=_S,
)
ORD = struct(source=_I, url=_S, fetch=_S, record=_I)  # ``fetch`` tells two payloads of one url apart

# Landed payloads, one row per fetch.
FETCHES = struct(
    url=_S, source_id=_S, status=_I, content=T.BinaryType(), content_type=_S, error=_S,
)

# A parsed record before normalization: the union of all keys a source may
# use. Where a source spells one thing several ways, all spellings are kept.
RAW = struct(
    ingest_ord=ORD, _source_id=_S, _source_url=_S, content_hash=_S,
    name=_S, title=_S, short_name=_S, scheme_code=_S, schemeId=_S, status=_S,
    description=_S, schemeDescription=_S, ministry=_S, nodal_ministry=_S, department=_S,
    implementing_agency=_S, implementingAgency=_S, funding_type=_S, government_level=_S,
    states=STRINGS, state=STRINGS, rural_urban_scope=_S,
    gender_eligibility=STRINGS, gender=STRINGS, social_categories=STRINGS, caste=STRINGS,
    disability_eligibility=_B, beneficiary_types=STRINGS, targetBeneficiary=STRINGS,
    eligibility_text=_S, age_min=_S, age_max=_S,
    loan_amount_min=_S, loan_amount_max=_S, max_funding_amount=_S, subsidy_amount=_S,
    subsidy_percentage=_S, grant_amount=_S, interest_subvention=_S, collateral_requirement=_S,
    income_limit=_S, annualIncome=_S, business_types=STRINGS, sector=STRINGS, categories=STRINGS,
    udyam_required=_B, startup_requirements=_B, farmer_requirements=_B, artisan_requirements=_B,
    student_requirements=_B, msme_requirements=_B, enterprise_size=_S,
    benefits_text=_S, benefits=_S, schemeDetails=_S, application_url=_S, applyLink=_S,
    official_application_url=_S, application_steps=_S, howToApply=_S, source_name=_S,
    source_url=_S, official_source_url=_S, source_type=_S,
)

# A seed file record.
SEED = struct(
    id=_S, scheme_code=_S, name=_S, ministry=_S, department=_S, implementing_agency=_S,
    funding_type=_S, government_level=_S, description=_S, eligibility_text=_S,
    beneficiary_types=STRINGS, gender_eligibility=STRINGS, social_categories=STRINGS,
    disability_eligibility=_B, age_min=_I, loan_amount_max=_D, subsidy_percentage=_D,
    grant_amount=_D, udyam_required=_B, startup_requirements=_B, eligible_business_types=STRINGS,
    states=STRINGS, application_url=_S, official_application_url=_S, source_name=_S, source_url=_S,
    official_source_url=_S, source_type=_S, verification_status=_S, is_seed=_B,
)

PROFILES = struct(
    profile_id=_L, full_name=_S, email=_S, phone=_S, gender=_S, social_category=_S,
    is_differently_abled=_B, business_name=_S, business_type=_S, annual_turnover=MONEY,
    state=_S, district=_S, is_udyam_registered=_B, profile_summary=_S,
)
# Filled in when the attribute is absent from the input; an explicit null stays.
PROFILE_DEFAULTS = {
    "gender": "Female", "social_category": "General", "is_differently_abled": False,
    "business_type": "Manufacturing", "annual_turnover": 0, "is_udyam_registered": False,
}
