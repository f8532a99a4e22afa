"""Catalog queries (F) and roll-ups (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from eligo.operators import bitmaps as B
from eligo.operators import catalog as C
from eligo.operators import normalize as N
from eligo.operators import stats as ST
from eligo.operators import upsert as U
from eligo.registry.common import Registry, big, c, joined
from eligo.session import new_table_path
from eligo.sources import seed

IDS = "select id from f_schemes where "
STATE = "(list_contains(states,'State7') or coalesce(government_level = 'central', false) or len(states) = 0)"
CATEGORY = ("(list_contains(social_categories,'SC') or list_contains(social_categories,'Sc') "
            "or list_contains(beneficiary_types,'sc'))")
BUSINESS = "(list_contains(business_types,'service') or list_contains(business_types,'Service') or len(business_types) = 0)"
GENDER = "(list_contains(gender_eligibility,'Female') or list_contains(gender_eligibility,'Any') or len(gender_eligibility) = 0)"


def _keyword(q: str) -> str:
    return "(" + " or ".join(f"coalesce({f} ilike '%{q}%', false)" for f in ("name", "description", "ministry", "scheme_code")) + ")"


ALL_FACETS = " and ".join(["status = 'active'", STATE, CATEGORY, BUSINESS, GENDER, _keyword("brand#1_")])
SOME_FACETS = " and ".join(["status = 'active'", STATE, CATEGORY, BUSINESS, GENDER])
FACETS = dict(state="state7", category="sc", business_type="service", gender="female", query=" brand#1_ ")


_BITMAPS: dict[tuple[str, str], B.Index] = {}


def bitmap_index(t) -> B.Index:
    """The numbered catalog with its facets' bitmaps, built and stored once for a session's tables."""
    key = t.spark.sparkContext.applicationId, t.sf_dir
    if key not in _BITMAPS:
        _BITMAPS[key] = B.build(t.f_schemes, new_table_path(t.spark, "bitmaps"))
    return _BITMAPS[key]


def seeds(t):
    """Seed records made from the catalog fixture."""
    s = t.f_schemes
    return s.select(
        "id", "scheme_code", "name", "ministry", "department", "government_level", "description",
        "eligibility_text", "beneficiary_types", "gender_eligibility", "social_categories",
        "disability_eligibility", "age_min", c("loan_amount_max").cast("double").alias("loan_amount_max"),
        c("subsidy_percentage").cast("double").alias("subsidy_percentage"), "udyam_required",
        c("business_types").alias("eligible_business_types"), "states", "application_url",
        "official_application_url", F.lit(True).alias("is_seed"),
    )


def with_children(s):
    """The catalog fixture with the child arrays its money and flag columns give."""
    s = s.withColumns({
        "interest_subvention": F.lit(None).cast("double"),
        "startup_requirements": F.lit(False), "farmer_requirements": F.lit(False),
        "loan_amount_max": c("loan_amount_max").cast("double"),
        "subsidy_percentage": c("subsidy_percentage").cast("double"),
        "grant_amount": c("grant_amount").cast("double"),
    })
    return s.withColumns({
        "benefits_structured": N.benefit_list(), "documents": N.document_list(),
        "eligibility_rules": N.rule_list("eligibility_text"),
    })


def _nested(t, one: str | None = None):
    s = with_children(t.f_schemes)
    base = t.f_schemes
    kids = {"benefits": U.benefits(s), "docs": U.documents(s), "rules": U.rules(s)}
    if one is not None:
        out = C.by_id(base, kids, one)
    else:
        out = base
        for name, rows in kids.items():
            out = C.nest(out, rows, name)
    return out.select(
        "id", big(F.size("benefits")).alias("n_benefits"), big(F.size("docs")).alias("n_documents"),
        big(F.size("rules")).alias("n_rules"),
        joined(F.transform("benefits", lambda b: b["description"])).alias("benefit_texts"),
        joined(F.transform("docs", lambda d: d["document_name"])).alias("document_names"),
        joined(F.transform("rules", lambda r: F.concat_ws(" ", r["rule_type"], r["operator"], r["value"],
                                                          F.array_join(r["value_list"], "/")))).alias("rule_texts"),
    )


BENEFITS_SQL = """list_filter([
 case when loan_amount_max <> 0 then 'Loan up to ₹' || format('{:,}', cast(loan_amount_max as bigint)) end,
 case when subsidy_percentage <> 0 then 'Capital subsidy up to ' || cast(cast(subsidy_percentage as double) as varchar) || '%' end,
 case when grant_amount <> 0 then 'Grant of ₹' || format('{:,}', cast(grant_amount as bigint)) end],
 lambda x: x is not null)"""
DOCUMENTS_SQL = """list_filter(['Aadhaar Card / Government Photo ID', 'Passport-size Photographs',
 'Bank Account Details (Passbook / Cancelled Cheque)', 'Project Report / Business Plan',
 case when list_has_any(social_categories, ['SC','ST','OBC']) then 'Caste / Community Certificate (' || array_to_string(social_categories, '/') || ')' end,
 case when disability_eligibility then 'Disability Certificate (UDID / Medical Board)' end,
 case when udyam_required then 'Udyam Registration Certificate' end,
 case when income_limit <> 0 then 'Income Certificate (from competent authority)' end], lambda x: x is not null)"""
RULES_SQL = """list_filter([
 case when age_min <> 0 then 'age gte ' || age_min || ' ' end,
 case when age_max <> 0 then 'age lte ' || age_max || ' ' end,
 case when len(gender_eligibility) > 0 and not list_contains(gender_eligibility,'Any') then 'gender in ' || array_to_string(gender_eligibility, '/') end,
 case when len(social_categories) > 0 then 'social_category in ' || array_to_string(social_categories, '/') end,
 case when income_limit <> 0 then 'income lte ' || cast(income_limit as varchar) || ' ' end,
 case when udyam_required then 'udyam eq true ' end,
 case when disability_eligibility then 'disability eq true ' end,
 case when len(states) > 0 then 'state in ' || array_to_string(states, '/') end,
 case when len(business_types) > 0 then 'business_type in ' || array_to_string(business_types, '/') end],
 lambda x: x is not null)"""
NESTED_SQL = f"""with k as (select id, {BENEFITS_SQL} b, {DOCUMENTS_SQL} d, {RULES_SQL} r from f_schemes)
 select id, cast(len(b) as bigint) n_benefits, cast(len(d) as bigint) n_documents, cast(len(r) as bigint) n_rules,
 array_to_string(b,'|') benefit_texts, array_to_string(d,'|') document_names, array_to_string(r,'|') rule_texts from k"""

DEMOS_SQL = """list_concat(social_categories, list_filter(gender_eligibility, lambda x: lower(x) <> 'any'), beneficiary_types,
 case when disability_eligibility then ['Differently-Abled'] else cast([] as varchar[]) end)"""
# the fixture's lists hold no value twice, so the plain concatenation is already distinct


def register(r: Registry) -> None:
    def ids(name, sql, **args):
        r.add(name, lambda t: t.f_schemes.where(C.facets(**args)).select("id"), IDS + sql, "f_schemes")

    ids("f01_status_filter", "status = 'suspended'", status="SUSPENDED")
    r.add("f01_status_all", lambda t: t.f_schemes.where(C.facets(status="all")).select("id"),
          "select id from f_schemes", "f_schemes")
    ids("f02_state_facet", STATE, status=None, state="state7")
    ids("f03_category_facet", CATEGORY, status=None, category="sc")
    ids("f04_business_facet", BUSINESS, status=None, business_type="service")
    ids("f05_gender_facet", GENDER, status=None, gender="female")
    ids("f06_keyword", _keyword("red w%brand#1_"), status=None, query=" red w%BRAND#1_ ")
    ids("f07_all_facets", ALL_FACETS, **FACETS)
    r.add("f08_total_count", lambda t: C.listing(t.f_schemes, **FACETS)[1],
          f"select count(*) as total from f_schemes where {ALL_FACETS}", "f_schemes")
    r.add("f09_page", lambda t: C.page_of(t.f_schemes, page=3, limit=20).select(
        "id", big("data_quality_score").alias("quality")),
        "select id, cast(data_quality_score as bigint) quality from f_schemes "
        "order by data_quality_score desc, created_at desc, id limit 20 offset 40", "f_schemes")
    r.add("f10_listing", lambda t: C.listing(t.f_schemes, page=2, limit=5, **FACETS)[0].select("id", "name"),
          f"select id, name from f_schemes where {ALL_FACETS} "
          "order by data_quality_score desc, created_at desc, id limit 5 offset 5", "f_schemes")
    some = {k: v for k, v in FACETS.items() if k != "query"}
    r.add("f08_bitmap_counts", lambda t: B.facet_counts(bitmap_index(t), **some).select("facet", "value", big("count").alias("count")),
          f"""with k as (select * from f_schemes where {SOME_FACETS}),
          v as (select 'status' facet, status as value from k union all select 'state', unnest(states) from k
           union all select 'state', '*' from k where coalesce(government_level = 'central', false) or len(states) = 0
           union all select 'category', unnest(social_categories) from k union all select 'beneficiary', unnest(beneficiary_types) from k
           union all select 'business', unnest(business_types) from k union all select 'business', '*' from k where len(business_types) = 0
           union all select 'gender', unnest(gender_eligibility) from k union all select 'gender', '*' from k where len(gender_eligibility) = 0)
          select facet, value, count(*) as count from v group by 1, 2""", "f_schemes")
    r.add("f08_bitmap_total", lambda t: B.total(bitmap_index(t), **some).select(big("total").alias("total")),
          f"select count(*) as total from f_schemes where {SOME_FACETS}", "f_schemes")
    r.add("f09_numbered_page", lambda t: B.page(bitmap_index(t), 3, 20, status=None).select(
        "id", big("data_quality_score").alias("quality")),
        "select id, cast(data_quality_score as bigint) quality from f_schemes "
        "order by data_quality_score desc, created_at desc, id limit 20 offset 40", "f_schemes")
    r.add("f10_bitmap_page", lambda t: B.page(bitmap_index(t), 2, 5, **some).select("id", "name"),
          f"select id, name from f_schemes where {SOME_FACETS} "
          "order by data_quality_score desc, created_at desc, id limit 5 offset 5", "f_schemes")
    r.add("f11_seed_listing", lambda t: C.seed_listing(
        seed.to_response(seeds(t)), category="sc", business_type="SERVICE", gender="male", query="Plate", limit=100,
    ).select("id", "title"),
        """select id, name as title from f_schemes
        where len(list_filter(social_categories, lambda x: lower(x) = 'sc')) > 0
        and len(list_filter(business_types, lambda x: lower(x) = 'service')) > 0
        and len(list_filter(gender_eligibility, lambda x: contains(lower(x), 'male'))) > 0
        and (contains(lower(name), 'plate') or contains(lower(coalesce(description, '')), 'plate'))
        order by id limit 100""", "f_schemes")

    def fallback(t, status):
        found = t.f_schemes.where(C.facets(status=status)).select("id", F.lit("catalog").alias("origin"))
        return C.with_fallback(found, t.f_schemes.where(c("udyam_required")).select("id", F.lit("default").alias("origin")))

    r.add("f12_fallback_taken", lambda t: fallback(t, "merged"),
          "select id, 'default' as origin from f_schemes where udyam_required", "f_schemes")
    r.add("f12_fallback_not_needed", lambda t: fallback(t, "suspended"),
          "select id, 'catalog' as origin from f_schemes where status = 'suspended'", "f_schemes")
    def sourced(t):
        """Schemes with the columns that only stored ones have."""
        return t.f_schemes.withColumns({
            "source_name": F.concat(F.lit("Source "), c("verification_status")), "source_url": c("application_url"),
            "official_source_url": c("official_application_url"),
            "verified_at": F.when(c("verification_status") == "VERIFIED_OFFICIAL", c("created_at")), "updated_at": c("created_at")})

    r.add("f13_response", lambda t: C.response(sourced(t)).select(
        "source_name", "source_url", "official_source_url",
        *[F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x) for x in ("verified_at", "updated_at")],
        "id", "title", "ministry_or_org", "description", "application_url", "verification_status", "status",
        c("max_funding_amount").cast("double").alias("max_funding_amount"),
        joined(c("target_demographics")).alias("target_demographics")),
        f"""select id, name as title, coalesce(nullif(ministry,''), nullif(department,''), 'Government of India') ministry_or_org,
        'Source ' || verification_status as source_name, application_url as source_url, official_application_url as official_source_url,
        strftime(case when verification_status = 'VERIFIED_OFFICIAL' then created_at end, '%Y-%m-%d %H:%M:%S') as verified_at,
        strftime(created_at, '%Y-%m-%d %H:%M:%S') as updated_at,
        coalesce(nullif(description,''), nullif(eligibility_text,''), '') description,
        coalesce(nullif(application_url,''), official_application_url) application_url,
        coalesce(verification_status, 'UNKNOWN') verification_status, status,
        cast(coalesce(nullif(loan_amount_max, 0), grant_amount) as double) max_funding_amount,
        array_to_string({DEMOS_SQL}, '|') target_demographics from f_schemes""", "f_schemes")
    r.add("f14_demographics", lambda t: t.f_schemes.select("id", F.explode(C.demographics()).alias("group")),
          f"select id, unnest({DEMOS_SQL}) as \"group\" from f_schemes", "f_schemes")
    r.add("f15_criteria", lambda t: t.f_schemes.select("id", C.criteria().alias("x")).select(
        "id", "x.requires_udyam", c("x.min_age").cast("double").alias("min_age"), c("x.max_age").cast("double").alias("max_age"),
        "x.disability_eligible"),
        "select id, udyam_required requires_udyam, cast(age_min as double) min_age, cast(age_max as double) max_age, "
        "disability_eligibility disability_eligible from f_schemes", "f_schemes")
    r.add("f16_nested_children", _nested, NESTED_SQL, "f_schemes")
    r.add("a26_point_lookup", lambda t: _nested(t, "77"), NESTED_SQL + " where id = '77'", "f_schemes")
    def details(t):
        """Every scheme's detail view: active ones are stored, the others are known from the seeds only."""
        s = with_children(t.f_schemes)
        kids = {"eligibility_rules": U.rules(s), "benefits": U.benefits(s), "documents": U.documents(s),
                "locations": U.locations(s).withColumn("position", F.coalesce("state_name", F.lit(""))),
                "sources": U.provenance(s.withColumns({"source_url": c("official_application_url"), "source_type": F.lit("api"), "source_name": c("name"),
                                                         "official_source_url": F.lit(None).cast("string")}),
                                        F.lit("2024-01-01").cast("timestamp")).withColumn("position", F.lit(1))}
        known = C.response(t.f_schemes)
        out = C.details(t.f_schemes.select("id"), t.f_schemes.where("status = 'active'"), kids, known)
        return out.select("id", "title", "found_in", *[big(F.size(x)).alias(f"n_{x}") for x in kids],
                          joined(F.transform("locations", lambda x: F.coalesce(x["state_name"], F.lit("national")))).alias("places"),
                          joined(F.transform("sources", lambda x: x["source_url"])).alias("urls"))

    r.add("a26_details", details, f"""with k as (select *, {BENEFITS_SQL} b, {DOCUMENTS_SQL} d, {RULES_SQL} r, list_sort(states) st from f_schemes)
        select id, name as title, case when status = 'active' then 'catalog' else 'seed' end found_in, cast(len(r) as bigint) n_eligibility_rules,
        cast(len(b) as bigint) n_benefits, cast(len(d) as bigint) n_documents, cast(greatest(len(st), 1) as bigint) n_locations, cast(1 as bigint) n_sources,
        case when len(st) = 0 then 'national' else array_to_string(st, '|') end places, official_application_url urls from k""", "f_schemes")
    r.add("f17_candidates", lambda t: C.candidates_by_state(t.f_profiles, t.f_schemes).select(
        "state", big("position").alias("position"), "scheme_id"),
        """with st as (select distinct state from f_profiles)
        select state, position, scheme_id from (
         select st.state, s.id as scheme_id, row_number() over (partition by st.state order by s.data_quality_score desc, s.id) as position
         from st join f_schemes s on s.status = 'active' and (st.state is null or list_contains(s.states, st.state)
          or coalesce(s.government_level = 'central', false) or len(s.states) = 0)) where position <= 50""",
        "f_profiles f_schemes")

    r.add("h01_total", lambda t: ST.total(t.f_schemes), "select count(*) as total from f_schemes", "f_schemes")
    for name, col in (("h02_by_status", "status"), ("h03_by_verification", "verification_status")):
        r.add(name, lambda t, col=col: ST.count_by(t.f_schemes, col),
              f"select {col}, count(*) as count from f_schemes group by 1", "f_schemes")
    top = "select ministry, count(*) as count from f_schemes where ministry is not null group by 1 order by 2 desc, 1 limit 5"
    r.add("h04_top_ministries", lambda t: ST.top_ministries(t.f_schemes), top, "f_schemes")
    def maintained(t):
        """Three runs that each insert and change schemes, told by their deltas only."""
        s = t.f_schemes
        size = F.col("data_quality_score")
        first, second = s.where(size < 60), s.where(size >= 60)
        runs = [ST.delta(None, first.withColumn("status", F.lit("draft"))), ST.delta(None, second.withColumn("ministry", F.lit(None).cast("string"))),
                ST.delta(first.withColumn("status", F.lit("draft")).unionByName(second.withColumn("ministry", F.lit(None).cast("string"))), s)]
        return ST.overview_of(runs[0].unionByName(runs[1]).unionByName(runs[2]))

    r.add("h05_maintained", maintained,
          f"""with m as ({top}) select 'total_schemes' section, null as key, count(*) as count from f_schemes
          union all select 'by_status', status, count(*) from f_schemes group by status
          union all select 'by_verification', verification_status, count(*) from f_schemes group by verification_status
          union all select 'top_ministries', ministry, count from m""", "f_schemes")
    r.add("h05_overview", lambda t: ST.overview(t.f_schemes),
          f"""with m as ({top}) select 'total_schemes' section, null as key, count(*) as count from f_schemes
          union all select 'by_status', status, count(*) from f_schemes group by status
          union all select 'by_verification', verification_status, count(*) from f_schemes group by verification_status
          union all select 'top_ministries', ministry, count from m""", "f_schemes")
