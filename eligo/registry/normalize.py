"""Normalization (B) and validation (C) queries over the raw record fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from eligo import constants as K
from eligo.functions import lists as L
from eligo.functions import numbers as N
from eligo.functions import text as X
from eligo.operators import normalize as NZ
from eligo.operators import validate as V
from eligo.registry.common import Registry, any_word, big, c, contained, exact, joined

USES = "f_raw"
ORD = "ingest_ord"


def raw(t):
    """The raw fixture in the shape parsers give: lists as arrays."""
    return t.f_raw.withColumns({
        "states": L.split_text(c("state_text")), "gender": L.split_text(c("gender_text")),
        "caste": L.split_text(c("caste_text")), "sector": L.split_text(c("sector_text")),
        "_source_id": c("source_id"), "_source_url": F.concat(F.lit("https://feed.example.org/"), c(ORD).cast("string")),
    })


def normal(t):
    """Canonical records, with the fixture's own arrival number alongside."""
    base = raw(t)
    cols = base.withColumn("ingest_ord", F.struct(
        F.lit(0).alias("source"), F.lit("").alias("url"), F.lit("").alias("fetch"), c(ORD).cast("int").alias("record")))
    return NZ.normalize(cols).withColumn("n", c("ingest_ord.record").cast("bigint"))


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def slug(x: str) -> str:
    return (f"left(trim(regexp_replace(regexp_replace(lower({x}), '[^\\w\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '-'), 200)")


def split(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[,;/]'), "
            f"lambda v: trim(v)), lambda v: v <> '')")


def amount(x: str, pattern: str, small: bool = True) -> str:
    p = pattern.replace("'", "''")
    unit = f"lower(regexp_extract({x}, '{p}', 2))"
    more = f" when {unit} in ('thousand','k') then 1000.0" if small else ""
    return (f"cast(try_cast(nullif(regexp_extract({x}, '{p}', 1), '') as double) * "
            f"case when starts_with({unit}, 'la') then 100000.0 when starts_with({unit}, 'cr') then 10000000.0{more} else 1.0 end as double)")


def number(x: str, pattern: str) -> str:
    return f"try_cast(nullif(regexp_extract({x}, '{pattern}', 1), '') as double)"


def found(items: str, text: str, mapping: dict[str, str]) -> str:
    """The sorted distinct values that list items map to or that keys in the text give."""
    mapped = f"list_transform({split(items)}, lambda v: {exact('lower(v)', mapping, 'null')})"
    scan = "[" + ", ".join(f"case when contains(lower({text}), '{k}') then '{v}' end" for k, v in mapping.items()) + "]"
    return f"list_sort(list_distinct(list_filter(list_concat({mapped}, {scan}), lambda v: v is not null)))"


def genders(items: str, text: str) -> str:
    mapped = f"list_transform({split(items)}, lambda v: {exact('lower(v)', K.GENDERS, 'null')})"
    female = any_word(text, K.FEMALE_WORDS)
    scan = (f"[case when {female} then 'Female' end, "
            f"case when {any_word(text, ['male'])} and not {any_word(text, ['female'])} then 'Male' end]")
    out = f"list_sort(list_distinct(list_filter(list_concat({mapped}, {scan}), lambda v: v is not null)))"
    return f"case when len({out}) > 0 then {out} else ['Any'] end"


RURAL = """case when {r} and not {u} then 'rural' when {u} and not {r} then 'urban' else 'both' end""".format(
    r="contains(lower({x}),'rural')", u="contains(lower({x}),'urban')")
def canon_sql(source: str = "f_raw", x: str = "") -> str:
    """The canonical records of ``source`` as CTEs that end in ``nk<x>``; each reads the one before."""
    return f"""a{x} as (select *, {clean('name')} nm, {clean('description')} ds, {clean('ministry')} mi from {source}),
b{x} as (select *, coalesce(nullif(eligibility_text,''), ds) el from a{x}),
n{x} as (select ingest_ord as n, nm as name,
 case when regexp_matches(nm, '{K.ACRONYM}') then regexp_extract(nm, '{K.ACRONYM}', 1)
  when len(string_split(nm, ' ')) > 4 then array_to_string(string_split(nm, ' ')[1:4], ' ') || '...' else nm end short_name,
 {slug('nm')} slug, {clean('scheme_code')} scheme_code,
 {exact("coalesce(lower(status), '')", K.STATUSES, "'active'")} status, ds as description, mi as ministry,
 {contained("trim(lower(coalesce(government_level,'')))", K.GOVERNMENT_LEVELS, "'central'")} government_level,
 {split('state_text')} states, {RURAL.format(x='ds')} rural_urban_scope,
 {genders('gender_text', 'el')} gender_eligibility, {found('caste_text', 'el', K.SOCIAL_CATEGORIES)} social_categories,
 {any_word('eligibility_text', K.DISABILITY_WORDS)} disability_eligibility,
 {number('el', K.AGE_MIN)} age_min, {number('el', K.AGE_MAX)} age_max,
 {amount('loan_amount_max', K.AMOUNT)} loan_amount_max, try_cast(subsidy_percentage as double) subsidy_percentage,
 case when collateral_requirement is not null then lower(collateral_requirement) in ('true','yes','1','required') end collateral_requirement,
 {amount('el', K.INCOME, False)} income_limit, {found('sector_text', 'ds', K.BUSINESS_TYPES)} business_types,
 {any_word('el', K.FLAG_WORDS['udyam_required'])} udyam_required, {any_word('el', K.FLAG_WORDS['startup_requirements'])} startup_requirements,
 {any_word('el', K.FLAG_WORDS['farmer_requirements'])} farmer_requirements, {any_word('el', K.FLAG_WORDS['artisan_requirements'])} artisan_requirements,
 {any_word('el', K.FLAG_WORDS['student_requirements'])} student_requirements, {any_word('el', K.FLAG_WORDS['msme_requirements'])} msme_requirements,
 el, {clean('el')} eligibility_text, '' benefits_text, {clean('application_url')} application_url, {clean('application_url')} official_application_url,
 source_id, source_id as source_name, 'https://feed.example.org/' || ingest_ord as source_url, 'https://feed.example.org/' || ingest_ord as official_source_url, source_type,
 case when source_type = 'api' and source_id in ('apisetu_myscheme','data_gov_in') then 'OFFICIAL_NEEDS_REVIEW' else 'SECONDARY_NEEDS_VERIFICATION' end verification_status
 from b{x}),
nq{x} as (select *, coalesce(loan_amount_max,0) <> 0 or coalesce(subsidy_percentage,0) <> 0 financial_benefit,
 cast(least(100, case when name <> '' then 15 else 0 end + case when len(description) > 50 then 15 else 0 end + case when ministry <> '' then 10 else 0 end
 + case when len(eligibility_text) > 30 then 15 else 0 end + case when coalesce(loan_amount_max,0) <> 0 or coalesce(subsidy_percentage,0) <> 0 then 10 else 0 end
 + case when official_application_url <> '' then 10 else 0 end + case when official_source_url <> '' then 10 else 0 end + 10
 + case when source_type = 'api' then 5 else 0 end) as bigint) data_quality_score from n{x}),
nk{x} as (select *, case when trim(scheme_code) <> '' and government_level <> '' then 'code:' || trim(scheme_code) || ':' || government_level
 else 'name:' || trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '\\bpradhan\\s+mantri\\b', 'pm', 'g'),
 '\\b(scheme|programme|yojana|mission)\\b', '', 'g'), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || ':' || left(trim(lower(ministry)), 50) end dedup_key from nq{x})
"""


CANON = "with " + canon_sql()

RULES_SQL = """select n, 1 o, 'age' rule_type, 'gte' op, cast(cast(age_min as bigint) as varchar) val, true req, 'Extracted from: ' || left(el, 200) src from nk where age_min <> 0
 union all select n, 2, 'age', 'lte', cast(cast(age_max as bigint) as varchar), true, 'Extracted from: ' || left(el, 200) from nk where age_max <> 0
 union all select n, 3, 'gender', 'in', array_to_string(gender_eligibility,'/'), true, left(el, 200) from nk where not list_contains(gender_eligibility, 'Any')
 union all select n, 4, 'social_category', 'in', array_to_string(social_categories,'/'), false, left(el, 200) from nk where len(social_categories) > 0
 union all select n, 5, 'income', 'lte', cast(cast(income_limit as bigint) as varchar) || '.0', true, left(el, 200) from nk where income_limit <> 0
 union all select n, 6, 'udyam', 'eq', 'true', false, left(el, 200) from nk where udyam_required
 union all select n, 7, 'disability', 'eq', 'true', false, left(el, 200) from nk where disability_eligibility
 union all select n, 8, 'state', 'in', array_to_string(states,'/'), true, 'Geographic scope' from nk where len(states) > 0
 union all select n, 9, 'business_type', 'in', array_to_string(business_types,'/'), false, left(el, 200) from nk where len(business_types) > 0"""

URL_RE = K.URL.replace("'", "''")
CHECKED_FIELDS = """array_to_string(list_filter([
 case when application_url <> '' and not regexp_matches(application_url, '{u}') then 'Invalid URL format in application_url: ' || application_url end,
 case when official_application_url <> '' and not regexp_matches(official_application_url, '{u}') then 'Invalid URL format in official_application_url: ' || official_application_url end,
 case when description = '' then 'Recommended field missing: description' end,
 case when ministry = '' then 'Recommended field missing: ministry' end,
 case when official_application_url = '' then 'Recommended field missing: official_application_url' end,
 case when status = 'discontinued' and description = '' then 'Discontinued scheme has no description' end
 ], lambda x: x is not null), '; ')""".replace("{u}", URL_RE)


def drafts(t):
    """Records with the gaps validation looks for: blank, short, bad status, unverified."""
    n = c(ORD)
    return t.f_raw.select(
        n.alias("n"),
        F.when(n % 7 == 0, "").when(n % 7 == 1, F.left(X.clean(c("name")), F.lit(3))).otherwise(X.clean(c("name"))).alias("name"),
        F.coalesce(F.lower(c("status")), F.lit("")).alias("status"),
        c("description"), c("ministry"), c("eligibility_text"), "application_url",
        F.when(n % 4 == 0, F.concat(F.lit("http://sub.example.com:80/"), n.cast("string"))).otherwise("ftp://x").alias("official_application_url"),
        F.when(n % 3 == 0, "https://localhost/x").otherwise("").alias("source_url"),
        F.when(n % 5 == 0, F.lit(None)).otherwise("https://a-b.example.org?x=1").alias("official_source_url"),
        (n % 60).cast("int").alias("data_quality_score"),
        F.when(n % 2 == 0, "VERIFIED_OFFICIAL").otherwise("STALE").alias("verification_status"),
        F.when(n % 4 == 0, F.lit("2024-01-01").cast("timestamp")).alias("verified_at"),
    )


DRAFTS = f"""with dr as (select ingest_ord n, case ingest_ord % 7 when 0 then '' when 1 then left({clean('name')}, 3) else {clean('name')} end as name,
 coalesce(lower(status), '') status, description, ministry, eligibility_text, application_url,
 case when ingest_ord % 4 = 0 then 'http://sub.example.com:80/' || ingest_ord else 'ftp://x' end official_application_url,
 case when ingest_ord % 3 = 0 then 'https://localhost/x' else '' end source_url,
 case when ingest_ord % 5 = 0 then null else 'https://a-b.example.org?x=1' end official_source_url,
 ingest_ord % 60 as data_quality_score, case when ingest_ord % 2 = 0 then 'VERIFIED_OFFICIAL' else 'STALE' end verification_status,
 case when ingest_ord % 4 = 0 then 1 end verified_at from f_raw),
ck as (select *, status <> '' and status not in ('active','suspended','closed','merged','discontinued','unknown') bad_status from dr),
er as (select *, case when bad_status then 'unknown' else status end fixed,
 list_filter([case when name = '' then 'Missing required field: name' end,
  case when name <> '' and len(name) < 5 then 'Scheme name too short: ''' || name || '''' end,
  case when data_quality_score < 20 then 'Data quality score ' || data_quality_score || ' below minimum 20' end], lambda x: x is not null) errs,
 list_filter([case when bad_status then 'Unknown status ''' || status || ''' — will be set to ''unknown''' end,
  case when application_url <> '' and not regexp_matches(application_url, '{URL_RE}') then 'Invalid URL format in application_url: ' || application_url end,
  case when official_application_url <> '' and not regexp_matches(official_application_url, '{URL_RE}') then 'Invalid URL format in official_application_url: ' || official_application_url end,
  case when source_url <> '' and not regexp_matches(source_url, '{URL_RE}') then 'Invalid URL format in source_url: ' || source_url end,
  case when official_source_url <> '' and not regexp_matches(official_source_url, '{URL_RE}') then 'Invalid URL format in official_source_url: ' || official_source_url end,
  case when coalesce(description,'') = '' then 'Recommended field missing: description' end,
  case when coalesce(ministry,'') = '' then 'Recommended field missing: ministry' end,
  case when coalesce(eligibility_text,'') = '' then 'Recommended field missing: eligibility_text' end,
  case when coalesce(official_source_url,'') = '' then 'Recommended field missing: official_source_url' end,
  case when status = 'discontinued' and description = '' then 'Discontinued scheme has no description' end,
  case when verification_status = 'VERIFIED_OFFICIAL' and verified_at is null then 'VERIFIED_OFFICIAL but no verified_at timestamp — resetting to OFFICIAL_NEEDS_REVIEW' end
  ], lambda x: x is not null) warns from ck) """


def register(r: Registry) -> None:
    def canon(name, spark_cols, sql_cols, source=normal):
        r.add(name, lambda t: source(t).select("n", *(x() if callable(x) else x for x in spark_cols)),
              CANON + f"select n, {sql_cols} from nk", USES)

    def plain(name, build, sql):
        """A column function straight over the raw fixture."""
        r.add(name, lambda t: t.f_raw.select(c(ORD).alias("n"), build().alias("value")),
              f"select ingest_ord as n, {sql} as value from f_raw", USES)

    plain("b01_clean", lambda: X.clean(c("name")), clean("name"))
    plain("b02_slug", lambda: X.slug(X.clean(c("name"))), slug(clean("name")))
    canon("b03_short_name", ["short_name"], "short_name")
    plain("b04_level_synonym", lambda: X.map_contained(c("government_level"), K.GOVERNMENT_LEVELS, "central"),
          contained("trim(lower(coalesce(government_level,'')))", K.GOVERNMENT_LEVELS, "'central'"))
    plain("b04_funding_synonym", lambda: X.map_contained(c("government_level"), K.FUNDING_TYPES, ""),
          contained("trim(lower(coalesce(government_level,'')))", K.FUNDING_TYPES, "''"))
    plain("b05_status_synonym", lambda: X.status_of(c("status")),
          exact("coalesce(lower(status), '')", K.STATUSES, "'active'"))
    plain("b06_list_split", lambda: joined(L.split_text(c("state_text"))), f"array_to_string({split('state_text')}, '|')")
    plain("b07_genders", lambda: joined(L.genders(L.split_text(c("gender_text")), c("eligibility_text"))),
          f"array_to_string({genders('gender_text', 'eligibility_text')}, '|')")
    plain("b08_social_categories", lambda: joined(L.social_categories(L.split_text(c("caste_text")), c("eligibility_text"))),
          f"array_to_string({found('caste_text', 'eligibility_text', K.SOCIAL_CATEGORIES)}, '|')")
    plain("b09_business_types", lambda: joined(L.business_types(L.split_text(c("sector_text")), c("description"))),
          f"array_to_string({found('sector_text', 'description', K.BUSINESS_TYPES)}, '|')")
    r.add("b10_any_word", lambda t: t.documents.select("doc_id", X.has_any(c("text"), ["women", "the ", "que"]).alias("hit")),
          f"select doc_id, {any_word('text', ['women', 'the ', 'que'])} as hit from documents")
    plain("b11_bool", lambda: N.parse_bool(c("collateral_requirement")).cast("string"),
          "cast(case when collateral_requirement is not null then lower(collateral_requirement) in ('true','yes','1','required') end as varchar)")
    plain("b12_float", lambda: N.parse_float(c("subsidy_percentage")), "try_cast(subsidy_percentage as double)")
    plain("b13_amount", lambda: N.parse_amount(c("loan_amount_max")), amount("loan_amount_max", K.AMOUNT))
    plain("b14_age_min", lambda: N.age_min(c("eligibility_text")).cast("double"), number("eligibility_text", K.AGE_MIN))
    plain("b15_age_max", lambda: N.age_max(c("eligibility_text")).cast("double"), number("eligibility_text", K.AGE_MAX))
    plain("b16_income_limit", lambda: N.income_limit(c("eligibility_text")), amount("eligibility_text", K.INCOME, False))
    plain("b17_rural_urban", lambda: X.rural_urban(c("eligibility_text")), RURAL.format(x="eligibility_text"))
    canon("b18_quality_score", [lambda: big("data_quality_score").alias("score")], "data_quality_score as score")

    def respelled(t):
        """The same records, half of them under the sources' other field names."""
        b, odd = raw(t), c(ORD) % 2 == 1
        moved = {"title": "name", "schemeId": "scheme_code", "schemeDescription": "description",
                 "nodal_ministry": "ministry", "max_funding_amount": "loan_amount_max", "applyLink": "application_url"}
        b = b.withColumns({alt: F.when(odd, c(own)) for alt, own in moved.items()})
        b = b.withColumns({own: F.when(~odd, c(own)).otherwise("") for own in moved.values()})
        ord_ = F.struct(F.lit(0).alias("source"), F.lit("").alias("url"), F.lit("").alias("fetch"), c(ORD).cast("int").alias("record"))
        return NZ.normalize(b.withColumn("ingest_ord", ord_)).withColumn("n", c("ingest_ord.record").cast("bigint"))

    fields = ["name", "scheme_code", "description", "ministry", "loan_amount_max", "application_url"]
    canon("b19_field_aliases", fields, ", ".join(fields), source=respelled)
    flags = list(K.FLAG_WORDS) + ["disability_eligibility"]
    canon("b20_requirement_flags", flags, ", ".join(flags))
    canon("b21_financial_benefit", ["financial_benefit"], "financial_benefit")
    canon("b22_initial_verification", ["verification_status"], "verification_status")
    r.add("b23_rules", lambda t: normal(t).select("n", F.posexplode("eligibility_rules").alias("p", "r")).select(
        "n", "r.rule_type", c("r.operator").alias("op"),
        F.coalesce("r.value", F.array_join("r.value_list", "/")).alias("val"),
        c("r.required").alias("req"), c("r.source_text").alias("src")),
        CANON + f"select n, rule_type, op, val, req, src from ({RULES_SQL})", USES)
    r.add("b24_benefits", lambda t: normal(t).select("n", F.explode("benefits_structured").alias("b")).select(
        "n", "b.benefit_type", F.coalesce("b.amount", "b.percentage").alias("figure"), "b.description"),
        CANON + """select n, 'loan' benefit_type, loan_amount_max figure, 'Loan up to ₹' || format('{:,}', cast(loan_amount_max as bigint)) description from nk where loan_amount_max <> 0
        union all select n, 'subsidy', subsidy_percentage, 'Capital subsidy up to ' || cast(subsidy_percentage as varchar) || '%' from nk where subsidy_percentage <> 0""", USES)
    r.add("b25_documents", lambda t: normal(t).select("n", F.posexplode("documents").alias("p", "d")).select(
        "n", big("p").alias("position"), "d.document_name", "d.mandatory", "d.conditional", F.coalesce("d.condition", F.lit("")).alias("condition")),
        CANON + """, docs as (select n, unnest(list_filter([
        {'d': 'Aadhaar Card / Government Photo ID', 'm': true, 'c': false, 'w': ''}, {'d': 'Passport-size Photographs', 'm': true, 'c': false, 'w': ''},
        {'d': 'Bank Account Details (Passbook / Cancelled Cheque)', 'm': true, 'c': false, 'w': ''}, {'d': 'Project Report / Business Plan', 'm': true, 'c': false, 'w': ''},
        case when list_has_any(social_categories, ['SC','ST','OBC']) then {'d': 'Caste / Community Certificate (' || array_to_string(social_categories,'/') || ')', 'm': true, 'c': false, 'w': 'Required for SC/ST/OBC applicants'} end,
        case when disability_eligibility then {'d': 'Disability Certificate (UDID / Medical Board)', 'm': false, 'c': true, 'w': 'Required for PwD/Divyang applicants'} end,
        case when udyam_required then {'d': 'Udyam Registration Certificate', 'm': true, 'c': false, 'w': 'Obtain free at udyamregistration.gov.in'} end,
        case when startup_requirements then {'d': 'Startup Registration / DPIIT Recognition', 'm': false, 'c': true, 'w': ''} end,
        case when farmer_requirements then {'d': 'Land Records / Khasra-Khatauni', 'm': true, 'c': false, 'w': ''} end,
        case when income_limit <> 0 then {'d': 'Income Certificate (from competent authority)', 'm': true, 'c': false, 'w': ''} end], lambda x: x is not null)) x,
        generate_subscripts(list_filter([1,2,3,4, case when list_has_any(social_categories, ['SC','ST','OBC']) then 5 end, case when disability_eligibility then 6 end,
        case when udyam_required then 7 end, case when startup_requirements then 8 end, case when farmer_requirements then 9 end, case when income_limit <> 0 then 10 end], lambda x: x is not null), 1) - 1 p from nk)
        select n, cast(p as bigint) position, x.d document_name, x.m mandatory, x.c conditional, x.w condition from docs""", USES)
    lists = ["states", "gender_eligibility", "social_categories", "business_types"]
    scalars = ["name", "short_name", "slug", "scheme_code", "status", "description", "ministry", "government_level",
               "rural_urban_scope", "disability_eligibility", "loan_amount_max", "subsidy_percentage", "income_limit",
               "udyam_required", "artisan_requirements", "eligibility_text", "official_application_url",
               "source_name", "source_url", "source_type", "verification_status", "financial_benefit"]
    r.add("b26_normalize", lambda t: normal(t).select(
        "n", *scalars, *[joined(c(x)).alias(x) for x in lists], c("age_min").cast("double").alias("age_min"),
        c("age_max").cast("double").alias("age_max"), big("data_quality_score").alias("data_quality_score")),
        CANON + f"select n, {', '.join(scalars)}, " + ", ".join(f"array_to_string({x}, '|') {x}" for x in lists)
        + ", age_min, age_max, data_quality_score from nk", USES)
    r.add("b27_category_filter", lambda t: NZ.in_category(normal(t), "MEDIUM").select("n"),
          CANON + "select n from nk where contains(lower(concat_ws(' ', name, ministry, left(description, 200), "
          "array_to_string(business_types,' '), array_to_string(social_categories,' '))), 'medium')", USES)
    r.add("b28_unique_slug", lambda t: normal(t).select(
        "n", X.unique_slug(c("slug"), F.left(F.sha2(c("name"), 256), F.lit(8))).alias("slug")),
        CANON + "select n, left(slug, 180) || '-' || left(sha256(name), 8) as slug from nk", USES)

    def snapshots(t):
        df = normal(t)
        snap = NZ.snapshot(df.drop("n"))
        return df.select("n", F.get_json_object(snap, "$.name").alias("name"),
                         F.get_json_object(snap, "$.data_quality_score").cast("bigint").alias("score"),
                         F.get_json_object(snap, "$.states").alias("states"),
                         F.get_json_object(snap, "$._source_id").isNull().alias("source_id_left_out"))

    r.add("b29_snapshot", snapshots,
          CANON + """select n, name, data_quality_score as score, '[' || array_to_string(list_transform(states, lambda x: '"' || x || '"'), ',') || ']' as states,
          true as source_id_left_out from nk""", USES)

    # ---- validation
    def check(name, cols, sql, **args):
        r.add(name, lambda t: V.validate(drafts(t), **args).select("n", *[x() if callable(x) else x for x in cols]),
              DRAFTS + f"select n, {sql} from er", USES)

    def only(prefix: str, kind: str = "errors"):
        return lambda: joined(F.filter(kind, lambda e: e.rlike(prefix)), "; ").alias("found")

    def sql_only(prefix: str, kind: str = "errs") -> str:
        return f"array_to_string(list_filter({kind}, lambda x: regexp_matches(x, '{prefix}')), '; ') as found"

    check("c01_name_errors", [only("name")], sql_only("name"))
    check("c02_status_repair", ["status", only("Unknown status", "warnings")], "fixed as status, " + sql_only("Unknown status", "warns"))
    check("c03_url_format", [only("Invalid URL", "warnings")], sql_only("Invalid URL", "warns"))
    check("c04_quality_error", [only("quality score")], sql_only("quality score"))
    check("c05_recommended_fields", [only("Recommended", "warnings")], sql_only("Recommended", "warns"))
    check("c06_discontinued", [only("Discontinued", "warnings")], sql_only("Discontinued", "warns"))
    check("c07_unverified_reset", ["verification_status", only("VERIFIED", "warnings")],
          "case when verification_status = 'VERIFIED_OFFICIAL' and verified_at is null then 'OFFICIAL_NEEDS_REVIEW' "
          "else verification_status end as verification_status, " + sql_only("VERIFIED", "warns"))
    check("c08_validate", ["valid", "status", lambda: joined(c("errors"), "; ").alias("errors"),
                           lambda: joined(c("warnings"), "; ").alias("warnings")],
          "len(errs) = 0 as valid, fixed as status, array_to_string(errs, '; ') as errors, array_to_string(warns, '; ') as warnings")

    def halves(t):
        good, bad = V.split(V.validate(drafts(t)))
        return good.select("n", F.lit("valid").alias("side"), F.lit("").alias("why")).unionByName(
            bad.select("n", F.lit("invalid").alias("side"), joined(c("validation_errors"), "; ").alias("why")))

    r.add("c09_split", halves, DRAFTS + "select n, case when len(errs) = 0 then 'valid' else 'invalid' end side, "
          "array_to_string(errs, '; ') why from er", USES)
    r.add("c09_canonical_batch", lambda t: V.validate(normal(t)).select(
        "n", "valid", joined(c("warnings"), "; ").alias("warnings")),
        CANON + f"select n, data_quality_score >= 20 as valid, {CHECKED_FIELDS} as warnings from nk", USES)

    def live(t):
        urls = t.pages.select("url", "page_id").unionByName(
            t.pages.select(F.concat("url", F.lit("/gone")).alias("url"), "page_id"))
        return V.liveness(urls, t.f_fetches).select("page_id", "url", big("http_status").alias("http_status"), "live")

    r.add("c10_liveness", live, """with u as (select url, page_id from pages union all select url || '/gone', page_id from pages)
        select u.page_id, u.url, cast(coalesce(f.status, 0) as bigint) http_status, coalesce(f.status between 200 and 399, false) live
        from u left join f_fetches f on f.url = u.url""", "f_fetches")
