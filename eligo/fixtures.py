"""Catalog, profile and payload tables derived from the given parquet tables.

Each is one SQL text that Spark and DuckDB both run; ``@SPLIT`` and ``@SHA``
are spelled per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from eligo.session import ROWS_PER_TASK, spread

FIXTURES = {
    "f_profiles": """
select c_custkey as profile_id, c_name as full_name,
 case c_custkey % 4 when 0 then 'Female' when 1 then 'Female' when 2 then 'Male' else null end as gender,
 case c_custkey % 5 when 0 then 'SC' when 1 then 'OBC' when 2 then 'General' when 3 then 'Minority' else 'ST' end as social_category,
 c_custkey % 11 = 0 as is_differently_abled,
 case when c_custkey % 13 = 0 then null else case c_mktsegment when 'AUTOMOBILE' then 'Trading' when 'BUILDING' then 'Manufacturing' when 'FURNITURE' then 'Artisan' when 'HOUSEHOLD' then 'Service' else 'Agriculture' end end as business_type,
 cast(c_acctbal as decimal(15,2)) as annual_turnover,
 case when c_custkey % 17 = 0 then null else concat('State', cast(c_nationkey as varchar(10))) end as state,
 c_custkey % 3 = 0 as is_udyam_registered,
 cast(18 + c_custkey % 50 as int) as age,
 case when c_custkey % 7 = 0 then null else cast(c_acctbal * 100 as double) end as annual_income
 from customer""",
    "f_schemes": """
select cast(p_partkey as varchar(20)) as id, concat(p_name,' ',p_brand,' Scheme') as name,
 case when p_partkey % 4 = 0 then concat('C-', cast(p_partkey % 500 as varchar(10))) else '' end as scheme_code,
 case when p_partkey % 19 = 0 then null else concat('Ministry of ', p_type) end as ministry,
 case when p_partkey % 38 = 0 then '' else concat('Department ', cast(p_size as varchar(5))) end as department,
 case p_partkey % 10 when 9 then 'discontinued' when 8 then 'suspended' else 'active' end as status,
 case p_partkey % 5 when 0 then null when 1 then 'VERIFIED_OFFICIAL' when 2 then 'OFFICIAL_NEEDS_REVIEW' else 'SECONDARY_NEEDS_VERIFICATION' end as verification_status,
 case p_partkey % 3 when 0 then 'central' when 1 then 'state' else null end as government_level,
 case when p_partkey % 6 = 0 then '' when p_partkey % 6 = 1 then null else concat('Support for ', p_name, ' makers, size ', cast(p_size as varchar(5))) end as description,
 concat('Open to all ', p_type, ' units') as eligibility_text,
 case when p_partkey % 3 = 0 then null else concat('https://example.org/apply/', cast(p_partkey as varchar(20))) end as application_url,
 concat('https://example.org/official/', cast(p_partkey as varchar(20))) as official_application_url,
 @SPLIT(case when p_partkey % 3 = 0 or p_partkey % 7 = 0 then '' else concat('State', cast(p_partkey % 25 as varchar(10)), ',State', cast((p_partkey + 1 + p_size) % 25 as varchar(10))) end) as states,
 @SPLIT(case p_size % 6 when 0 then '' when 1 then 'SC,ST' when 2 then 'OBC' when 3 then 'SC,ST,OBC,Minority' when 4 then 'General' else 'Minority' end) as social_categories,
 @SPLIT(case p_partkey % 5 when 0 then '' when 1 then 'Any' when 2 then 'Female' when 3 then 'Male' else 'Female,Transgender' end) as gender_eligibility,
 @SPLIT(case p_partkey % 4 when 0 then 'Entrepreneur' when 1 then 'PwD' when 2 then 'Women' else '' end) as beneficiary_types,
 (p_partkey % 4 = 1 and p_size % 2 = 0) or p_partkey % 9 = 0 as disability_eligibility,
 @SPLIT(case p_type when 'SMALL' then '' when 'MEDIUM' then 'Manufacturing,Service' when 'LARGE' then 'Trading' when 'ECONOMY' then 'Artisan' when 'PROMO' then 'Service,Agriculture' else 'Manufacturing' end) as business_types,
 p_size % 2 = 0 as udyam_required,
 case when p_partkey % 4 = 3 then null else cast(18 + p_size % 10 as int) end as age_min,
 case when p_partkey % 4 = 2 then null else cast(40 + p_size % 25 as int) end as age_max,
 case when p_partkey % 5 = 4 then cast(p_size * 10000 as double) else null end as income_limit,
 cast(case when p_partkey % 6 = 0 then 0 else p_size * 100000 end as decimal(15,2)) as loan_amount_max,
 cast(case when p_partkey % 5 = 0 then 0 else p_size % 36 end as decimal(5,2)) as subsidy_percentage,
 cast(case when p_partkey % 6 = 0 then p_size * 1000 else null end as decimal(15,2)) as grant_amount,
 cast(20 + (p_partkey * 37) % 80 as int) as data_quality_score,
 @SHA(concat(p_name, p_brand, cast(p_size as varchar(5)))) as content_hash,
 timestamp '2024-01-01 00:00:00' + p_partkey * interval '1' minute as created_at from part""",
    "f_raw": """
select p_partkey as ingest_ord, concat('  ',p_name,'   ',p_brand, case when p_size % 3 = 0 then ' Yojana (PMX)' else ' Scheme' end) as name,
 case when p_partkey % 4 = 0 then concat('C-', cast(p_partkey % 500 as varchar(10))) else '' end as scheme_code,
 case p_partkey % 5 when 0 then 'Open' when 1 then 'Closed' when 2 then 'paused' when 3 then null else 'bogus' end as status,
 case p_partkey % 4 when 0 then 'Central Sector' when 1 then 'State Plan' when 2 then 'Union Territory' else '' end as government_level,
 concat('Age ', cast(18 + p_size % 10 as varchar(5)), ' years and above, below ', cast(40 + p_size % 20 as varchar(5)), ' years. Annual family income up to Rs ', cast(p_size as varchar(5)), case p_size % 3 when 0 then ' lakh' when 1 then ' crore' else '' end, '. For ', case p_partkey % 3 when 0 then 'women' when 1 then 'male' else 'all' end, ' ', case p_partkey % 4 when 0 then 'scheduled tribe' when 1 then 'OBC' when 2 then 'minority' else '' end, ' applicants in ', case p_size % 4 when 0 then 'rural' when 1 then 'urban' when 2 then 'rural and urban' else 'all' end, ' areas', case when p_size % 2 = 0 then '; Udyam needed' else '' end, '.') as eligibility_text,
 concat('Rs. ', cast(p_size as varchar(5)), case p_size % 4 when 0 then ' lakh' when 1 then ' crore' when 2 then ' thousand' else '' end) as loan_amount_max,
 case p_partkey % 3 when 0 then 'https://example.org/a' when 1 then 'not a url' else '' end as application_url,
 case when p_partkey % 2 = 0 then 'api' else 'html' end as source_type,
 case p_partkey % 3 when 0 then concat('Ministry of ', p_type) else '' end as ministry,
 case p_partkey % 4 when 0 then '' when 1 then concat('Help for ', p_name, ' craft and retail shops') else concat('Support of trading and services around ', p_name, ' in villages and small towns') end as description,
 case p_partkey % 3 when 0 then 'apisetu_myscheme' when 1 then 'kvic' else 'data_gov_in' end as source_id,
 case p_partkey % 6 when 0 then 'State1, State2;State3' when 1 then 'State4/State5' else '' end as state_text,
 case p_partkey % 5 when 0 then '15' when 1 then '7.5' when 2 then 'up to 10%' when 3 then '0' else null end as subsidy_percentage,
 case p_partkey % 4 when 0 then 'Yes' when 1 then 'no' when 2 then null else 'required' end as collateral_requirement,
 case p_partkey % 3 when 0 then 'women, Other;trans' when 1 then '' else 'Men/ladies' end as gender_text,
 case p_partkey % 3 when 0 then 'SC, general' when 1 then '' else 'Other Backward Class;x' end as caste_text,
 case p_partkey % 4 when 0 then 'farming, retail' when 1 then 'Craft/none' else '' end as sector_text
 from part""",
    "f_fetches": """
select page_id, url,
 case page_id % 10 when 0 then 'apisetu_myscheme' when 1 then 'myscheme_web' when 2 then 'india_gov_schemes' when 3 then 'data_gov_in' when 4 then 'national_services_portal' when 5 then 'msme_ministry' when 6 then 'mudra_portal' when 7 then 'standupmitra' when 8 then 'kvic' else 'retired_portal' end as source_id,
 cast(case page_id % 7 when 0 then 404 when 1 then 503 when 2 then 304 else 200 end as int) as status,
 case when page_id % 29 = 3 then 'Timeout' else null end as error,
 html as content from pages""",
    # API payloads: list envelopes of every kind, bare lists, malformed text
    "f_json": """
select p_partkey as page_id, concat('https://api.example.org/p/', cast(p_partkey as varchar(20))) as url, source_id,
 cast(200 as int) as status, cast(null as varchar(10)) as error,
 case when source_id = 'apisetu_myscheme' then
   case p_partkey % 7 when 0 then concat('[', r1, ',', r2, ']') when 1 then concat('{"schemes":[', r1, ']}')
    when 2 then concat('{"schemes":[],"data":[', r1, ',5,', r2, ']}') when 3 then concat('{"results":[', r2, ']}')
    when 4 then concat('{"schemes":null,"items":[', r1, ',"x"]}') when 5 then '{"schemes":[' else concat('{"schemes":"none","data":[', r1, ']}') end
  when source_id = 'data_gov_in' then
   case p_partkey % 4 when 0 then concat('{"records":[', o1, ']}') when 1 then concat('{"records":[],"data":[', o1, ',', o2, ']}')
    when 2 then concat('[', o1, ']') else 'no json' end
  else case p_partkey % 4 when 0 then concat('[', g1, ',7,', g1, ']') when 1 then g1 when 2 then '12' else '{"title":' end
 end as content
from (select p_partkey,
 case p_partkey % 3 when 0 then 'apisetu_myscheme' when 1 then 'data_gov_in' else 'partner_feed' end as source_id,
 concat('{"schemeName":"', p_name, ' ', p_brand, '","schemeId":"S', cast(p_partkey as varchar(20)), '","level":"', case p_partkey % 4 when 0 then 'Union' when 1 then 'State plan' when 2 then 'UT' else '' end,
  '","minAge":', cast(18 + p_size % 10 as varchar(5)), ',"annualIncome":', cast(p_size * 10000 as varchar(20)), ',"caste":["SC",null," ', p_type, ' "],"gender":"Female; Any","state":"State1, State2","disability":0,"pwd":',
  case when p_size % 2 = 0 then '"no"' else 'false' end, ',"status":"Paused","ministry":"","nodal_ministry":"Ministry of ', p_type, '","applicationUrl":"https://apply.example.org/', cast(p_partkey as varchar(20)), '"}') as r1,
 concat('{"name":"", "title":"', p_name, ' second","id":', cast(p_partkey as varchar(20)), ',"description":"About ', p_name, '","targetBeneficiary":["Women","PwD"],"status":"expired","udyamRequired":true,"officialUrl":"https://gov.example.org/"}') as r2,
 concat('{"SchemeName":"', p_name, ' open","Ministry":"Ministry of ', p_type, '","description":"", "Description":"Data on ', p_name, '","Benefits":"Credit"}') as o1,
 concat('{"scheme_name":"', p_brand, ' data","eligibility":"Age 21 years and above"}') as o2,
 concat('{"title":"', p_name, ' feed","loan_amount_max":', cast(p_size * 100000 as varchar(20)), '.0,"udyam_required":', case when p_size % 2 = 0 then 'true' else 'false' end, ',"state":["Goa"," Kerala "],"benefits":"Credit line","gender":"women/men"}') as g1
 from part) x""",
    # pages laid out as card and link listings
    "f_cards": """
select page_id, url, 'myscheme_web' as source_id, cast(200 as int) as status, cast(null as varchar(10)) as error,
 replace(replace(replace(html, '<article>', '<article data-scheme="1">'), '<h1>', '<h2>'), '</h1>', '</h2>') as content from pages""",
    "f_lists": """
select page_id, url, 'india_gov_schemes' as source_id, cast(200 as int) as status, cast(null as varchar(10)) as error,
 replace(html, '<nav><ul>', '<nav><ul class="menu scheme-list">') as content from pages""",
    "f_entries": """
select page_id, case page_id % 10 when 0 then 'apisetu_myscheme' when 1 then 'myscheme_web' when 2 then 'india_gov_schemes' when 3 then 'data_gov_in' when 4 then 'national_services_portal' when 5 then 'msme_ministry' when 6 then 'mudra_portal' when 7 then 'standupmitra' when 8 then 'kvic' else 'retired_portal' end as source_id,
 @SPLIT(case when page_id % 10 in (4, 8) then '' else concat(url, ',', url, '/more') end) as urls from pages""",
    # a second batch: half as it was, a fifth changed, and new records
    "f_batch2": """
select * from (select ingest_ord, name, scheme_code, status, government_level, eligibility_text, loan_amount_max, application_url, source_type, ministry,
 case when ingest_ord % 5 = 0 then concat(description, ' (revised)') else description end as description, source_id, state_text, subsidy_percentage,
 collateral_requirement, gender_text, caste_text, sector_text from f_raw where ingest_ord % 2 = 0 or ingest_ord % 5 = 0) u
 union all select * from (select ingest_ord + 100000000, concat(name, ' Next'), '' as scheme_code, status, government_level, eligibility_text, loan_amount_max, application_url, source_type, ministry,
 description, source_id, state_text, subsidy_percentage, collateral_requirement, gender_text, caste_text, sector_text from f_raw where ingest_ord % 3 = 1) v""",
    "f_known": """
select url, case when page_id % 6 = 0 then 'stale' else @SHA(html) end as content_hash from pages where page_id % 2 = 0""",
    "f_links": """
select distinct o_custkey as profile_id, cast(l_partkey as varchar(20)) as scheme_id
 from orders join lineitem on l_orderkey = o_orderkey""",
}

_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
_SPARK = {"SPLIT": r"filter(split(\1, ','), x -> x <> '')", "SHA": r"sha2(\1, 256)"}
_DUCK = {"SPLIT": r"list_filter(string_split(\1, ','), lambda x: x <> '')", "SHA": r"sha256(\1)"}


def _spell(sql: str, how: dict[str, str]) -> str:
    """Replaces each macro call, its argument running to the matching bracket."""
    while m := re.search(r"@(SPLIT|SHA)\(", sql):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[m.end():end - 1]
        sql = sql[:m.start()] + how[m.group(1)].replace(r"\1", inner) + sql[end:]
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _spell(FIXTURES[name], _SPARK)
    used = {t: table(spark, sf_dir, t) for t in _TABLES if re.search(rf"\b(?:from|join) {t}\b", sql)}
    # records and payloads are made of a part's few bytes; a page of some kilobytes is parsed
    for t, key, rows in (("part", "p_partkey", ROWS_PER_TASK), ("pages", "page_id", ROWS_PER_TASK // 10)):
        if t in used:
            used[t] = spread(used[t], key, rows)
    used |= {f: fixture(spark, sf_dir, f) for f in FIXTURES if re.search(rf"\bfrom {f}\b", sql)}
    sql = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(rf"\b(from|join) ({'|'.join(used)})\b", r"\1 {\2}", sql), **used)


def duck(name: str) -> str:
    """The fixture as the body of a DuckDB common table expression."""
    return f"{name} as ({_spell(FIXTURES[name], _DUCK)})"


def with_duck(sql: str, *names: str) -> str:
    """``sql`` with the named fixtures in front; ``sql`` may open with more CTEs."""
    ctes = ", ".join(duck(n) for n in names)
    if sql.lstrip().lower().startswith("with "):
        return f"with {ctes}, {sql.lstrip()[5:]}"
    return f"with {ctes} {sql}"
