"""Source, scan and parser queries (A, J01)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from eligo import constants as K
from eligo import schemas as S
from eligo.functions import lists as L
from eligo.functions import text as X
from eligo.operators import conform
from eligo.operators import upsert as U
from eligo.plans.ingest import Store
from eligo.registry import normalize as RN
from eligo.registry.catalog import BENEFITS_SQL, DOCUMENTS_SQL, RULES_SQL, seeds, with_children
from eligo.registry.common import Registry, big, c, contained, exact, joined, values_list
from eligo.session import new_table_path, spread
from eligo.sources import dispatch, fetches, html_records, json_records, registry, seed, table_parser

SOURCES_SQL = ("src(source_id, name, type, authority_level, terms_status, enabled, priority, ordinal) as "
               + values_list([(*row[:7], i) for i, row in enumerate(K.SOURCE_ROWS)]))


def binary(df):
    """Payloads as landed: content in bytes."""
    return df.withColumns({"content": F.encode(c("content"), "UTF-8"), "content_type": F.lit(None).cast("string")})


def all_payloads(t, unread=False):
    """API, card, link and page payloads together, one row per fetch; with ``unread`` also the pages of the two
    sources that have cards and links of their own."""
    cols = ["url", "source_id", "status", "content", "content_type", "error"]
    parts = [binary(x).select(*cols) for x in (
        t.f_json, t.f_cards, t.f_lists,
        t.f_fetches if unread else t.f_fetches.where(~c("source_id").isin("myscheme_web", "india_gov_schemes")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PLAIN = "replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def pieces(x: str, sep: str) -> str:
    """Text between tags in SQL: tags cut out, pieces trimmed, blanks dropped, joined."""
    cut = f"string_split(regexp_replace({PLAIN.format(x=f'coalesce({x}, {chr(39)*2})')}, '<[!/?A-Za-z][^>]*>', chr(1), 'g'), chr(1))"
    return f"array_to_string(list_filter(list_transform({cut}, lambda v: trim(v)), lambda v: v <> ''), '{sep}')"


ARTICLE = "regexp_extract(content, '(?s)<article[^>]*>(.*)</article>', 1)"
PAGES_SQL = f"""select url as source_url, {pieces("regexp_extract(content, '(?s)<h1>(.*?)</h1>', 1)", '')} as name,
 left({pieces(ARTICLE, ' ')}, 2000) as description from f_fetches
 where {pieces("regexp_extract(content, '(?s)<h1>(.*?)</h1>', 1)", '')} <> ''"""
API = "from part where p_partkey % 3 = 0 and p_partkey % 7 in "
# what f_json's envelopes unwrap to, written from the table they were made of
API_SQL = f"""with api as (
 select p_partkey k, case when p_partkey % 7 in (0, 1, 2, 4) then 0 end i, p_name || ' ' || p_brand as name, 'S' || p_partkey as code, '' as description,
  'Ministry of ' || p_type as ministry, case p_partkey % 4 when 0 then 'central' when 1 then 'state' when 2 then 'union_territory' else 'central' end as lvl,
  'State1|State2' as states, '' as beneficiaries, 'Female|Any' as genders, 'SC|' || p_type as castes, cast(18 + p_size % 10 as varchar) as age_min,
  cast(p_size * 10000 as double) as income, p_size % 2 = 0 as disabled, 'https://apply.example.org/' || p_partkey as apply, 'suspended' as status, false as udyam
 {API} (0, 1, 2, 4)
 union all select p_partkey, case p_partkey % 7 when 0 then 1 when 2 then 2 else 0 end, p_name || ' second', nullif(cast(p_partkey as varchar), '0'), 'About ' || p_name, '',
  'central', '', 'Women|PwD', '', '', null, null, false, 'https://gov.example.org/', 'discontinued', true {API} (0, 2, 3))
"""


def _api_rows(t):
    raw = json_records.portal_api(binary(t.f_json.where("source_id = 'apisetu_myscheme'")))
    return raw.select(
        F.substring_index("_source_url", "/", -1).cast("bigint").alias("k"),
        big("ingest_ord.record").alias("i"), "name", "scheme_code",
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("ministry", F.lit("")).alias("ministry"),
        "government_level", joined(c("states")).alias("states"), joined(c("beneficiary_types")).alias("beneficiaries"),
        joined(c("gender_eligibility")).alias("genders"),
        joined(L.trim_items(c("social_categories"))).alias("castes"), "age_min",
        c("income_limit").cast("double").alias("income"), "disability_eligibility",
        "official_application_url", "status", "udyam_required", "source_type")


def register(r: Registry) -> None:
    def scanned(t):
        """Seed records written as JSON and scanned back."""
        path = new_table_path(t.spark, "seed")
        seeds(t).write.json(path)
        return seed.read_seed(t.spark, path, array_file=False).select(
            "id", "name", c("age_min").cast("double").alias("age_min"), "loan_amount_max", "udyam_required",
            joined(c("eligible_business_types")).alias("business_types"))

    r.add("a01_seed_scan", scanned,
          "select id, name, cast(age_min as double) age_min, cast(loan_amount_max as double) loan_amount_max, udyam_required, "
          "array_to_string(business_types, '|') business_types from f_schemes", "f_schemes")
    r.add("a02_seed_canonical", lambda t: seed.to_canonical(seeds(t)).select(
        "id", "government_level", "description", joined(c("business_types")).alias("business_types"),
        "startup_requirements", "source_type", "verification_status", big("data_quality_score").alias("quality"),
        "financial_benefit", big(F.size("eligibility_rules")).alias("n_rules")),
        """select id, coalesce(government_level, 'central') government_level, coalesce(description, '') description,
        array_to_string(business_types, '|') business_types, false startup_requirements, 'official_portal' source_type,
        'OFFICIAL_NEEDS_REVIEW' verification_status, cast(70 as bigint) quality,
        coalesce(loan_amount_max, 0) <> 0 or coalesce(subsidy_percentage, 0) <> 0 financial_benefit, cast(0 as bigint) n_rules from f_schemes""", "f_schemes")
    r.add("a03_seed_response", lambda t: seed.to_response(seeds(t)).select(
        "id", "title", "ministry_or_org", joined(c("target_demographics")).alias("target_demographics"),
        c("max_funding_amount").cast("double").alias("max_funding_amount"),
        c("subsidy_percentage").cast("double").alias("subsidy_percentage"), big("min_age").alias("min_age"),
        "requires_udyam", "government_level", "funding_type", "status"),
        """select id, name as title, coalesce(nullif(ministry, ''), 'Government of India') ministry_or_org,
        array_to_string(list_concat(social_categories, list_filter(gender_eligibility, lambda x: x <> 'Any')), '|') target_demographics,
        cast(nullif(loan_amount_max, 0) as double) max_funding_amount, cast(nullif(subsidy_percentage, 0) as double) subsidy_percentage,
        cast(coalesce(age_min, 18) as bigint) min_age, udyam_required requires_udyam, coalesce(government_level, 'central') government_level,
        'central_sector' funding_type, 'active' status from f_schemes""", "f_schemes")

    def landed(t):
        path = new_table_path(t.spark, "landed")
        fetches.land(binary(t.f_fetches).drop("page_id"), path)
        back = fetches.read_fetches(t.spark, path)
        return back.select("url", "source_id", big("status").alias("status"), "error",
                           big(F.octet_length("content")).alias("size"))

    r.add("a04_payload_scan", landed,
          "select url, source_id, cast(status as bigint) status, error, cast(octet_length(encode(content)) as bigint) size from f_fetches", "f_fetches")
    ok = "(status between 200 and 299 and error is null)"
    r.add("a05_fetch_outcome", lambda t: fetches.classify(t.f_fetches).select(
        "url", "outcome", F.when(c("outcome") == "failed", fetches.failure_message()).otherwise("").alias("message")),
        f"""select url, case when {ok} then 'ok' else 'failed' end outcome, case when {ok} then '' else 'Fetch failed ' || url || ': HTTP ' || status || ' — ' ||
        coalesce(error, case when status >= 400 then 'HTTP ' || status end, 'None') end message from f_fetches""", "f_fetches")
    r.add("a06_content_hash", lambda t: t.documents.select("doc_id", fetches.content_hash(c("text")).alias("hash")),
          "select doc_id, sha256(text) as hash from documents")
    r.add("a07_change_detection", lambda t: fetches.classify(t.f_fetches, t.f_known).select("url", "outcome"),
          f"""select f.url, case when not {ok} then 'failed' when sha256(content) = content_hash then 'unchanged' else 'ok' end outcome
          from f_fetches f left join f_known k using (url)""", "f_fetches f_known")
    r.add("a08_decode", lambda t: t.documents.select("doc_id", fetches.decoded(
        F.concat(F.encode(c("text"), "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit("é"), "UTF-8"))).alias("text")),
        "select doc_id, text || chr(65533) || 'é' as text from documents")
    r.add("a09_enabled_sources", lambda t: registry.enabled(registry.sources(t.spark), 3).join(
        t.f_fetches.groupBy("source_id").agg(F.count("*").alias("fetches")), "source_id").select(
        "source_id", "name", big("priority").alias("priority"), big("ordinal").alias("ordinal"), "fetches"),
        f"""with {SOURCES_SQL} select src.source_id, src.name, cast(priority as bigint) priority, cast(ordinal as bigint) ordinal, count(*) fetches
        from src join f_fetches using (source_id) where enabled and priority <= 3 group by all""", "f_fetches")
    r.add("a09_api_sources", lambda t: t.f_fetches.join(
        F.broadcast(registry.api_only(registry.sources(t.spark)).select("source_id", "authority_level")), "source_id").select("url", "source_id", "authority_level"),
        f"with {SOURCES_SQL} select url, source_id, authority_level from f_fetches join src using (source_id) where enabled and type = 'api'", "f_fetches")
    r.add("a09_unknown_sources", lambda t: registry.unknown_ids(
        t.f_fetches.select("source_id").unionByName(t.f_json.select("source_id")), registry.sources(t.spark)),
        f"with {SOURCES_SQL} select distinct source_id from (select source_id from f_fetches union all select source_id from f_json) "
        "where source_id not in (select source_id from src)", "f_fetches f_json")
    r.add("a12_entry_urls", lambda t: registry.expand(registry.enabled(registry.sources(t.spark)), t.f_entries).select(
        "source_id", big("priority").alias("priority"), big("url_index").alias("url_index"), "url"),
        f"""with {SOURCES_SQL}, e as (select source_id, priority, urls from src join f_entries using (source_id) where enabled)
        select source_id, cast(priority as bigint) priority, cast(i as bigint) url_index, urls[i + 1] as url from e, unnest(range(len(urls))) as u(i)""", "f_entries")
    r.add("a12_sources_without_urls", lambda t: registry.without_urls(registry.sources(t.spark), t.f_entries).select("source_id", "name"),
          f"with {SOURCES_SQL} select source_id, name from src where source_id not in (select source_id from f_entries where len(urls) > 0)", "f_entries")
    r.add("a13_dispatch", lambda t: dispatch.parse(
        fetches.classify(all_payloads(t, unread=True)).where("outcome = 'ok'").drop("content_hash", "outcome")).groupBy(
        F.coalesce("_source_id", F.lit("none")).alias("tag")).agg(
        F.count("*").alias("records"), F.count_if(X.filled(c("name"))).alias("named")))
    r.add("a13_unreadable", lambda t: dispatch.unreadable(binary(t.f_json)).select("url", "source_id"),
          """select url, source_id from f_json where (source_id = 'apisetu_myscheme' and page_id % 7 = 5)
          or (source_id <> 'apisetu_myscheme' and page_id % 4 = 3)""", "f_json")
    r.add("a14_unwrap", lambda t: json_records.unwrap(
        json_records.parsed(binary(t.f_json.where("source_id = 'apisetu_myscheme'"))), ["schemes", "data", "results", "items"]).select(
        c("page_id").alias("k"), big("record_index").alias("i")),
        API_SQL + "select k, cast(i as bigint) i from api")
    r.add("a15_portal_api", _api_rows, API_SQL + """select k, cast(i as bigint) i, name, code scheme_code, description, ministry, lvl government_level, states, beneficiaries, genders,
        castes, age_min, income, disabled disability_eligibility, apply official_application_url, status, udyam udyam_required, 'api' source_type from api""")
    r.add("a16_open_data_api", lambda t: json_records.open_data_api(binary(t.f_json.where("source_id = 'data_gov_in'"))).select(
        c("_source_url").alias("url"), "name", F.coalesce("ministry", F.lit("")).alias("ministry"),
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("benefits_text", F.lit("")).alias("benefits"),
        F.coalesce("eligibility_text", F.lit("")).alias("eligibility")),
        """select 'https://api.example.org/p/' || p_partkey url, p_name || ' open' as name, 'Ministry of ' || p_type ministry, 'Data on ' || p_name description, 'Credit' benefits, '' eligibility
        from part where p_partkey % 3 = 1 and p_partkey % 4 in (0, 1)
        union all select 'https://api.example.org/p/' || p_partkey, p_brand || ' data', '', '', '', 'Age 21 years and above' from part where p_partkey % 3 = 1 and p_partkey % 4 = 1""")
    r.add("a17_generic_json", lambda t: json_records.generic(binary(t.f_json.where("source_id = 'partner_feed'"))).select(
        c("_source_url").alias("url"), big("ingest_ord.record").alias("i"), "title",
        c("loan_amount_max").cast("double").alias("loan"), "udyam_required", joined(L.trim_items(c("state"))).alias("states"),
        "benefits", joined(c("gender")).alias("genders")),
        """select 'https://api.example.org/p/' || p_partkey url, cast(i as bigint) i, p_name || ' feed' title, cast(p_size * 100000 as double) loan, p_size % 2 = 0 udyam_required,
        'Goa|Kerala' states, 'Credit line' benefits, 'women|men' genders from part, unnest(case when p_partkey % 4 = 0 then [0, 2] else [0] end) as u(i)
        where p_partkey % 3 = 2 and p_partkey % 4 in (0, 1)""")
    def items_of(content: bytes, url: str):
        """A user's parser: the objects of a JSON list, or one object."""
        found = json.loads(content)
        for item in found if isinstance(found, list) else [found]:
            if isinstance(item, dict):
                yield {"title": item.get("title"), "benefits": item.get("benefits"), "states": [x.strip() for x in item.get("state", [])]}

    def table_parsed(t):
        table_parser.register(t.spark, "partner_items", items_of)
        parse = table_parser.parser("partner_items", "title string, benefits string, states array<string>", "partner_feed")
        rows = dispatch.parse(binary(t.f_json.where("source_id = 'partner_feed'")), {"partner_feed": parse})
        return rows.select(c("_source_url").alias("url"), big("ingest_ord.record").alias("i"), "title", "benefits", joined(c("states")).alias("states"))

    r.add("j01_table_parser", table_parsed,
          """select 'https://api.example.org/p/' || p_partkey url, cast(row_number() over (partition by p_partkey order by i) - 1 as bigint) i, p_name || ' feed' title,
          'Credit line' benefits, 'Goa|Kerala' states from part, unnest(case when p_partkey % 4 = 0 then [0, 2] else [0] end) as u(i)
          where p_partkey % 3 = 2 and p_partkey % 4 in (0, 1)""")
    odd = """concat('{"title":"first ', p_name, '","title":"', p_name, '","loan_amount_max":', case when p_partkey % 3 = 0 then '0' else '-250.5' end,
        ',"subsidy_percentage":NaN,"udyam_required":false,"benefits":""}')"""
    r.add("a17_odd_json", lambda t: json_records.generic(binary(spread(t.part, "p_partkey").selectExpr(
        "concat('https://odd.example.org/', p_partkey) as url", "'partner_feed' as source_id", "200 as status", "cast(null as string) as error",
        f"{odd} as content"))).select(
        c("_source_url").alias("url"), "title", "loan_amount_max", c("subsidy_percentage").isNull().alias("no_subsidy"), "udyam_required", "benefits"),
        """select 'https://odd.example.org/' || p_partkey as url, p_name as title, case when p_partkey % 3 = 0 then '0' else '-250.5' end as loan_amount_max,
        true as no_subsidy, false as udyam_required, '' as benefits from part""")
    rest = "regexp_extract(content, '(?s)</h2>(.*)</article>', 1)"
    r.add("a18_card_listing", lambda t: html_records.card_listing(binary(t.f_cards)).select(
        c("_source_url").alias("url"), "name", "description", F.coalesce("application_url", F.lit("")).alias("link")),
        # an unclosed <b> keeps the first paragraph open to the end of the card
        f"""select url, {pieces("regexp_extract(content, '(?s)<h2>(.*?)</h2>', 1)", '')} as name,
        case when starts_with({rest}, '<p><b>') then {pieces(rest, '')} else {pieces(f"regexp_extract({rest}, '(?s)^<p>(.*?)</p>', 1)", '')} end description,
        '' link from f_cards""", "f_cards")
    r.add("a19_link_listing", lambda t: html_records.link_listing(binary(t.f_lists)).select(
        c("_source_url").alias("url"), "name", c("application_url").alias("link")),
        f"""with l as (select url, unnest(regexp_extract_all(content, '<li><a href="[^"]*">[^<]*</a></li>')) a from f_lists),
        m as (select url, trim({PLAIN.format(x='''regexp_extract(a, '">([^<]*)<', 1)''')}) as name, {PLAIN.format(x='''regexp_extract(a, 'href="([^"]*)"', 1)''')} href from l)
        select url, name, case when starts_with(href, '/') then regexp_extract(url, '^[a-z]+://[^/?#]*') || href else href end link from m where len(name) >= 5""", "f_lists")
    r.add("a20_ministry_page", lambda t: html_records.ministry_page(binary(t.f_fetches)).select(
        c("_source_url").alias("source_url"), "name", "description"), PAGES_SQL, "f_fetches")
    r.add("a21_absolute_url", lambda t: t.pages.select("page_id", X.absolute_url(
        F.regexp_extract("html", 'href="([^"]*)"', 1), c("url")).alias("link")),
        """select page_id, case when starts_with(regexp_extract(html, 'href="([^"]*)"', 1), '/') then regexp_extract(url, '^[a-z]+://[^/?#]*') else '' end
        || regexp_extract(html, 'href="([^"]*)"', 1) as link from pages""")
    r.add("a21_absolute_urls", lambda t: t.pages.select("page_id", "url", F.posexplode(
        F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("position", "href")).select(
        "page_id", big("position").alias("position"), X.absolute_url(c("href"), c("url")).alias("link")),
        """select page_id, cast(i as bigint) as position, case when starts_with(h[i + 1], '/') then regexp_extract(url, '^[a-z]+://[^/?#]*') else '' end || h[i + 1] as link
        from (select page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) as h from pages), unnest(range(len(h))) as u(i)""")
    r.add("a22_api_level", lambda t: t.f_raw.select(c("ingest_ord").alias("n"), X.api_level(c("government_level")).alias("level")),
          f"select ingest_ord n, {contained('lower(government_level)', K.API_LEVELS, chr(39) + 'central' + chr(39))} as level from f_raw", "f_raw")
    r.add("a23_api_status", lambda t: t.f_raw.select(c("ingest_ord").alias("n"), X.api_status(c("status")).alias("status")),
          f"select ingest_ord n, {exact('lower(status)', K.API_STATUSES, chr(39) + 'active' + chr(39))} as status from f_raw", "f_raw")
    r.add("a24_state_list", lambda t: t.f_raw.select(c("ingest_ord").alias("n"), joined(L.split_text(c("state_text"), ",")).alias("states")),
          "select ingest_ord n, array_to_string(list_filter(list_transform(string_split(state_text, ','), lambda v: trim(v)), lambda v: v <> ''), '|') states from f_raw", "f_raw")
    r.add("a25_existing_key_scan", lambda t: t.f_schemes.select("name", "ministry", "scheme_code", "government_level"),
          "select name, ministry, scheme_code, government_level from f_schemes", "f_schemes")

    def inserted(t):
        """All tables of an insert written to a store and counted back."""
        records = with_children(t.f_schemes).withColumns({
            "source_url": F.lit(""), "official_source_url": c("official_application_url"),
            "source_type": F.when(c("udyam_required"), "api").otherwise("html"), "source_name": F.lit("feed")})
        store = Store(t.spark, new_table_path(t.spark, "store"))
        store.write(1, {
            "rules": U.rules(records), "benefits": U.benefits(records), "documents": U.documents(records),
            "locations": U.locations(records), "sources": U.provenance(records, F.current_timestamp())})
        out = None
        for name in ("rules", "benefits", "documents", "locations", "sources"):
            part = store.read(name).agg(F.count("*").alias("rows"), F.countDistinct("scheme_id").alias("schemes")).select(
                F.lit(name).alias("name"), "rows", "schemes")
            out = part if out is None else out.unionByName(part)
        return out

    def counted(name, arr):
        return f"select '{name}' as name, cast(sum(len({arr})) as bigint) as rows, count(*) filter (where len({arr}) > 0) as schemes from f_schemes"

    r.add("a27_insert_children", inserted, " union all ".join([
        counted("rules", RULES_SQL), counted("benefits", BENEFITS_SQL), counted("documents", DOCUMENTS_SQL),
        "select 'locations', cast(sum(greatest(len(states), 1)) as bigint), count(*) from f_schemes",
        "select 'sources', count(*), count(*) from f_schemes"]), "f_schemes")

    def provenance(t):
        base = RN.normal(t).withColumn("id", c("n").cast("string"))
        return U.provenance(base, F.lit("2024-01-01").cast("timestamp")).select(
            "scheme_id", "source_url", "publisher", big("http_status").alias("http_status"), "authority_level")

    r.add("a28_provenance", provenance, RN.CANON + "select cast(n as varchar) scheme_id, source_url, source_name publisher, cast(200 as bigint) http_status, "
          "case when source_type = 'api' then 'primary' else 'secondary' end authority_level from nk", "f_raw")

    def own_parser(payloads):
        """A parser a user adds: one record per payload, named after its url."""
        rows = json_records.with_ord(payloads.withColumn("record_index", F.lit(0)))
        return conform(rows.select("ingest_ord", F.lit("mine").alias("_source_id"), c("url").alias("_source_url"), c("url").alias("name")), S.RAW)

    r.add("j01_parser_registry", lambda t: dispatch.parse(
        binary(t.f_fetches), {"retired_portal": own_parser}).where("_source_id = 'mine'").select("name"),
        "select url as name from f_fetches where source_id = 'retired_portal'", "f_fetches")
