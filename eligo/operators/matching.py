"""Hard rules, soft scores and ranked matches of profiles and schemes.

The functions below are columns over a *pair*: the profile's attributes under
their own names, and the scheme as a struct ``s`` built by :func:`scheme_facts`.
All lower-casing and list tests that need only the scheme are done once per
scheme, so a pair costs a handful of comparisons.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eligo import constants as K
from eligo.functions import lists as L
from eligo.functions import text as X
from eligo.operators import catalog
from eligo.operators.skew import salted_join, salts_for
from eligo.session import cut_lineage

c = F.col

# A score depends on these profile attributes only.
SEGMENT = ["gender", "social_category", "is_differently_abled", "business_type", "state",
           "is_udyam_registered"]


def _bool(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def scheme_facts() -> list[Column]:
    """What the rules need of a scheme, over catalog columns."""
    genders, cats = L.lower_all(c("gender_eligibility")), L.lower_all(c("social_categories"))
    demos = L.lower_all(catalog.demographics())
    groups = L.lower_all(c("beneficiary_types"))
    pwd_only = (F.size(groups) > 0) & F.forall(groups, lambda b: b.contains("pwd") | b.contains("disab"))
    restricted = (F.size(L.or_empty(c("states"))) > 0) & ~_bool(c("government_level") == "central")
    soft_genders = F.when(F.size(genders) > 0, genders).otherwise(demos)
    soft_cats = F.when(F.size(cats) > 0, cats).otherwise(demos)

    def overlaps(xs: Column, words: list[str]) -> Column:
        return F.arrays_overlap(xs, F.array(*[F.lit(w) for w in words]))

    return [
        L.or_empty(c("states")).alias("states"),
        L.lower_all(c("states")).alias("states_lc"),
        restricted.alias("state_bound"),
        L.or_empty(c("gender_eligibility")).alias("genders"),
        genders.alias("genders_lc"),
        ((F.size(genders) > 0) & ~F.array_contains(genders, "any")).alias("gender_bound"),
        L.or_empty(c("social_categories")).alias("cats"),
        cats.alias("cats_lc"),
        ((F.size(cats) > 0) & ~overlaps(cats, K.OPEN_CATEGORIES)).alias("cat_bound"),
        F.forall(cats, lambda x: x.isin("sc", "st")).alias("sc_st_only"),
        _bool(c("disability_eligibility")).alias("for_disabled"),
        (_bool(c("disability_eligibility")) & pwd_only).alias("pwd_only"),
        overlaps(soft_genders, K.FEMALE_TARGETS).alias("for_women"),
        F.exists(demos, lambda d: d.contains("differently-abled")).alias("names_disabled"),
        soft_cats.alias("soft_cats"),
        overlaps(soft_cats, K.MARGINALIZED).alias("for_marginalized"),
        L.lower_all(c("business_types")).alias("types_lc"),
        _bool(c("udyam_required")).alias("needs_udyam"),
    ]


def s(name: str) -> Column:
    return c(f"s.{name}")


def _given(name: str) -> Column:
    return X.filled(c(name))


def _in(values: Column, name: str) -> Column:
    return _bool(F.array_contains(values, F.lower(c(name))))


# ---- hard rules -------------------------------------------------------------

def fails_state() -> Column:
    return s("state_bound") & _given("state") & ~_in(s("states_lc"), "state")


def fails_gender() -> Column:
    return s("gender_bound") & _given("gender") & ~_in(s("genders_lc"), "gender")


def meets_gender() -> Column:
    return s("gender_bound") & _in(s("genders_lc"), "gender")


def fails_category() -> Column:
    """Only a list of nothing but SC and ST shuts out, and then neither SC nor ST."""
    own = F.lower(c("social_category"))
    return s("cat_bound") & s("sc_st_only") & _given("social_category") & ~own.isin("sc", "st")


def meets_category() -> Column:
    return s("cat_bound") & _in(s("cats_lc"), "social_category")


def fails_disability() -> Column:
    return s("pwd_only") & ~_bool(c("is_differently_abled"))


def special_quota() -> Column:
    return _bool(c("is_differently_abled")) & (s("for_disabled") | s("names_disabled"))


def with_flags(pairs: DataFrame) -> DataFrame:
    """Every yes-or-no fact of a pair, worked out once; the rest reads these."""
    return pairs.withColumns({
        "fails_state": fails_state(),
        "fails_gender": fails_gender(),
        "meets_gender": meets_gender(),
        "fails_category": fails_category(),
        "meets_category": meets_category(),
        "fails_disability": fails_disability(),
        "is_female": _bool(F.lower(c("gender")) == "female"),
        "has_category": _given("social_category"),
        "own_category": _in(s("soft_cats"), "social_category"),
        "special_quota": special_quota(),
        "has_sector": _given("business_type"),
        "own_sector": _in(s("types_lc"), "business_type"),
        "udyam_ready": s("needs_udyam") & _bool(c("is_udyam_registered")),
    }).withColumn(
        "passed", ~(c("fails_state") | c("fails_gender") | c("fails_category") | c("fails_disability")))


FLAGS = ["fails_state", "fails_gender", "meets_gender", "fails_category", "meets_category",
         "fails_disability", "is_female", "has_category", "own_category", "special_quota",
         "has_sector", "own_sector", "udyam_ready"]


def _texts(*cases: tuple[Column, list]) -> Column:
    built = [F.when(cond, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
             for cond, parts in cases]
    return F.array_compact(F.array(*built))


def failure_reasons() -> Column:
    return _texts(
        (c("fails_state"), ["Restricted to states: ", F.array_join(s("states"), ", ")]),
        (c("fails_gender"), ["Designated for ", F.array_join(s("genders"), ", "), " entrepreneurs only"]),
        (c("fails_category"), ["Dedicated exclusively to ", F.array_join(s("cats"), ", "), " communities"]),
        (c("fails_disability"), ["Dedicated program for differently-abled persons"]),
    )


def positive_factors() -> Column:
    return _texts(
        (c("meets_gender"), ["Direct match for gender criterion (", c("gender"), ")"]),
        (c("meets_category"), ["Affirmative target community: ", c("social_category")]),
    )


# ---- soft scores ------------------------------------------------------------

def demographic_score() -> Column:
    by_gender = F.when(c("is_female") & s("for_women"), 25.0).when(c("is_female"), 10.0).otherwise(0.0)
    return by_gender + F.when(c("special_quota"), 10.0).otherwise(0.0)


def category_score() -> Column:
    return (
        F.when(~c("has_category"), 0.0).when(c("own_category"), 30.0)
        .when(s("for_marginalized"), 15.0).otherwise(10.0)
    )


def sector_score() -> Column:
    return (
        F.when(F.size(s("types_lc")) == 0, 15.0).when(c("own_sector"), 20.0)
        .when(~c("has_sector"), 10.0).otherwise(5.0)
    )


def business_score() -> Column:
    return sector_score() + F.when(c("udyam_ready"), 5.0).otherwise(0.0)


def total_score(demographic: Column, category: Column, business: Column) -> Column:
    raw = F.lit(10.0) + demographic + category + business
    return F.when(c("passed"), F.round(F.least(F.lit(99.0), F.greatest(F.lit(15.0), raw)), 1)).otherwise(0.0)


def soft_factors() -> Column:
    return _texts(
        (c("is_female") & s("for_women"), ["High priority reservation for Women-led enterprises"]),
        (c("special_quota"), ["Special quota / subsidy boost for differently-abled entrepreneurs"]),
        (c("own_category"), ["Direct affirmative allocation for ", c("social_category"), " category"]),
        (c("has_category") & ~c("own_category") & s("for_marginalized"),
         ["Inclusive allocation covering marginalized groups"]),
        (c("own_sector"), ["Sector alignment: '", c("business_type"), "' is an eligible sector"]),
        (c("udyam_ready"), ["Udyam registration verified"]),
        (s("needs_udyam") & ~c("udyam_ready"),
         ["Action required: Free Udyam registration needed for disbursement"]),
    )


def match_factors() -> Column:
    joined = F.array_distinct(F.concat(positive_factors(), soft_factors()))
    return F.when(c("passed"), joined).otherwise(L.empty())


def bucket(score: Column, ok: Column) -> Column:
    return (
        F.when(~ok, "Ineligible").when(score >= 80, "Highly Eligible")
        .when(score >= 60, "Eligible").otherwise("Partially Eligible")
    )


PARTS = ["demographic_score", "business_score", "category_score", "semantic_score"]


def with_scores(flagged: DataFrame) -> DataFrame:
    """Score parts (zero for a failed pair), total and status of flagged pairs."""
    def part(x: Column) -> Column:
        return F.when(c("passed"), x).otherwise(0.0)

    return flagged.withColumns({
        "demographic_score": part(demographic_score()),
        "business_score": part(business_score()),
        "category_score": part(category_score()),
        "semantic_score": F.lit(0.0),
    }).withColumn(
        "match_score", total_score(c("demographic_score"), c("category_score"), c("business_score"))
    ).withColumn("eligibility_status", bucket(c("match_score"), c("passed")))


def evaluate(pairs: DataFrame) -> DataFrame:
    """All rule and score columns of the pairs given."""
    scored = with_scores(with_flags(pairs)).withColumns({
        "score_breakdown": F.struct(*PARTS, c("passed").alias("hard_filter_passed")),
        "missing_requirements": failure_reasons(),
        "matching_factors": match_factors(),
    })
    return scored.drop(*FLAGS, *PARTS)


def pair_up(links: DataFrame, profiles: DataFrame, schemes: DataFrame) -> DataFrame:
    """Pairs for given (profile_id, scheme_id) links, ready to evaluate."""
    facts = schemes.select(c("id").alias("scheme_id"), F.struct(*scheme_facts()).alias("s"))
    return links.join(profiles, "profile_id").join(facts, "scheme_id")


# ---- benefits, checklist, explanation ---------------------------------------

def money_text(x: Column) -> Column:
    return F.format_number(x.cast("decimal(15,2)"), 0)


def percent_text(x: Column) -> Column:
    return x.cast("decimal(5,2)").cast("string")


def key_benefits(benefits: Column, subsidy: Column, funding: Column) -> Column:
    """Up to four lines: the structured benefits, else the money columns."""
    def line(b: Column) -> Column:
        text = F.coalesce(F.nullif(b["description"], F.lit("")),
                          F.concat(F.coalesce(F.nullif(b["benefit_type"], F.lit("")), F.lit("General")),
                                   F.lit(" support")))
        tail = (
            F.when(_bool(b["percentage"] != 0),
                   F.concat(F.lit(" up to "), percent_text(b["percentage"]), F.lit("%")))
            .when(_bool(b["amount"] != 0), F.concat(F.lit(" up to ₹"), money_text(b["amount"])))
            .otherwise("")
        )
        return F.concat(text, tail)

    general = _texts(
        (_bool(subsidy > 0), ["Government Capital Subsidy up to ", percent_text(subsidy), "%"]),
        (_bool(funding > 0), ["Financial assistance / loan limit up to ₹", money_text(funding)]),
        (F.lit(True), ["Institutional credit support & collateral-free access"]),
    )
    own = F.transform(benefits, line)
    return F.slice(F.when(_bool(F.size(own) > 0), own).otherwise(general), 1, 4)


def listed_documents(documents: Column) -> Column:
    """Stored documents and the essentials they do not cover; scheme side only."""
    own = F.coalesce(
        F.transform(documents, lambda d: F.concat(
            d["document_name"], F.when(d["mandatory"], F.lit(" (Mandatory)")).otherwise(""))),
        L.empty(),
    )
    low = F.lower(F.array_join(own, "\n"))
    missing = F.array_compact(F.array(*[
        F.when(~low.contains(name.split()[0].lower()), F.lit(name)) for name in K.CHECKLIST_ESSENTIALS
    ]))
    return F.concat(own, missing)


def checklist(listed: Column, needs_udyam: Column) -> Column:
    """The listed documents and those the applicant's own case adds."""
    low = F.lower(F.array_join(listed, "\n"))
    own_case = _texts(
        (F.upper(c("social_category")).isin("SC", "ST", "OBC")
         & ~(low.contains("caste") | low.contains("community")),
         ["Caste / Community Certificate (", c("social_category"), ")"]),
        (_bool(c("is_differently_abled")) & ~(low.contains("disability") | low.contains("udid")),
         ["Disability Certificate / UDID Card"]),
        (needs_udyam & ~_bool(c("is_udyam_registered")),
         ["Udyam Registration Certificate (Free online via udyamregistration.gov.in)"]),
        (needs_udyam & _bool(c("is_udyam_registered")), ["Udyam Registration Certificate"]),
    )
    return F.concat(listed, own_case)


def explanation(name: Column, factors: Column, title: Column, ministry: Column, subsidy: Column) -> Column:
    """Why a match was made, from its first three factors."""
    offer = F.when(
        _bool(subsidy > 0),
        F.concat(F.lit(" and offers up to "), percent_text(subsidy), F.lit("% government capital subsidy")),
    ).otherwise("")
    general = F.concat(
        F.lit("You are eligible to apply for "), title, F.lit(" under "), ministry,
        F.lit(". This program provides structured financial or operational assistance"
              " for micro and small enterprises."),
    )
    strong = F.concat(
        F.lit("Strong match for "), F.coalesce(X.text_or(name), F.lit("your profile")),
        F.lit(" based on verified criteria: "), F.array_join(F.slice(factors, 1, 3), "; "),
        F.lit(". This scheme is actively supported by "), ministry, offer, F.lit("."),
    )
    return F.when(F.size(factors) == 0, general).otherwise(strong)


def short_reason(name: Column, factors: Column) -> Column:
    return F.concat(
        F.lit("Matched for "), F.coalesce(X.text_or(name), F.lit("profile")), F.lit(" based on "),
        F.array_join(F.slice(factors, 1, 2), ", "),
    )


# ---- batch matching ---------------------------------------------------------

def scheme_texts() -> list[Column]:
    """Columns of the response view that the match texts need."""
    return [
        c("title"), c("ministry_or_org"),
        c("subsidy_percentage").cast("decimal(5,2)").alias("subsidy_percentage"),
        key_benefits(c("benefits"), c("subsidy_percentage"), c("max_funding_amount")).alias("key_benefits"),
        listed_documents(c("documents")).alias("listed_documents"),
    ]


def with_texts(schemes: DataFrame) -> DataFrame:
    """The catalog with the text columns of its response view alongside."""
    for name, kind in (("benefits", "array<struct<benefit_type:string,amount:double,"
                        "percentage:double,unit:string,description:string,conditions:string>>"),
                       ("documents", "array<struct<document_name:string,mandatory:boolean,"
                        "conditional:boolean,condition:string,issuing_authority:string>>")):
        if name not in schemes.columns:
            schemes = schemes.withColumn(name, F.lit(None).cast(kind))
    return schemes.withColumns({
        "title": c("name"),
        "ministry_or_org": F.coalesce(
            X.text_or(c("ministry"), *([c("department")] if "department" in schemes.columns else [])),
            F.lit("Government of India")),
        "max_funding_amount": F.coalesce(
            F.when(c("loan_amount_max") != 0, c("loan_amount_max")), c("grant_amount")),
    })


LOCAL = [x for x in SEGMENT if x != "state"]
ASKS_PER_PART, PROFILES_PER_PART = 200, 100_000


def _same(names: list[str], prefix: str) -> Column:
    return reduce(lambda x, y: x & y, [c(n).eqNullSafe(c(prefix + n)) for n in names])


def segments(profiles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: segments (seg, attributes, number of profiles), what they ask (ask, attributes, list_key) and which
    asks make up a segment (seg, ask).

    A segment asks for the list of its state, and for the list open to all states together with all segments that differ
    in nothing but the state, which is null there.
    """
    segs = cut_lineage(profiles.groupBy(*SEGMENT).agg(F.count("*").alias("people")).withColumn(
        "seg", F.monotonically_increasing_id()), "segments")
    shared = cut_lineage(segs.select(*LOCAL).distinct().withColumn("ask", -1 - F.monotonically_increasing_id()), "open-asks")
    asks = segs.select(c("seg").alias("ask"), *SEGMENT, catalog.own_list(c("state")).alias("list_key")).unionByName(
        shared.select("ask", *LOCAL, F.lit(None).cast("string").alias("state"), F.lit(catalog.OPEN).alias("list_key")))
    links = segs.join(shared.withColumnsRenamed({x: f"_{x}" for x in LOCAL}), _same(LOCAL, "_")).select("seg", "ask")
    return segs, asks, links.unionByName(segs.select("seg", c("seg").alias("ask")))


def coded(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profiles with the number of their segment in place of its attributes, and the written segments (seg, attributes).

    For joins that deal many links of a profile: a link carries one number, and gets the attributes where it is judged. There
    are as many segments as combinations of the attributes, so that they are few and mostly broadcast.
    """
    segs = cut_lineage(profiles.select(*SEGMENT).distinct().withColumn("seg", F.monotonically_increasing_id()), "segments")
    by_attributes = segs.withColumnsRenamed({x: f"_{x}" for x in SEGMENT})
    same = reduce(lambda x, y: x & y, [c(x).eqNullSafe(c(f"_{x}")) for x in SEGMENT])
    return profiles.join(by_attributes, same).drop(*SEGMENT, *(f"_{x}" for x in SEGMENT)), segs


def scheme_classes(schemes: DataFrame, k: int) -> DataFrame:
    """(list_key, s, members) of all active schemes: those of a list that no rule and no score can tell apart are one class.

    ``s`` holds only what rules and scores read. ``members`` are the first k (worse, scheme_id) of the class; as the
    order inside a class is the same for every profile, none behind them can be among the k best of any.
    """
    sets = lambda x: F.array_sort(F.array_distinct(x))
    here = F.substring(c("list_key"), F.lit(len(catalog.STATE) + 1), F.length("list_key"))
    named = F.filter(s("states_lc"), lambda x: X.title_case(x) == here)
    facts = [
        s("state_bound"), F.when(c("list_key").startswith(catalog.STATE), sets(named)).otherwise(L.empty()).alias("states_lc"),
        s("gender_bound"), F.when(s("gender_bound"), sets(s("genders_lc"))).otherwise(L.empty()).alias("genders_lc"),
        s("cat_bound"), s("sc_st_only"), L.empty().alias("cats_lc"), s("for_disabled"), s("pwd_only"), s("for_women"),
        s("names_disabled"), sets(s("soft_cats")).alias("soft_cats"), s("for_marginalized"), sets(s("types_lc")).alias("types_lc"),
        s("needs_udyam"),
    ]
    entries = catalog.entries(schemes, scheme_facts()).select(
        "list_key", F.struct(*facts).alias("s"), F.struct(s(catalog.WORSE), s("scheme_id")).alias("m"))
    order = Window.partitionBy("list_key", "s").orderBy("m")
    first = entries.withColumn("_rn", F.row_number().over(order)).where(c("_rn") <= k)
    return first.groupBy("list_key", "s").agg(F.sort_array(F.collect_list("m")).alias("members"))


def best_ids(profiles: DataFrame, schemes: DataFrame, k: int, wanted: Column, place: Column) -> tuple[DataFrame, DataFrame]:
    """The segments, and (seg, match_rank, scheme_id): the first k of all schemes for which ``wanted`` holds, least
    ``place`` first, then by quality and id.

    Segments are scored against classes, with no texts built and no candidate left out. The first k schemes lie in the
    first k classes by (place, first member), so each task passes on k classes of a list at most.
    """
    if k > K.RANK_LIMIT:
        raise ValueError(f"k must be {K.RANK_LIMIT} at most")
    segs, asks, links = segments(profiles)
    classes = cut_lineage(scheme_classes(schemes, k), "scheme-classes")
    pairs = salted_join(asks, classes, ["list_key"], "ask", salts=salts_for(asks, ["list_key"], ASKS_PER_PART))
    scored = with_scores(with_flags(pairs)).where(wanted).select("ask", place.cast("double").alias("place"), "members")
    by = Window.partitionBy("ask").orderBy("place", c("members")[0])
    cut = scored.withColumn("_rn", F.row_number().over(by)).where(c("_rn") <= k)
    rows = cut.select("ask", F.transform("members", lambda m: F.struct(
        c("place").alias("place"), m[catalog.WORSE].alias(catalog.WORSE), m["scheme_id"].alias("scheme_id"))).alias("rows"))
    lists = rows.groupBy("ask").agg(F.slice(F.sort_array(F.flatten(F.collect_list("rows"))), 1, k).alias("rows"))
    both = links.join(lists, "ask").groupBy("seg").agg(F.slice(F.sort_array(F.flatten(F.collect_list("rows"))), 1, k).alias("rows"))
    found = both.select("seg", F.posexplode("rows").alias("at", "row")).select(
        "seg", (c("at") + 1).alias("match_rank"), c("row.scheme_id").alias("scheme_id"))
    return segs, found


def _judged(segs: DataFrame, found: DataFrame, schemes: DataFrame, texts: list[Column] = ()) -> DataFrame:
    """The segments' found schemes with all rule and score columns; only here texts are built."""
    facts = schemes.select(c("id").alias("scheme_id"), F.struct(*scheme_facts(), *texts).alias("s"))
    return evaluate(found.join(segs.drop("people"), "seg").join(facts, "scheme_id"))


def _to_profiles(profiles: DataFrame, segs: DataFrame, rows: DataFrame, cols: list[str]) -> DataFrame:
    """Each profile with the rows of its segment.

    A segment's rows (k at most) travel as one array, so the joins keep one row
    per profile; a segment that very many profiles share is salted by their
    count.
    """
    packed = rows.groupBy("seg").agg(F.collect_list(F.struct(*cols)).alias("_rows")).join(segs, "seg").select(*SEGMENT, "_rows")
    most = segs.agg(F.max("people")).first()[0] or 0
    joined = salted_join(profiles, packed, SEGMENT, spread_by="profile_id", salts=1 + most // PROFILES_PER_PART)
    return joined.select(*profiles.columns, F.inline("_rows"))


def recommend(profiles: DataFrame, schemes: DataFrame, k: int) -> DataFrame:
    """The k best matches of every profile among all active schemes, with score, status and factors.

    Best score first, then quality, then id.
    """
    names = ["match_rank", "scheme_id", "match_score", "eligibility_status", "score_breakdown", "matching_factors"]
    segs, found = best_ids(profiles, schemes, k, c("passed"), -c("match_score"))
    return _to_profiles(profiles.select("profile_id", *SEGMENT), segs, _judged(segs, found, schemes), names)


def ineligible(profiles: DataFrame, schemes: DataFrame, k: int) -> DataFrame:
    """The k schemes of its lists that a profile fails by least, with the requirements it misses.

    Fewest missing requirements first, then quality, then id.
    """
    names = ["scheme_id", "match_score", "eligibility_status", "missing_requirements"]
    missing = sum(c(x).cast("int") for x in ("fails_state", "fails_gender", "fails_category", "fails_disability"))
    segs, found = best_ids(profiles, schemes, k, ~c("passed"), missing)
    return _to_profiles(profiles.select("profile_id", *SEGMENT), segs, _judged(segs, found, schemes), names)


def match_table(profiles: DataFrame, schemes: DataFrame, k: int, explain=None) -> DataFrame:
    """The stored match rows of all profiles, k at most, texts included.

    Benefits and documents depend on segment and scheme only and are built
    there; the explanation names the applicant and is built last. ``explain``
    may replace it: a function of the columns (full_name, matching_factors,
    title, ministry_or_org, subsidy_percentage) that gives a column, such as a
    pandas UDF.
    """
    names = ["scheme_id", "match_score", "eligibility_status", "score_breakdown", "missing_requirements", "matching_factors"]
    texts = ["key_benefits", "title", "ministry_or_org", "subsidy_percentage"]
    segs, found = best_ids(profiles, schemes, k, c("passed"), -c("match_score"))
    best = _judged(segs, found, with_texts(schemes), scheme_texts()).withColumns({n: s(n) for n in texts}).withColumn(
        "required_documents", checklist(s("listed_documents"), s("needs_udyam")))
    rows = _to_profiles(profiles.select("profile_id", "full_name", *SEGMENT), segs, best,
                        ["match_rank", *names, *texts, "required_documents"])
    reason = (explain or explanation)(
        c("full_name"), c("matching_factors"), c("title"), c("ministry_or_org"), c("subsidy_percentage"))
    return rows.select(
        c("profile_id").alias("entrepreneur_id"), "scheme_id", "match_rank",
        c("match_score").cast("decimal(5,2)").alias("match_score"), "eligibility_status",
        reason.alias("ai_reasoning"), F.lit("Recommended").alias("status"),
        c("score_breakdown").alias("match_breakdown"), "missing_requirements",
        "matching_factors", "key_benefits", "required_documents",
    )
