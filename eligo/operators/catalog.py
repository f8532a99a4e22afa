"""Catalog queries: facets, keyword search, paging, response view, candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eligo import constants as K
from eligo.functions import lists as L
from eligo.functions import text as X

c = F.col


# ---- facets: each gives a predicate, or None where its argument is off ------

def _either(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds)


def status_is(status: str | None) -> Column | None:
    if not status or status.lower() == "all":
        return None
    return c("status") == status.lower()


def _national() -> Column:
    """Open to every state. An unknown level or list counts as neither."""
    return (c("government_level") == "central") | (F.size("states") == 0)


def in_state(state: str | None) -> Column | None:
    if not state:
        return None
    return F.array_contains("states", state.title()) | _national()


def for_category(category: str | None) -> Column | None:
    if not category:
        return None
    return _either(
        F.array_contains("social_categories", category.upper()),
        F.array_contains("social_categories", category.title()),
        F.array_contains("beneficiary_types", category),
    )


def for_business(kind: str | None) -> Column | None:
    if not kind:
        return None
    return _either(
        F.array_contains("business_types", kind),
        F.array_contains("business_types", kind.title()),
        F.size("business_types") == 0,
    )


def for_gender(gender: str | None) -> Column | None:
    if not gender or gender.lower() == "any":
        return None
    return _either(
        F.array_contains("gender_eligibility", gender.title()),
        F.array_contains("gender_eligibility", "Any"),
        F.size("gender_eligibility") == 0,
    )


def keyword(query: str | None) -> Column | None:
    """Case-free pattern over four text columns; % and _ stay wildcards."""
    if not query:
        return None
    pattern = f"%{query.strip()}%"
    return _either(*[c(f).ilike(pattern) for f in ("name", "description", "ministry", "scheme_code")])


def facets(status="active", state=None, category=None, business_type=None, gender=None,
           query=None) -> Column:
    """All active facets together."""
    active = [f for f in (
        status_is(status), in_state(state), for_category(category), for_business(business_type),
        for_gender(gender), keyword(query),
    ) if f is not None]
    return reduce(lambda a, b: a & b, active, F.lit(True))


LISTING_ORDER = ["data_quality_score", "created_at"]


def page_of(schemes: DataFrame, page: int = 1, limit: int = K.PAGE_LIMIT_DEFAULT) -> DataFrame:
    """One page by quality, then newest, then id, which makes the order total."""
    if not 1 <= limit <= K.PAGE_LIMIT_MAX:
        raise ValueError(f"limit must be 1 to {K.PAGE_LIMIT_MAX}")
    ordered = schemes.orderBy(*[c(f).desc() for f in LISTING_ORDER], c("id").asc())
    return ordered.offset(max(0, (page - 1) * limit)).limit(limit)


def listing(schemes: DataFrame, page: int = 1, limit: int = K.PAGE_LIMIT_DEFAULT,
            **args) -> tuple[DataFrame, DataFrame]:
    """(one page of matching schemes, one row with their total)."""
    found = schemes.where(facets(**args))
    return page_of(found, page, limit), found.agg(F.count("*").alias("total"))


def seed_listing(seeds: DataFrame, category=None, business_type=None, gender=None, query=None,
                 limit: int = K.PAGE_LIMIT_DEFAULT) -> DataFrame:
    """The looser listing over seed responses, in id order."""
    def any_of(col: str, test) -> Column:
        return F.exists(L.lower_all(c(col)), test)

    out = seeds
    if category:
        out = out.where(any_of("social_categories", lambda x: x == category.lower()))
    if business_type:
        out = out.where(any_of("eligible_business_types", lambda x: x == business_type.lower()))
    if gender and gender.lower() != "any":
        out = out.where(any_of("gender_eligibility", lambda x: x.contains(gender.lower())))
    if query:
        q = query.lower()
        low = [F.lower(c("title")), F.lower(F.coalesce("description", F.lit("")))]
        out = out.where(low[0].contains(q) | low[1].contains(q))
    return out.orderBy("id").limit(limit)


def with_fallback(primary: DataFrame, default: DataFrame) -> DataFrame:
    """``primary``, or ``default`` where primary has no row at all.

    The test reads one row of primary; it is no join.
    """
    empty = ~primary.select(F.lit(1)).limit(1).exists()
    return primary.unionByName(default.where(empty), allowMissingColumns=True)


# ---- response view ----------------------------------------------------------

def demographics() -> Column:
    """Categories, genders, beneficiaries and disability, each once, in order."""
    named = F.filter(L.or_empty(c("gender_eligibility")), lambda g: F.lower(g) != "any")
    disabled = F.when(c("disability_eligibility"), F.array(F.lit("Differently-Abled")))
    return F.array_distinct(F.concat(
        L.or_empty(c("social_categories")), named, L.or_empty(c("beneficiary_types")),
        L.or_empty(disabled),
    ))


def criteria() -> Column:
    return F.struct(
        F.coalesce("udyam_required", F.lit(False)).alias("requires_udyam"),
        c("age_min").alias("min_age"),
        c("age_max").alias("max_age"),
        F.coalesce("disability_eligibility", F.lit(False)).alias("disability_eligible"),
    )


def response(schemes: DataFrame) -> DataFrame:
    """Stored schemes as callers see them. Blank and zero count as absent."""
    have = set(schemes.columns)

    def opt(name: str, kind: str = "string") -> Column:
        return c(name) if name in have else F.lit(None).cast(kind)

    extra = [n for n in ("benefits", "documents", "eligibility_rules") if n in have]
    return schemes.withColumns({
        "age_min": opt("age_min", "int"), "age_max": opt("age_max", "int"),
    }).select(
        "id",
        c("name").alias("title"),
        F.coalesce(X.text_or(c("ministry"), opt("department")), F.lit("Government of India"))
        .alias("ministry_or_org"),
        F.coalesce(X.text_or(opt("description"), opt("eligibility_text")), F.lit("")).alias("description"),
        demographics().alias("target_demographics"),
        L.or_empty(c("business_types")).alias("eligible_business_types"),
        F.coalesce(F.when(c("loan_amount_max") != 0, c("loan_amount_max")), c("grant_amount"))
        .alias("max_funding_amount"),
        "subsidy_percentage",
        X.text_or(opt("application_url"), opt("official_application_url")).alias("application_url"),
        criteria().alias("eligibility_criteria"),
        "scheme_code", opt("slug").alias("slug"),
        F.coalesce(X.text_or(c("status")), F.lit("active")).alias("status"),
        "government_level", opt("funding_type").alias("funding_type"),
        *[L.or_empty(c(f)).alias(f)
          for f in ("states", "beneficiary_types", "gender_eligibility", "social_categories")],
        *[F.coalesce(c(f), F.lit(False)).alias(f) for f in ("disability_eligibility", "udyam_required")],
        F.coalesce(X.text_or(opt("verification_status")), F.lit("UNKNOWN")).alias("verification_status"),
        opt("verified_at", "timestamp").alias("verified_at"),
        *[opt(f).alias(f) for f in ("source_name", "source_url", "official_source_url")],
        opt("updated_at", "timestamp").alias("updated_at"),
        F.coalesce("data_quality_score", F.lit(0)).alias("data_quality_score"),
        "created_at",
        *extra,
    )


def nest(parents: DataFrame, children: DataFrame, name: str, order: str = "position") -> DataFrame:
    """Each scheme with its child rows as one array, empty where it has none.

    The array is what the response holds, and a scheme has at most nine rules,
    four benefits and ten documents, so the grouped lists stay that short.
    Children are grouped before the join, partly on the map side.
    """
    fields = [f for f in children.columns if f not in ("scheme_id", order)]
    row = F.struct(order, *fields)
    lists = children.groupBy("scheme_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    plain = F.transform(c("_rows"), lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    joined = parents.join(lists, parents["id"] == lists["scheme_id"], "left").drop("scheme_id")
    return joined.withColumn(name, F.coalesce(plain, F.array().cast(joined.select(plain).schema[0].dataType))).drop("_rows")


def by_id(schemes: DataFrame, children: dict[str, DataFrame], scheme_id: str) -> DataFrame:
    """One scheme with its children; the id filter reaches every scan."""
    one = schemes.where(c("id") == scheme_id)
    for name, rows in children.items():
        one = nest(one, rows.where(c("scheme_id") == scheme_id), name)
    return one


def details(ids: DataFrame, schemes: DataFrame, children: dict[str, DataFrame], seeds: DataFrame) -> DataFrame:
    """The detail view of all ``ids`` (id): the response row with its child lists, and of ids that the catalog does not
    have the seed's row, whose lists are empty. ``found_in`` says where a row comes from; an id known nowhere has none.

    ``seeds`` has the response's columns. Children are cut to the ids asked for before they are grouped.
    """
    asked = ids.select("id").distinct()
    stored = response(schemes.join(asked, "id", "left_semi")).withColumn("found_in", F.lit("catalog"))
    rest = asked.join(schemes.select("id"), "id", "left_anti")
    other = seeds.join(rest, "id", "left_semi").withColumn("found_in", F.lit("seed"))
    out = stored.unionByName(other, allowMissingColumns=True)
    for name, rows in children.items():
        wanted = rows.join(asked.withColumnRenamed("id", "scheme_id"), "scheme_id", "left_semi")
        out = nest(out.drop(name), wanted, name)
    return out


# ---- candidates per state ---------------------------------------------------

ALL, OPEN, STATE, CLOSED = "all", "open", "state:", "closed"


def state_key(state: Column) -> Column:
    """The candidate list a profile's state asks for."""
    return F.when(X.filled(state), F.concat(F.lit(STATE), X.title_case(state))).otherwise(F.lit(ALL))


def candidate_lists(schemes: DataFrame, limit: int = K.CANDIDATE_LIMIT) -> DataFrame:
    """The ``limit`` best active schemes per list, best first.

    One list per state the catalog names, one for profiles without a state
    (``all``) and one for states the catalog does not name (``open``). A list
    holds at most ``limit`` entries of (worse, id): the ranking keeps that many
    rows per state on the map side already, so a state with most of the catalog
    is no hot key. Only ids and ranks move here, no scheme content.
    """
    active = schemes.where(c("status") == "active").select(
        F.struct((-F.coalesce("data_quality_score", F.lit(0))).alias("worse"), c("id")).alias("entry"),
        "states", _open_flag().alias("is_open"),
    )
    by_rank = [c("entry.worse").asc(), c("entry.id").asc()]

    def top(df: DataFrame) -> DataFrame:
        return df.orderBy(*by_rank).limit(limit).agg(
            F.sort_array(F.collect_list("entry")).alias("candidates"))

    everywhere = top(active.where("is_open"))
    w = Window.partitionBy("state").orderBy(*by_rank)
    local = (
        active.where("not is_open")
        .select(F.explode(F.array_distinct("states")).alias("state"), "entry")
        .where(c("state").isNotNull())
        .withColumn("_rn", F.row_number().over(w))
        .where(c("_rn") <= limit)
        .groupBy("state").agg(F.collect_list("entry").alias("own"))
    )
    merged = local.select(
        F.concat(F.lit(STATE), c("state")).alias("list_key"),
        F.slice(F.sort_array(F.concat(c("own"), everywhere.scalar())), 1, limit).alias("candidates"),
    )
    return (
        merged
        .unionByName(everywhere.select(F.lit(OPEN).alias("list_key"), "candidates"))
        .unionByName(top(active).select(F.lit(ALL).alias("list_key"), "candidates"))
    )


def _open_flag() -> Column:
    return F.coalesce(_national(), F.lit(False))


def candidates_by_state(states: DataFrame, schemes: DataFrame, limit: int = K.CANDIDATE_LIMIT) -> DataFrame:
    """(state, position, scheme_id), best first, for every distinct state given."""
    lists = candidate_lists(schemes, limit)
    fallback = lists.where(c("list_key") == OPEN).select("candidates").scalar()
    found = (
        states.select("state").distinct().withColumn("list_key", state_key(c("state")))
        .join(lists, "list_key", "left")
        .select("state", F.posexplode(F.coalesce(c("candidates"), fallback)).alias("position", "entry"))
    )
    return found.select("state", (c("position") + 1).alias("position"), c("entry.id").alias("scheme_id"))


def candidate_content(states: DataFrame, schemes: DataFrame, payload: list[Column],
                      limit: int = K.CANDIDATE_LIMIT) -> DataFrame:
    """(state, candidates): each state's list with scheme content, best first.

    Content is read for listed schemes only, so what is expensive about it is
    done at most ``limit`` times per state.
    """
    flat = candidates_by_state(states, schemes, limit)
    full = flat.withColumnRenamed("state", "_state").join(schemes, flat["scheme_id"] == schemes["id"])
    entry = F.struct("position", "scheme_id", *payload)
    return full.groupBy(c("_state").alias("state")).agg(F.sort_array(F.collect_list(entry)).alias("candidates"))


# ---- every scheme of a list -------------------------------------------------

WORSE = "worse"  # the order of candidates: quality descending, then id


def entries(schemes: DataFrame, payload: list[Column]) -> DataFrame:
    """(list_key, s) of all active schemes: ``open`` ones once, others once per state they name and once as ``closed``.

    A profile with a state asks for its state's list and the open one, a
    profile without a state for the closed and the open one; no scheme comes
    twice, and a state that no scheme names has the open list only.
    """
    keys = F.when(_open_flag(), F.array(F.lit(OPEN))).otherwise(F.concat(
        F.transform(F.filter(F.array_distinct("states"), lambda x: x.isNotNull()), lambda x: F.concat(F.lit(STATE), x)),
        F.array(F.lit(CLOSED))))
    entry = F.struct(c("id").alias("scheme_id"), (-F.coalesce("data_quality_score", F.lit(0))).alias(WORSE), *payload)
    # two steps: next to an explode the struct's fields would lose their names
    return schemes.where(c("status") == "active").select(keys.alias("keys"), entry.alias("s")).select(
        F.explode("keys").alias("list_key"), "s")


def own_list(state: Column) -> Column:
    """The list besides the open one that a profile's state asks for."""
    return F.when(X.filled(state), F.concat(F.lit(STATE), X.title_case(state))).otherwise(F.lit(CLOSED))
