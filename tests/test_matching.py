"""Rules and scores on hand-worked pairs, and the shape of the plans."""

import pytest
from pyspark.sql import functions as F

from eligo.operators import catalog, matching
from eligo.operators.skew import salted_join

SCHEME = ("id string, name string, ministry string, status string, government_level string, states array<string>, "
          "social_categories array<string>, gender_eligibility array<string>, beneficiary_types array<string>, "
          "disability_eligibility boolean, business_types array<string>, udyam_required boolean, "
          "loan_amount_max decimal(15,2), subsidy_percentage decimal(5,2), grant_amount decimal(15,2), data_quality_score int")
PROFILE = ("profile_id long, full_name string, gender string, social_category string, is_differently_abled boolean, "
           "business_type string, state string, is_udyam_registered boolean")
BASE = dict(id="s", name="S", ministry="M", status="active", government_level="central", states=[], social_categories=[],
            gender_eligibility=[], beneficiary_types=[], disability_eligibility=False, business_types=[],
            udyam_required=False, loan_amount_max=None, subsidy_percentage=None, grant_amount=None, data_quality_score=70)
DEMO = dict(profile_id=1, full_name="Demo", gender="Female", social_category="SC", is_differently_abled=False,
            business_type="Artisan", state="Telangana", is_udyam_registered=True)


def frame(spark, schema, *rows):
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def judge(spark, profile=None, **scheme):
    p = frame(spark, PROFILE, {**DEMO, **(profile or {})})
    s = frame(spark, SCHEME, {**BASE, **scheme})
    links = spark.createDataFrame([(1, "s")], "profile_id long, scheme_id string")
    return matching.evaluate(matching.pair_up(links, p, s)).first()


CASES = [
    # the worked example: Any gender +10, own category +30, other sector +5, Udyam +5, base 10
    (dict(), dict(gender_eligibility=["Any"], social_categories=["SC", "ST"], business_types=["Manufacturing"], udyam_required=True), 60.0),
    (dict(), dict(), 45.0),
    (dict(gender=None, social_category=None, business_type=None), dict(business_types=["Service"]), 20.0),
    # "Any" hides the women among the demographics
    (dict(), dict(gender_eligibility=["Any"], beneficiary_types=["Women"]), 45.0),
    (dict(), dict(gender_eligibility=[], beneficiary_types=["Women"]), 60.0),
    # everything at once stops at 99
    (dict(is_differently_abled=True), dict(gender_eligibility=["Female"], social_categories=["SC"], business_types=["Artisan"],
                                           udyam_required=True, disability_eligibility=True), 99.0),
    # an SC-only list shuts out neither SC nor ST
    (dict(social_category="ST"), dict(social_categories=["SC"]), 50.0),
    (dict(social_category="OBC"), dict(social_categories=["SC", "ST"]), 0.0),
    (dict(social_category="OBC"), dict(social_categories=["SC", "Minority"]), 50.0),
    (dict(), dict(government_level=None, states=["Goa"]), 0.0),
    (dict(state=None), dict(government_level="state", states=["Goa"]), 45.0),
    (dict(state="goa"), dict(government_level="state", states=["Goa"]), 45.0),
    (dict(), dict(gender_eligibility=["Male"]), 0.0),
    (dict(), dict(disability_eligibility=True, beneficiary_types=["PwD", "Disabled"]), 0.0),
    (dict(), dict(disability_eligibility=True, beneficiary_types=["PwD", "Women"]), 60.0),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_score(spark, i):
    profile, scheme, expected = CASES[i]
    row = judge(spark, profile, **scheme)
    assert row.match_score == expected
    assert row.passed == (expected > 0) and (row.eligibility_status == "Ineligible") == (expected == 0)


def test_reasons_and_factors(spark):
    row = judge(spark, states=["Goa", "Kerala"], government_level="state", gender_eligibility=["Male"])
    assert row.missing_requirements == ["Restricted to states: Goa, Kerala", "Designated for Male entrepreneurs only"]
    assert row.matching_factors == []
    row = judge(spark, gender_eligibility=["Female"], udyam_required=True)
    assert row.matching_factors[0] == "Direct match for gender criterion (Female)"
    assert row.matching_factors[-1] == "Udyam registration verified"


def _catalog(spark, n=400):
    ids = spark.range(n).withColumn("id", F.col("id").cast("string"))
    states = F.when(F.col("id") % 3 == 0, F.array()).otherwise(F.array(F.concat(F.lit("S"), (F.col("id") % 4).cast("string"))))
    base = frame(spark, SCHEME, BASE).drop("id", "states", "government_level", "data_quality_score")
    return ids.join(base).withColumns({
        "states": states.cast("array<string>"), "government_level": F.lit("state"),
        "data_quality_score": (F.col("id") * 7 % 30).cast("int")})


def test_candidates_match_brute_force(spark):
    schemes = _catalog(spark)
    states = spark.createDataFrame([("s1",), ("S2",), ("nowhere",), (None,), ("",)], "state string")
    got = {}
    for r in catalog.candidates_by_state(states, schemes).orderBy("position").collect():
        got.setdefault(r.state, []).append(r.scheme_id)
    rows = schemes.select("id", "states", "data_quality_score").collect()
    for state, found in got.items():
        ok = [r for r in rows if not state or not r.states or state.title() in r.states]
        assert found == [r.id for r in sorted(ok, key=lambda r: (-r.data_quality_score, r.id))[:50]]
    assert len(got) == 5


def test_ranks_are_dense_and_scores_in_range(spark):
    schemes = _catalog(spark)
    p = frame(spark, PROFILE, *[{**DEMO, "profile_id": i, "state": f"S{i % 5}", "gender": [None, "Female"][i % 2]} for i in range(30)])
    out = matching.recommend(p, schemes, k=60).toPandas()
    assert out.match_score.between(15, 99).all()
    for _, g in out.groupby("profile_id"):
        assert sorted(g.match_rank) == list(range(1, len(g) + 1))


def test_ranking_is_cut_before_the_shuffle(spark):
    plan = catalog.candidate_lists(_catalog(spark))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan


def test_salted_join_is_an_ordinary_join(spark):
    left = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"))
    left = left.unionByName(spark.createDataFrame([(900, None)], "id long, k string"))
    right = spark.createDataFrame([("hot", 1), ("0", 2), ("3", 3), (None, 4)], "k string, v int")
    got = salted_join(left, right, ["k"], "id", salts=5)
    want = left.join(right.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2"))).select("id", "k", "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_fallback(spark):
    some, none = spark.range(2), spark.range(0)
    assert catalog.with_fallback(some, spark.range(5, 9)).count() == 2
    assert catalog.with_fallback(none, spark.range(5, 9)).count() == 4


def test_pages_partition_the_listing(spark):
    schemes = _catalog(spark, 90).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    seen = [r.id for page in range(1, 6) for r in catalog.page_of(schemes, page, 20).select("id").collect()]
    assert len(seen) == len(set(seen)) == 90
    with pytest.raises(ValueError):
        catalog.page_of(schemes, 1, 101)


def test_a_fit_beyond_the_listing_limit_is_found(spark):
    """Fifty better schemes of the state, none of which fits, do not hide the one that does."""
    row = {"status": "active", "government_level": "state", "states": ["S1"], "social_categories": [], "beneficiary_types": [],
           "business_types": [], "disability_eligibility": False, "udyam_required": False}
    all_ = [{**row, "id": f"{i:03}", "name": f"n{i}", "gender_eligibility": ["Male"], "data_quality_score": 90} for i in range(60)]
    all_.append({**row, "id": "fit", "name": "fit", "gender_eligibility": ["Female"], "data_quality_score": 10})
    full = _catalog(spark)
    schemes = spark.createDataFrame([{f.name: r.get(f.name) for f in full.schema} for r in all_], full.schema)
    p = frame(spark, PROFILE, *[{**DEMO, "profile_id": i, "state": x, "gender": "Female"} for i, x in enumerate(("s1", "S2", None))])
    got = {r.profile_id: r.scheme_id for r in matching.recommend(p, schemes, k=5).collect()}
    assert got == {0: "fit", 2: "fit"}
    assert matching.ineligible(p, schemes, k=7).groupBy("profile_id").count().collect() != []
    assert {r["count"] for r in matching.ineligible(p, schemes, k=7).groupBy("profile_id").count().collect()} == {7}
    with pytest.raises(ValueError):
        matching.recommend(p, schemes, k=5000)
