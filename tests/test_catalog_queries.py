"""Queries that once took less than all of their tables, and bitmaps over several buckets."""

import pytest
from pyspark.sql import functions as F

from eligo.operators import bitmaps, catalog
from eligo.registry import REGISTRY
from eligo.registry.common import Tables
from eligo.registry.sources import all_payloads

c = F.col


def test_every_link_of_a_page_is_resolved(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    got = REGISTRY.queries["a21_absolute_urls"](t)
    links = t.pages.select(F.size(F.split("html", 'href="[^"]*"')).alias("n")).agg(F.sum(c("n") - 1)).first()[0]
    assert got.count() == links > t.pages.count() and got.filter("link like '/%'").count() == 0
    first = got.filter("position = 0").select("page_id", "link")
    assert first.exceptAll(REGISTRY.queries["a21_absolute_url"](t)).count() == 0


def test_dispatch_takes_payloads_by_outcome(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    got = {r.tag: r.records for r in REGISTRY.queries["a13_dispatch"](t).collect()}
    pages = t.f_fetches.filter("source_id in ('msme_ministry', 'mudra_portal', 'standupmitra', 'kvic')")
    assert got["ministry"] == pages.filter("status between 200 and 299 and error is null").count() < pages.filter("status = 200").count()
    assert all_payloads(t, unread=True).count() - all_payloads(t).count() == t.f_fetches.filter(
        "source_id in ('myscheme_web', 'india_gov_schemes')").count()


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """70,000 schemes, so three buckets of numbers."""
    rows = spark.range(70_000).select(
        c("id").cast("string").alias("id"), F.concat(F.lit("n"), "id").alias("name"),
        F.when(c("id") % 7 == 0, None).when(c("id") % 5 == 0, "suspended").otherwise("active").alias("status"),
        F.when(c("id") % 11 == 0, "central").otherwise("state").alias("government_level"),
        F.when(c("id") % 3 == 0, F.array(F.lit("Goa"))).when(c("id") % 3 == 1, F.array(F.lit("Kerala"), F.lit("Goa"))).alias("states"),
        F.when(c("id") % 2 == 0, F.array(F.lit("SC"))).otherwise(F.array().cast("array<string>")).alias("social_categories"),
        F.array(F.lit("Women")).alias("beneficiary_types"), F.array().cast("array<string>").alias("business_types"),
        F.when(c("id") % 4 == 0, F.array(F.lit("Any"))).otherwise(F.array(F.lit("Female"))).alias("gender_eligibility"),
        (F.xxhash64("id") % 50).cast("int").alias("data_quality_score"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    return rows, bitmaps.build(rows, str(tmp_path_factory.mktemp("bitmaps")))


FILTERS = [dict(status=None), dict(), dict(state="goa"), dict(state="kerala", category="sc", gender="female", business_type="service"),
           dict(status="suspended", gender="male"), dict(state="nowhere", category="women")]


@pytest.mark.parametrize("args", FILTERS)
def test_bitmaps_count_and_page_like_the_listing(many, args):
    rows, index = many
    want = rows.where(catalog.facets(**{"status": "active", **args}))
    assert bitmaps.total(index, **args).first().total == want.count()
    for number in (1, 2, 900, 2300):
        got = [r.id for r in bitmaps.page(index, number, 20, **args).collect()]
        assert got == [r.id for r in want.orderBy(c("data_quality_score").desc(), c("created_at").desc(), "id").offset(20 * number - 20).limit(20).collect()]


def test_a_late_page_reads_what_the_first_reads(many):
    plan = bitmaps.page(many[1], 3000, 20, status=None)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(number,59981)" in plan and "LessThanOrEqual(number,60000)" in plan  # pushed to the row groups
