"""What the ingestion job works out once: a long text's lower case, and the rows added to a table."""

import os

from pyspark.sql import functions as F

from eligo.functions import numbers as N
from eligo.operators import normalize
from eligo.registry import normalize as RN
from eligo.registry.common import Tables
from tests.test_ingest import store  # noqa: F401


def test_texts_are_lowered_before_words_are_sought(spark):
    plan = RN.normal(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(low") > 20 > plan.count("Contains(lower(")


def test_numbers_are_found_as_in_the_whole_text(spark):
    texts = ["Age 21 YEARS AND ABOVE", "18 yrs Minimum", "BELOW 40", "Up\tto 35 years", "upto 12", "MAXIMUM 9", "", "none 12",
             "Family INCOME not exceeding Rs. 3 Lakh", "income 5", "İNCOME 7 above", "ministry of 30", "3 MIN 4 max 5"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("low", F.lower("t"))
    some = N.number_texts(F.col("t"), F.col("low"))
    pairs = [(N.age_min, "age_min"), (N.age_max, "age_max"), (N.income_limit, "income")]
    rows = df.select("t", *[f(F.col("t")).alias(f"{n}_a") for f, n in pairs], *[f(some[n]).alias(f"{n}_b") for f, n in pairs]).collect()
    assert all(r[f"{n}_a"] == r[f"{n}_b"] for r in rows for _, n in pairs)
    assert sum(r[f"{n}_a"] is not None for r in rows for _, n in pairs) >= 8


def test_added_rows_are_worked_out_once(spark, store):  # noqa: F811
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def watched(x):
        seen.add(1)
        return x

    rows = spark.range(5, numPartitions=1).select(watched("id").alias("x"))
    store.merge(None, {}, {"fetch_log": rows, "rejected_records": spark.range(0).toDF("x")}, "w")
    assert seen.value == 5 and store.read("fetch_log").count() == 5 and store.read("rejected_records").count() == 0
    assert not any(os.path.exists(f"{store.path}/{run}/rejected_records") for run in os.listdir(store.path))


def test_eligibility_text_is_clean_wherever_it_comes_from(spark):
    rows = spark.createDataFrame([("Some scheme", " For  women \n only ", None), ("Other scheme", "about", "x \t y")],
                                 "name string, description string, eligibility_text string")
    got = {r.name: r.eligibility_text for r in normalize.normalize(rows.selectExpr(
        "*", "struct(0 as source, name as url, '' as fetch, 0 as record) as ingest_ord")).collect()}
    assert got == {"Some scheme": "For women only", "Other scheme": "x y"}
