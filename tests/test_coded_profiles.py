"""Links are dealt with the number of a profile's segment, not with its attributes."""

import re

from eligo.operators import matching as M
from eligo.registry import REGISTRY
from eligo.registry.common import Tables

T = "/root/testdata/sf0.001"


def test_a_segment_gives_its_attributes_back(spark):
    profiles = Tables(spark, T).f_profiles
    odd = profiles.limit(1).selectExpr(*[f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in profiles.schema])
    profiles = profiles.unionByName(odd)  # a profile of which nothing is known keeps its place
    coded, segs = M.coded(profiles)
    assert not set(M.SEGMENT) & set(coded.columns) and segs.select(*M.SEGMENT).distinct().count() == segs.count()
    back = coded.join(segs, "seg").select(*profiles.columns)
    assert back.exceptAll(profiles).isEmpty() and profiles.exceptAll(back).isEmpty()


def test_links_carry_no_attributes_to_their_schemes(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        query = REGISTRY.queries["g19_short_reason"](Tables(spark, T))
        plan = query._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(scheme_id", plan)
    assert dealt and not any(f"{name}#" in columns for columns in dealt for name in ("gender", "social_category", "business_type"))
    assert any("seg#" in columns for columns in dealt)
