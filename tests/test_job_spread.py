"""The job's records are dealt over tasks before they are sorted for dedup."""

from pyspark.sql import functions as F

from eligo.plans import ingest
from eligo.registry.common import Tables
from eligo.registry.sources import binary
from eligo.session import spread


def test_unique_records_are_dealt_before_their_sort(spark, monkeypatch):
    payloads = binary(Tables(spark, "/root/testdata/sf0.001").f_json)
    whole = ingest.stages(payloads).unique.select("dedup_key", "name", "content_hash")
    monkeypatch.setattr(ingest, "spread", lambda df, key: spread(df, key, 50))
    cut = ingest.stages(payloads, cut=True)
    dealt = cut.unique._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [ingest_ord" in dealt.replace("'", "")
    unique = cut.unique.select("dedup_key", "name", "content_hash")
    assert unique.count() == whole.count() > 50
    assert unique.exceptAll(whole).isEmpty() and not unique.groupBy("dedup_key").count().where(F.col("count") > 1).count()
