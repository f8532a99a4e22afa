"""The whole job: insert, no-op, update, dry run, limits, and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from eligo.plans import ingest
from eligo.sources import fetches
from eligo.streaming import ingest as streaming

PAYLOAD = "url string, source_id string, status int, content binary, content_type string, error string"


def record(i, **more):
    return {"schemeName": f"Support program number {i}", "schemeId": f"P{i}", "level": "central",
            "schemeDescription": f"Loans and training for small producers of kind {i} in villages",
            "eligibility": "Women aged 18 years and above, Udyam needed", "officialUrl": f"https://p{i}.example.org/", **more}


def payloads(spark, *rows):
    return spark.createDataFrame([
        (u, "apisetu_myscheme", status, bytearray(json.dumps(body), "utf-8") if body is not None else None, None, None)
        for u, status, body in rows], PAYLOAD).coalesce(1)


@pytest.fixture
def store(spark, tmp_path):
    return ingest.Store(spark, str(tmp_path / "store"))


A = ("https://a.example.org/1", 200, {"data": [record(1), record(2), record(1, benefits="better", description="x")]})
B = ("https://a.example.org/2", 200, [record(3), {"schemeName": "abc"}, {"schemeName": ""}])
DOWN = ("https://a.example.org/3", 503, None)


def test_insert_then_no_op_then_update(spark, store):
    first = ingest.run(payloads(spark, A, B, DOWN), store)
    # "abc" is too short a name; the blank one never becomes a record
    want = {"fetched": 2, "errors": 1, "parsed": 6, "normalized": 5, "validated": 4, "invalid": 1, "duplicates": 1,
            "inserted": 3, "updated": 0, "skipped": 0, "embedded": 3}
    assert first.stats == want
    assert first.stats["validated"] == first.stats["duplicates"] + first.stats["inserted"]
    best = first.tables["schemes"].where("scheme_code = 'P1'").first()
    assert best.benefits_text == "better"
    assert first.tables["scheme_documents"].count() > 0 and first.tables["scheme_embeddings"].count() == 3

    again = ingest.run(payloads(spark, A, B), store)
    assert again.stats["skipped"] == 2 and again.stats["inserted"] == again.stats["updated"] == 0
    assert again.tables["schemes"].count() == 3 and again.tables["scheme_versions"].count() == 3

    changed = ("https://a.example.org/2", 200, [record(3, benefits="more money")])
    third = ingest.run(payloads(spark, A, changed), store)
    assert third.stats["updated"] == 1 and third.stats["skipped"] == 1 and third.stats["inserted"] == 0
    after = third.tables["schemes"]
    assert after.count() == 3 and after.select("id").distinct().count() == 3
    assert {(r.version_number, r.change_summary) for r in third.tables["scheme_versions"].collect()} == {
        (1, "Initial import"), (2, "Content changed")}
    assert third.tables["scheme_embeddings"].count() == 3


def test_full_update_and_filters(spark, store):
    ingest.run(payloads(spark, A, B), store)
    full = ingest.run(payloads(spark, A), store, incremental=False)
    assert full.stats["updated"] == 2
    dry = ingest.run(payloads(spark, A, B), store, dry_run=True, limit=3, incremental=False)
    assert dry.stats["normalized"] == 3 and "inserted" not in dry.stats
    assert store.generations() == [1, 2]
    only = ingest.run(payloads(spark, A, B), store, dry_run=True, category="kind 3", incremental=False)
    assert only.stats["normalized"] == 1
    none = ingest.run(payloads(spark, A), store, dry_run=True, source_ids=["kvic"], incremental=False)
    assert none.stats["parsed"] == 0


def test_an_unfinished_generation_is_not_read(spark, store):
    ingest.run(payloads(spark, A), store)
    store.read("schemes").write.parquet(f"{store.path}/gen=2/schemes")
    assert store.generations() == [1]
    assert ingest.run(payloads(spark, B), store).tables["schemes"].count() == 3


def test_stream_gives_what_the_batch_gives(spark, store, tmp_path):
    landing, mark = str(tmp_path / "landing"), str(tmp_path / "mark")
    stream_store = ingest.Store(spark, str(tmp_path / "stream"))
    for part in (payloads(spark, A), payloads(spark, B, DOWN)):
        part.write.mode("append").parquet(landing)
        streaming.refresh(fetches.stream_fetches(spark, landing), stream_store, mark).awaitTermination()
    ingest.run(payloads(spark, A), store)
    ingest.run(payloads(spark, B, DOWN), store)
    cols = ["id", "dedup_key", "name", "content_hash", "data_version"]
    streamed, batch = (s.read("schemes").select(cols).orderBy("id").collect() for s in (stream_store, store))
    assert streamed == batch and len(batch) == 3
    # nothing new has landed: nothing changes
    streaming.refresh(fetches.stream_fetches(spark, landing), stream_store, mark).awaitTermination()
    assert stream_store.generations() == [1, 2]


def test_first_sightings(spark, tmp_path):
    rows = [("u", "a", 0), ("u", "a", 5), ("u", "b", 6), ("v", "a", 7)]
    df = spark.createDataFrame(rows, "url string, content string, m int").selectExpr(
        "url", "content", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,m) as fetched_at")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = (streaming.first_sightings(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("url", "content").collect()
    assert sorted(map(tuple, got)) == [("u", "a"), ("u", "b"), ("v", "a")]


def refresh(spark, store, tmp_path, name="in", mark="ck"):
    query = streaming.refresh(fetches.stream_fetches(spark, str(tmp_path / name)), store, str(tmp_path / mark))
    query.awaitTermination()


def test_a_stream_adds_to_what_others_wrote(spark, store, tmp_path):
    """One foreign generation before the stream begins, one between two refreshes: nothing is lost."""
    ingest.run(payloads(spark, A), store)
    payloads(spark, B).write.parquet(str(tmp_path / "in"))
    refresh(spark, store, tmp_path)
    assert store.read("schemes").count() == 3
    ingest.run(payloads(spark, ("https://a.example.org/4", 200, [record(4)])), store)
    payloads(spark, ("https://a.example.org/5", 200, [record(5)])).write.mode("append").parquet(str(tmp_path / "in"))
    refresh(spark, store, tmp_path)
    assert sorted(r.scheme_code for r in store.read("schemes").collect()) == ["P1", "P2", "P3", "P4", "P5"]
    assert store.generations() == [1, 2, 3, 4]
    assert [w.rpartition("/")[2] for w in store.writers().values()] == ["", "ck#0", "", "ck#1"]


def test_a_rewrite_that_dies_does_not_count(spark, store):
    ingest.run(payloads(spark, A), store)
    with pytest.raises(Exception):
        store.write(1, {"schemes": spark.range(1), "scheme_versions": spark.range(1).selectExpr("raise_error('died') as x")})
    assert store.generations() == []


def test_updates_keep_dates_and_other_models_vectors(spark, store):
    first = ingest.run(payloads(spark, B), store)
    before = first.tables["schemes"].first()
    assert not set(ingest.IN_FLIGHT) & set(first.tables["schemes"].columns)
    vectors = store.read("scheme_embeddings")
    other = vectors.withColumn("embedding_model", F.lit("other"))
    store.write(2, {n: store.read(n) for n in first.tables if n != "scheme_embeddings"} | {"scheme_embeddings": vectors.unionByName(other)})
    changed = ("https://a.example.org/2", 200, [record(3, benefits="more money")])
    third = ingest.run(payloads(spark, changed), store)
    after = third.tables["schemes"].first()
    assert third.stats["updated"] == 1 and after.created_at == before.created_at and after.updated_at > before.updated_at
    assert sorted(r.embedding_model for r in third.tables["scheme_embeddings"].collect()) == sorted(
        ["other", vectors.first().embedding_model])


def test_a_refresh_leaves_out_repeats_and_late_fetches(spark, store, tmp_path):
    landing, mark = str(tmp_path / "in"), str(tmp_path / "ck")

    def land(minute, *rows):
        at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.expr(f"interval {minute} minutes")
        payloads(spark, *rows).withColumn("fetched_at", at).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(PAYLOAD + ", fetched_at timestamp").parquet(landing)
        streaming.refresh(stream, store, mark, time="fetched_at").awaitTermination()

    url = "https://a.example.org/7"
    land(10, (url, 200, [record(7, benefits="first")]))
    land(5, (url, 200, [record(7, benefits="late")]))
    assert store.read("schemes").first().benefits_text == "first" and store.read("scheme_versions").count() == 1
    land(20, (url, 200, [record(7, benefits="newer")]))
    assert store.read("schemes").first().benefits_text == "newer" and store.read("schemes").first().data_version == 2
