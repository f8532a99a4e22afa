"""What a run leaves in the store: touched buckets, versions of changed records only, better and reviewed values, conflicts."""

import os

import pytest
from pyspark.sql import functions as F

from eligo.plans import ingest
from eligo.operators import stats, upsert
from tests.test_ingest import A, B, payloads, record, store  # noqa: F401


def folders(store, table):  # noqa: F811
    """Folders written for a table, as run and bucket."""
    return {(run, b) for run in os.listdir(store.path) if run.startswith("run=") and os.path.isdir(f"{store.path}/{run}/{table}")
            for b in os.listdir(f"{store.path}/{run}/{table}") if b.startswith("_bucket=")}


def test_runs_write_what_they_change(spark, store):  # noqa: F811
    """Three records in one payload: one changes, the others keep hash, version, vector and files."""
    first = ingest.run(payloads(spark, A, B), store)
    rows = {r.scheme_code: r for r in first.tables["schemes"].collect()}
    before = {t: folders(store, t) for t in ("schemes", "scheme_documents", "scheme_embeddings")}
    both = ("https://a.example.org/1", 200, {"data": [record(1, benefits="better", description="x"), record(2, benefits="quite new")]})
    second = ingest.run(payloads(spark, both, B), store)
    assert (second.stats["updated"], second.stats["inserted"], second.stats["skipped"]) == (1, 0, 2)  # record 1, and payload B
    after = {r.scheme_code: r for r in second.tables["schemes"].collect()}
    assert len(after) == 3 and all(after[k].asDict() == rows[k].asDict() for k in ("P1", "P3")) and after["P2"].data_version == 2
    for table, old in before.items():
        new = folders(store, table) - old
        assert len({run for run, _ in new}) == 1 and len(new) == 1, table
    assert sorted((r.scheme_id, r.version_number) for r in second.tables["scheme_versions"].collect()) == sorted(
        [(r.id, 1) for r in rows.values()] + [(rows["P2"].id, 2)])
    assert second.tables["scheme_embeddings"].count() == 3 and second.tables["fetch_log"].count() == 3

    kept = store.read("schemes")
    told, seen = ({tuple(r) for r in x.collect()} for x in (stats.overview_of(store.read("scheme_counts")), stats.overview(kept)))
    assert told == seen
    files = {t: folders(store, t) for t in before}
    third = ingest.run(payloads(spark, both, B), store)
    assert third.stats["updated"] == third.stats["inserted"] == 0 and {t: folders(store, t) for t in before} == files
    assert third.tables["schemes"].count() == 3 and third.tables["scheme_versions"].count() == 4


def test_rejected_input_is_kept(spark, store):  # noqa: F811
    broken = ("https://a.example.org/9", 200, "no json at all")
    out = ingest.run(payloads(spark, B, broken).withColumn("content", F.when(
        F.col("url").endswith("9"), F.lit(b"{'bad").cast("binary")).otherwise(F.col("content"))), store)
    assert [(r.name, len(r.errors) > 0) for r in out.tables["rejected_records"].collect()] == [("abc", True)]
    assert [r.url for r in out.tables["rejected_payloads"].collect()] == ["https://a.example.org/9"]


def test_of_two_runs_on_one_generation_one_fails(spark, store):  # noqa: F811
    ingest.run(payloads(spark, A), store)
    rows = store.read("schemes")
    store.merge(1, {"schemes": ([], rows)}, {}, "quicker")
    with pytest.raises(ingest.Conflict):
        store.merge(1, {"schemes": ([], rows)}, {}, "slower")
    assert store.generations() == [1, 2] and store.writers()[2] == "quicker" and store.read("schemes").count() == 2


def test_better_and_reviewed_values_stay(spark):
    kind = ("dedup_key string, id string, content_hash string, data_quality_score int, source_url string, "
            "verification_status string, verified_at timestamp, data_version int")
    stored = spark.createDataFrame([("k1", "1", "a", 80, "u1", "VERIFIED_OFFICIAL", None, 3), ("k2", "2", "a", 80, "u1", "NEW", None, 1),
                                    ("k3", "3", "a", 50, "u1", "VERIFIED_OFFICIAL", None, 1)], kind).withColumn(
        "verified_at", F.when(F.col("id") == "3", F.lit("2024-01-01").cast("timestamp")))
    batch = spark.createDataFrame([("k1", "b", 60, "u2", "NEW", None), ("k2", "b", 60, "u1", "NEW", None), ("k3", "b", 90, "u9", "NEW", None)],
                                  "dedup_key string, content_hash string, data_quality_score int, source_url string, verification_status string, verified_at timestamp")
    got = {r.dedup_key: r for r in upsert.plan(batch, stored, keep_better=True).collect()}
    assert [got[k].action for k in ("k1", "k2", "k3")] == ["skip", "update", "update"]  # poorer from elsewhere; same source; better
    assert got["k3"].verification_status == "VERIFIED_OFFICIAL" and got["k3"].verified_at is not None and got["k2"].verification_status == "NEW"
    assert {r.action for r in upsert.plan(batch, stored).collect()} == {"update"}


def test_a_record_hash_follows_the_record(spark):
    rows = spark.createDataFrame([("a", "x", "h1", 1, "u1"), ("a", "x", "h2", 2, "u2"), ("a", "y", "h1", 1, "u1")],
                                 "name string, description string, content_hash string, ingest_ord int, source_url string")
    one, two, three = (r[0] for r in rows.select(upsert.record_hash(rows)).collect())
    assert one == two != three
