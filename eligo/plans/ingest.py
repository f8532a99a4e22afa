"""The ingestion job: fetches to catalog, children, embeddings and versions."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo import constants as K
from eligo.operators import dedup, normalize, upsert, validate, vectors
from eligo.operators import stats as stats_of
from eligo.session import cut_lineage, spread
from eligo.sources import dispatch, fetches, registry

c = F.col


@dataclass
class Stages:
    """The job's tables, each a lazy DataFrame over the one before."""

    fetched: DataFrame     # every fetch with its outcome
    parsed: DataFrame      # raw records
    normalized: DataFrame  # canonical records, after category filter and limit
    checked: DataFrame     # with errors, warnings, valid
    unique: DataFrame      # one valid record per key
    planned: DataFrame | None = None  # with insert, update or skip


@dataclass
class Result:
    stats: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)


def ranked_sources(payloads: DataFrame, dim: DataFrame) -> DataFrame:
    """Fetches of the given sources, with each source's place in fetch order.

    The nine-row dimension has a known size and is broadcast.
    """
    rank = dim.select("source_id", (c("priority") * 100 + c("ordinal")).alias("source_rank"))
    return payloads.join(F.broadcast(rank), "source_id")


def run_order(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` records in arrival order, for trial runs."""
    return df.orderBy("ingest_ord").limit(limit) if limit else df


def stages(payloads: DataFrame, catalog: DataFrame | None = None, dim: DataFrame | None = None,
           known: DataFrame | None = None, category: str | None = None, limit: int | None = None,
           min_quality: int = K.MIN_QUALITY, incremental: bool = True, parsers=None,
           cut: bool = False) -> Stages:
    """Composes the job without running it.

    With ``cut`` the raw and the checked records are written to the shared
    folder and read back. Payloads are then parsed once, however often the
    later stages are used, and the wide record columns are planned once instead
    of once per parser, since projections move below a union.
    """
    if dim is not None:
        payloads = ranked_sources(payloads, dim)
    fetched = fetches.classify(payloads, known)
    parsed = dispatch.parse(fetched.where("outcome = 'ok'"), parsers)
    if cut:
        parsed = cut_lineage(parsed, "parsed")
    normalized = normalize.normalize(parsed)
    if category:
        normalized = normalize.in_category(normalized, category)
    normalized = run_order(normalized, limit)
    checked = validate.validate(normalized, min_quality)
    if cut:
        checked = cut_lineage(checked, "checked")
    valid = checked.where("valid")
    unique = dedup.dedup(spread(valid, "ingest_ord") if cut else valid)  # or tasks sort what files of 128 MB unpack to
    planned = None
    if catalog is not None:
        records = unique.withColumns({"payload_hash": c("content_hash"), "content_hash": upsert.record_hash(unique)})
        planned = upsert.with_slug(upsert.plan(records, catalog, incremental, keep_better=True))
    return Stages(fetched, parsed, normalized, checked, unique, planned)


def stats(st: Stages) -> DataFrame:
    """One row of counters. Each stage is counted where it stands.

    The fetch counters read the payloads again, their content only where hashes
    are compared; all later ones read the written records.
    """
    def count(name: str, cond=None):
        return F.count_if(cond if cond is not None else F.lit(True)).alias(name)

    rows = [
        st.fetched.agg(count("fetched", c("outcome") == "ok"), count("skipped_fetches", c("outcome") == "unchanged"),
                       count("errors", c("outcome") == "failed")),
        st.parsed.agg(count("parsed")),
        st.checked.agg(count("normalized"), count("validated", c("valid")), count("invalid", ~c("valid"))),
        dedup.duplicate_counts(st.checked.where("valid")).select("duplicates"),
    ]
    if st.planned is not None:
        new = c("action") == "insert"
        rows.append(st.planned.agg(
            count("inserted", new), count("updated", c("action") == "update"),
            count("skipped_records", c("action") == "skip"),
            count("embedded", new & vectors.worth_embedding())))
    names = [n for part in rows for n in part.columns]
    long = None
    for part in rows:
        pairs = ", ".join(f"'{n}', cast({n} as bigint)" for n in part.columns)
        tall = part.selectExpr(f"stack({len(part.columns)}, {pairs}) as (name, value)")
        long = tall if long is None else long.unionByName(tall)
    # a dozen rows, turned back into one
    one = long.agg(*[F.max(F.when(c("name") == n, c("value"))).alias(n) for n in names])
    skipped = [c(n) for n in ("skipped_fetches", "skipped_records") if n in names]
    return one.withColumn("skipped", sum(skipped[1:], skipped[0])).drop("skipped_fetches", "skipped_records")


def error_messages(fetched: DataFrame) -> DataFrame:
    """What went wrong, of classified fetches."""
    return fetched.where("outcome = 'failed'").select("url", fetches.failure_message().alias("message"))


IN_FLIGHT = ("errors", "warnings", "valid", "ingest_ord", "_source_id", "payload_hash")  # columns of the job, not of the catalog
CATALOG_COLUMNS = ("id string, dedup_key string, name string, scheme_code string, government_level string, "
                   "ministry string, content_hash string, data_version int")
REPLACED = ("scheme_eligibility_rules", "scheme_benefits", "scheme_documents", "scheme_locations")  # by scheme
ONE_PER_MODEL = "scheme_embeddings"
ADDED = ("scheme_sources", "scheme_versions", "scheme_counts", "fetch_log", "rejected_records", "rejected_payloads")  # rows are only ever added


class Conflict(RuntimeError):
    """Another run has written the store since this one read it. Nothing of this run counts; it may be run again."""


class Store:
    """Catalog tables in a shared folder, one generation per run.

    A run writes into a folder of its own. Tables of schemes and of what belongs to them are filed by a hash of the
    scheme's id, and a run writes the buckets it changes only; other tables are added to. A generation is the list of
    folders that make up every table, with their schema. It is written last, under the next number, and only if nobody has written that
    number before: so a run that dies changes nothing, and of two runs that read the same generation one fails with
    Conflict. A generation names its writer, so that a stream knows its own batches from what others wrote.
    """

    MARK = "_complete"

    def __init__(self, spark, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._manifests: dict[int, dict] = {}  # read ones; a generation does not change

    def generations(self) -> list[int]:
        return sorted(int(n[4:]) for n in self._names(self.path) if n.startswith("gen=")
                      and self._fs.exists(self._path(f"{self.path}/{n}/{self.MARK}")))

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def manifest(self, gen: int) -> dict:
        if gen in self._manifests:
            return self._manifests[gen]
        stream = self._fs.open(self._path(f"{self.path}/gen={gen}/{self.MARK}"))
        found = bytes(stream.readAllBytes()).decode()
        stream.close()
        self._manifests[gen] = json.loads(found)
        return self._manifests[gen]

    def _newest(self, before: int | None = None) -> dict:
        gens = [g for g in self.generations() if before is None or g < before]
        return self.manifest(gens[-1]) if gens else {"writer": "", "buckets": self.buckets, "tables": {}}

    def read(self, table: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """A table of the newest generation (older than ``before``), or of some of its buckets."""
        entry = self._newest(before)["tables"].get(table)
        if entry is None:
            return None
        schema = self.spark.createDataFrame([], "x int").schema.fromJson(entry["schema"])
        folders = [f for b, f in entry["folders"] if buckets is None or b in (None, *buckets)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))
        return found if buckets is None else found.where(self.bucket(table, self._newest(before)["buckets"]).isin(buckets))

    def bucket(self, table: str, buckets: int):
        return F.pmod(F.xxhash64(c("id" if table == "schemes" else "scheme_id").cast("string")), F.lit(buckets)).cast("int")

    def write(self, gen: int, tables: dict[str, DataFrame], writer: str = "") -> None:
        """Writes whole tables as generation ``gen``, in place of one of that number."""
        self._fs.delete(self._path(f"{self.path}/gen={gen}/{self.MARK}"), False)
        self._manifests.pop(gen, None)
        run, entries = f"run={uuid.uuid4().hex}", {}
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{run}/{name}")
            entries[name] = {"schema": df.schema.jsonValue(), "folders": [[None, f"{run}/{name}"]]}
        self._commit(gen, {"writer": writer, "buckets": self.buckets, "tables": entries})

    def merge(self, base: int | None, replaced: dict[str, tuple[list[int], DataFrame]], added: dict[str, DataFrame], writer: str = "") -> int:
        """Writes the generation after ``base``: buckets of tables in place of theirs, and rows added to tables.

        ``replaced`` has the touched buckets of a table and all rows that are in them from now on.
        """
        before = self.manifest(base) if base is not None else {"buckets": self.buckets, "tables": {}}
        run, entries = f"run={uuid.uuid4().hex}", dict(before["tables"])
        for name, (touched, df) in replaced.items():
            old = entries.get(name, {"folders": []})["folders"]
            if any(b is None for b, _ in old):  # a table written whole is filed by buckets from now on
                touched, df = list(range(before["buckets"])), df
            if touched:
                filed = df.withColumn("_bucket", self.bucket(name, before["buckets"]))
                filed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{run}/{name}")
            new = [[int(n[8:]), f"{run}/{name}/{n}"] for n in self._names(f"{self.path}/{run}/{name}") if n.startswith("_bucket=")]
            entries[name] = {"schema": df.schema.jsonValue(), "folders": [x for x in old if x[0] is not None and x[0] not in touched] + new}
        for name, df in added.items():
            old = entries.get(name, {"folders": []})["folders"]
            folder = f"{self.path}/{run}/{name}"
            df.write.parquet(folder)  # and not asked for a row before: that may work all of it out once more
            if self.spark.read.schema(df.schema).parquet(folder).isEmpty():
                self._fs.delete(self._path(folder), True)
            else:
                old = [*old, [None, f"{run}/{name}"]]
            entries[name] = {"schema": df.schema.jsonValue(), "folders": old}
        gen = 1 if base is None else base + 1
        self._commit(gen, {"writer": writer, "buckets": before["buckets"], "tables": entries})
        return gen

    def _commit(self, gen: int, manifest: dict) -> None:
        """The one step that makes a generation; it fails if that is there, also if it has come this moment."""
        mark = self._path(f"{self.path}/gen={gen}/{self.MARK}")
        draft = self._path(f"{self.path}/gen={gen}/_draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if self._fs.exists(mark) or not self._fs.rename(draft, mark):
            self._fs.delete(draft, False)
            raise Conflict(f"generation {gen} is there already")

    def writers(self) -> dict[int, str]:
        """Who wrote each complete generation."""
        return {gen: self.manifest(gen)["writer"] for gen in self.generations()}


def _touched(store: Store, table: str, buckets: int, *rows: DataFrame) -> list[int]:
    """Buckets in which some of the rows lie; there are as many as the store has at most."""
    found = set()
    for df in rows:
        found |= {r["b"] for r in df.select(store.bucket(table, buckets).alias("b")).distinct().collect()}
    return sorted(found)


def run(payloads: DataFrame, store: Store, source_ids: list[str] | None = None,
        limit: int | None = None, dry_run: bool = False, incremental: bool = True,
        category: str | None = None, min_quality: int = K.MIN_QUALITY, parsers=None, model=None,
        model_name: str = vectors.HASHED, restrict: bool = True, writer: str = "") -> Result:
    """Runs the job against a store and returns its counters.

    ``restrict`` keeps registered, enabled sources only (or those asked for).
    A dry run stops after dedup and writes nothing to the store. ``writer`` is
    recorded with the generation written.

    Only buckets of schemes that the run inserts or updates are written again, and a vector is made only where the
    model has none of the record's content yet. Records that fail validation and payloads that are no JSON are kept in
    tables of their own.
    """
    spark = payloads.sparkSession
    gens = store.generations()
    base = gens[-1] if gens else None
    catalog = store.read("schemes")
    if catalog is None:
        catalog = spark.createDataFrame([], CATALOG_COLUMNS)
    log = store.read("fetch_log")
    known = fetches.latest_hashes(log) if incremental and log is not None else None
    dim = registry.pick(registry.sources(spark), source_ids) if restrict else None
    st = stages(payloads, None if dry_run else catalog, dim, known, category, limit, min_quality,
                incremental, parsers, cut=True)
    if dry_run:
        return Result(stats(st).first().asDict())
    st.planned = cut_lineage(st.planned, "planned")
    counted = stats(st).first().asDict()
    now = F.current_timestamp()
    buckets = store.manifest(base)["buckets"] if base is not None else store.buckets
    written = st.planned.where("action <> 'skip'")
    touched = _touched(store, "schemes", buckets, written)

    def whole(name: str) -> bool:
        """A table that was written whole is filed by buckets at its first touch, so all of it is read once."""
        entry = store._newest()["tables"].get(name, {"folders": []})
        return any(b is None for b, _ in entry["folders"])

    def before(name: str, some: list[int]) -> DataFrame | None:
        return store.read(name) if whole(name) else store.read(name, buckets=some)

    replaced = {}
    created = F.coalesce("stored_created_at", now) if "stored_created_at" in written.columns else now
    stored = written.withColumns({"updated_at": now, "created_at": created}).drop("stored_created_at", "action", *IN_FLIGHT)
    ids = written.select("id")
    kept, changes = before("schemes", touched), stats_of.delta(None, stored)
    if kept is not None:
        changes = stats_of.delta(kept.join(ids, "id", "left_semi"), stored)
        stored = kept.drop(*IN_FLIGHT).join(ids, "id", "left_anti").unionByName(stored, allowMissingColumns=True)
    replaced["schemes"] = touched, stored
    of = ids.withColumnRenamed("id", "scheme_id")
    for name, make in zip(REPLACED, (upsert.rules, upsert.benefits, upsert.documents, upsert.locations)):
        rows, kept = make(written), before(name, touched)
        if kept is not None:
            rows = kept.join(of, "scheme_id", "left_anti").unionByName(rows, allowMissingColumns=True)
        replaced[name] = touched, rows
    vectors_before = store.read(ONE_PER_MODEL)
    fresh = vectors.to_embed(written, vectors_before, model_name) if vectors_before is not None else written
    rows = cut_lineage(vectors.embedding_rows(fresh, model, model_name), "embedded")
    some = _touched(store, ONE_PER_MODEL, buckets, rows)
    kept = before(ONE_PER_MODEL, some)
    if kept is not None:  # a vector goes only where the same model made a new one
        same = rows.select("scheme_id", "embedding_model")
        rows = kept.join(same, ["scheme_id", "embedding_model"], "left_anti").unionByName(rows, allowMissingColumns=True)
    replaced[ONE_PER_MODEL] = some, rows
    landed = st.fetched.where("outcome = 'ok'").select(c("url").alias("source_url"), "content_hash", now.alias("checked_at"))
    own = {"scheme_sources": upsert.provenance(written, now), "scheme_versions": upsert.versions(st.planned.drop("payload_hash"), now),
           "scheme_counts": changes}
    added = {
        **(own if touched or base is None else {}),
        "fetch_log": landed,
        "rejected_records": st.checked.where(~c("valid")).select("name", "scheme_code", "source_url", "errors", now.alias("rejected_at")),
        "rejected_payloads": dispatch.unreadable(st.fetched.where("outcome = 'ok'")).select("url", "source_id", now.alias("rejected_at")),
    }
    store.merge(base, replaced, added, writer)
    return Result(counted, {n: store.read(n) for n in [*replaced, *own, *added]})
