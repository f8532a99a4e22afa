"""Line dedup that can be undone: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased; keys shorter than MIN_CHARS code points
are never dropped. The store holds, per batch, how many documents each key gained or lost (a table that is only
appended to, filed by shard), and per shard a cuckoo filter of the keys that MIN_DOCS documents or more hold. Inserting
documents adds keys to the filters when their count reaches the threshold; deleting documents builds the filters of shards
that lose keys anew from the counts, since a print taken out may stand for another key as well. Cleaning asks the filters first, so that of all lines only those that may be frequent reach the
exact counts; a filter's false positives end there.

Keys are two 64-bit hashes. Shards hold a bounded number of keys, and a key that very many documents hold is split over
salts before its shard's filter is asked. Null and empty texts are one empty line. A repeated doc_id is one document: its
rows lose the same keys. Rows with a null doc_id are one document, which loses no line. Ties do not arise, since the largest doc_id keeps its lines. An empty table gives an empty table.
Only doc_id and text are read; filter_documents keeps further columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from eligo.llm.common import mix
from eligo.session import cut_lineage, new_table_path

c = F.col

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_ROWS = 100_000  # pairs of key and document that one task takes in at a time
_SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SLOTS = 4
_KICKS = 200
FILTERS = StructType([StructField("shard", IntegerType()), StructField("tables", ArrayType(BinaryType()))])


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACES)), _UPPER, _LOWER)


def key_pairs(docs: DataFrame) -> DataFrame:
    """Distinct (k1, k2, doc_id) of the lines long enough."""
    keys = F.filter(F.transform(lines_of(c("text")), line_key), lambda k: F.char_length(k) >= MIN_CHARS)
    hashed = F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(F.lit("line"), k).alias("k2")))
    return docs.select("doc_id", F.explode(F.array_distinct(hashed)).alias("k")).select("k.k1", "k.k2", "doc_id").distinct()


# Cuckoo filters over numpy arrays: a filter is a list of tables, each with twice the buckets of the one before, so that
# a full one never has to be rebuilt. A table has _SLOTS fingerprints of 16 bits to a bucket; 0 is an empty slot.

def _prints(k2: np.ndarray) -> np.ndarray:
    return (mix(k2.astype(np.uint64)) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)


def _other(bucket: np.ndarray, prints: np.ndarray, buckets: int) -> np.ndarray:
    return bucket ^ (mix(prints.astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)


def _first_bucket(k1: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(k1.astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)


def _put(table: np.ndarray, bucket: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts prints in, one to a bucket and round; a full bucket gives up a print, which moves on. Returns what is left over."""
    for turn in range(_KICKS):
        if not len(prints):
            break
        other = _other(bucket, prints, len(table))
        bucket = np.where((table[bucket] != 0).all(1) & (table[other] == 0).any(1), other, bucket)
        _, now = np.unique(bucket, return_index=True)
        free = table[bucket[now]] == 0
        slot = np.where(free.any(1), free.argmax(1), (prints[now] + turn) % _SLOTS)
        out = table[bucket[now], slot].copy()
        table[bucket[now], slot] = prints[now]
        moved = out != 0
        rest = np.ones(len(prints), bool)
        rest[now] = False
        bucket = np.concatenate([_other(bucket[now][moved], out[moved], len(table)), bucket[rest]])
        prints = np.concatenate([out[moved], prints[rest]])
    return bucket, prints


def cuckoo_insert(tables: list[np.ndarray], k1: np.ndarray, k2: np.ndarray) -> list[np.ndarray]:
    """Keys must not be in the filter yet. A print that finds no place would lose its key, so a crowded table is not used."""
    while len(k1):
        size = len(tables[-1]) if tables else 0
        room = int(size * _SLOTS * 0.85) - int((tables[-1] != 0).sum()) if tables else 0
        if room <= 0:
            need = 1 << max(6, int(np.ceil(np.log2(len(k1) / (_SLOTS * 0.85) + 1))))
            tables = [*tables, np.zeros((max(2 * size, need), _SLOTS), np.uint16)]
            continue
        new, prints = tables[-1].copy(), _prints(k2[:room])
        _, left = _put(new, _first_bucket(k1[:room], size), prints)
        if len(left):  # crowded after all: leave this table as it was
            tables = [*tables, np.zeros((max(2 * size, 64), _SLOTS), np.uint16)]
            continue
        tables = [*tables[:-1], new]
        k1, k2 = k1[room:], k2[room:]
    return tables


def cuckoo_contains(tables: list[np.ndarray], k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    found, prints = np.zeros(len(k1), bool), _prints(k2)
    for table in tables:
        a = _first_bucket(k1, len(table))
        for bucket in (a, _other(a, prints, len(table))):
            found |= (table[bucket] == prints[:, None]).any(1)
    return found


def cuckoo_delete(tables: list[np.ndarray], k1: np.ndarray, k2: np.ndarray) -> list[np.ndarray]:
    """Takes out one print for each key; the keys must be in the filter."""
    tables = [t.copy() for t in tables]
    prints, left = _prints(k2), np.arange(len(k1))
    for table in tables:
        a = _first_bucket(k1, len(table))
        for bucket in (a, _other(a, prints, len(table))):
            for _ in range(_SLOTS * 2):
                hit = left[(table[bucket[left]] == prints[left, None]).any(1)]
                if not len(hit):
                    break
                _, at = np.unique(bucket[hit], return_index=True)
                now = hit[at]
                table[bucket[now], (table[bucket[now]] == prints[now, None]).argmax(1)] = 0
                left = np.setdiff1d(left, now)
    return tables


def _tables(cells) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint16).reshape(-1, _SLOTS) for b in cells]


def _ask(key, pairs: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(filters):
        return pairs.iloc[:0]
    return pairs[cuckoo_contains(_tables(filters["tables"].iloc[0]), pairs["k1"].to_numpy(), pairs["k2"].to_numpy())]


def _change(key, keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    tables = _tables(filters["tables"].iloc[0]) if len(filters) else []
    tables = cuckoo_insert(tables, keys["k1"].to_numpy(), keys["k2"].to_numpy())
    return pd.DataFrame({"shard": pd.Series([key[0]], dtype="int32"), "tables": [[t.tobytes() for t in tables]]})


class LineStore:
    """Counts and filters under ``path``; a new path starts an empty store with ``shards`` shards.

    Every update appends one batch of counts and writes the filters anew under the batch's number, the number being
    recorded last (here, by the caller keeping the object): an update that dies leaves the store as it was.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int):
        self.spark, self.path, self.shards, self.batches = spark, path, shards, 0
        self.filters = spark.createDataFrame([], FILTERS)

    def counts(self) -> DataFrame:
        """The exact number of documents per key, where not 0."""
        if not self.batches:
            return self.spark.createDataFrame([], "shard int, k1 long, k2 long, n long")
        parts = [f"{self.path}/counts-{i}" for i in range(self.batches)]
        all_ = self.spark.read.schema("shard int, k1 long, k2 long, n long").parquet(*parts)
        return all_ if self.batches == 1 else all_.groupBy("shard", "k1", "k2").agg(F.sum("n").alias("n")).filter("n != 0")

    def insert(self, docs: DataFrame) -> None:
        """Counts documents in. Each document may be inserted once."""
        self._update(key_pairs(docs), 1)

    def delete(self, docs: DataFrame) -> None:
        """Counts documents out, given with the texts they were inserted with; keys the store does not hold are ignored."""
        self._update(key_pairs(docs), -1)

    def insert_pairs(self, pairs: DataFrame) -> None:
        """The same from key_pairs() of the documents."""
        self._update(pairs, 1)

    def _update(self, pairs: DataFrame, sign: int) -> None:
        batch = pairs.groupBy("k1", "k2").agg((sign * F.count("*")).alias("n")).withColumn(
            "shard", F.pmod("k1", F.lit(self.shards)).cast("int"))
        held = self.counts().select("shard", "k1", "k2", c("n").alias("held"))
        joined = batch.join(held, ["shard", "k1", "k2"], "left") if self.batches else batch.withColumn("held", F.lit(None).cast("long"))
        joined = joined.withColumn("held", F.coalesce("held", F.lit(0).cast("long"))).withColumn("n", F.greatest(c("n"), -c("held")))
        path = f"{self.path}/changes-{self.batches}"
        joined.write.mode("overwrite").parquet(path)
        changed = self.spark.read.schema(joined.schema).parquet(path)
        changed.select("shard", "k1", "k2", "n").filter("n != 0").write.mode("overwrite").parquet(f"{self.path}/counts-{self.batches}")
        before, after = c("held") >= MIN_DOCS, c("held") + c("n") >= MIN_DOCS
        crossed, old = changed.filter(before != after).select("shard", "k1", "k2"), self.filters
        if sign < 0:
            # a print taken out may be another key's in an earlier table: shards that lose keys are built anew from the counts
            touched = crossed.select("shard").distinct()
            rest = held.select("shard", "k1", "k2", "held").join(touched, "shard", "left_semi").filter(c("held") >= MIN_DOCS)
            crossed, old = rest.join(crossed, ["shard", "k1", "k2"], "left_anti"), old.join(touched, "shard", "left_anti")
        filters = crossed.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(_change, FILTERS)
        filters.write.mode("overwrite").parquet(f"{self.path}/filters-{self.batches}")
        self.filters = self.spark.read.schema(FILTERS).parquet(f"{self.path}/filters-{self.batches}")
        self.batches += 1

    def drops(self, pairs: DataFrame) -> DataFrame:
        """(doc_id, keys): the keys whose lines each document of ``pairs`` loses, since a larger doc_id of these holds them too."""
        frequent = self.counts().filter(c("n") >= MIN_DOCS)
        most = frequent.agg(F.max("n")).first()[0] or 1
        salts = 1 + most // SHARD_ROWS
        pairs = pairs.withColumn("shard", F.pmod("k1", F.lit(self.shards)).cast("int")).withColumn(
            "salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        asked = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        maybe = pairs.groupBy("shard", "salt").cogroup(asked.groupBy("shard", "salt")).applyInPandas(_ask, pairs.schema)
        maybe = cut_lineage(maybe.select("k1", "k2", "doc_id"), "line-candidates")
        last = maybe.groupBy("k1", "k2").agg(F.max("doc_id").alias("last"))
        doomed = cut_lineage(frequent.select("k1", "k2").join(last, ["k1", "k2"]), "line-keepers")
        return maybe.join(doomed, ["k1", "k2"]).filter(c("doc_id") < c("last")).groupBy("doc_id").agg(
            F.collect_list("k1").alias("keys"))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("n", LongType())]))
def _rebuild(text: pd.Series, hashes: pd.Series, keys: pd.Series) -> pd.DataFrame:
    out = []
    for t, h, k in zip(text, hashes, keys):
        if k is None:
            out.append((None, 0))
            continue
        stays = ~np.isin(h, k)
        out.append(("\n".join(line for line, s in zip(t.split("\n"), stays) if s), int(len(stays) - stays.sum())))
    return pd.DataFrame(out, columns=["text", "n"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with kept_text, n_lines (before dropping) and n_dropped added; texts move once, to meet their drops."""
    pairs = cut_lineage(key_pairs(docs), "line-pairs")
    store = LineStore(docs.sparkSession, new_table_path(docs.sparkSession, "line-store"), 1 + pairs.count() // SHARD_ROWS)
    store.insert_pairs(pairs)
    drops = store.drops(pairs).select(c("doc_id").alias("_drop_id"), c("keys").alias("_drop_keys"))
    met = docs.join(drops.hint("shuffle_hash"), c("doc_id") == c("_drop_id"), "left")
    hit = c("_drop_keys").isNotNull()
    rebuilt = _rebuild(F.when(hit, c("text")), F.when(hit, F.transform(lines_of(c("text")), lambda x: F.xxhash64(line_key(x)))),
                       c("_drop_keys"))
    return met.withColumn("_rebuilt", rebuilt).select(
        *(docs[x] for x in docs.columns),
        F.when(hit, c("_rebuilt.text")).otherwise(F.coalesce(docs["text"], F.lit(""))).alias("kept_text"),
        F.size(lines_of(docs["text"])).cast("long").alias("n_lines"),
        F.when(hit, c("_rebuilt.n")).otherwise(F.lit(0)).cast("long").alias("n_dropped"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents with their columns, repeated lines gone from the texts; a text that loses none stays as it is."""
    rest = [x for x in docs.columns if x not in ("doc_id", "text")]
    cleaned = dedup_lines(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_row")))
    lost = c("n_dropped") > 0
    own = {"doc_id": c("doc_id"), "text": F.when(lost, c("kept_text")).otherwise(c("text")),
           "n_chars": F.when(lost, F.char_length("kept_text").cast("long")).otherwise(c("_row.n_chars")) if "n_chars" in rest else None}
    return cleaned.select(*(own.get(x, c(f"_row.`{x}`")).alias(x) for x in docs.columns))
