"""Mixing sources to target weights, in words.

Each source's texts are laid end to end (documents in the order of a hash of their id) and cut into blocks of
BLOCK_WORDS words. The mix is a row of output shards of SHARD_SLOTS slots, each slot holding one block. A shard's slots
are shared out among the sources by their targets: the whole part of each expected count is given, the rest is a
multinomial draw seeded by the shard. A source's slots, numbered through all shards, are mapped to its blocks by a
pseudorandom permutation of the block numbers, a new one for every pass over the source, so that a source is used evenly.
Slots and blocks meet in an equi-join on source and block number.

Targets: every source's weight's share of all words, at most MAX_REPEATS times its own words; what that takes away is shared
again by weight among the others until no target is above. A slot past MAX_REPEATS passes stays empty, so no text is used
more often.

Draws, permutations and orders depend on ids and seeds alone: runs agree, and a task that runs again gives the same rows.
Running totals are built in two steps over buckets, so no task sees a whole source. Null and empty texts have size 0 and
are never taken. A null source is a source, last in order; a null doc_id is an id like others. Repeated rows are documents
of their own. An empty table gives an empty table. Only doc_id, text and source are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from eligo.llm.common import free_names, mix
from eligo.session import cut_lineage

c = F.col

WEIGHTS = (5, 2, 1)  # by the source's place in code point order, repeating
MAX_REPEATS = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
BUCKET_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]]) -> dict[str | None, tuple[int, float]]:
    """Per source its size and target. ``sizes``, one entry per source, decides the weights by its order."""
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, (s, _) in enumerate(sizes)}
    size, total = dict(sizes), sum(n for _, n in sizes)
    free, over = list(size), [None]
    while over:
        rest = total - MAX_REPEATS * sum(size[s] for s in size if s not in free)
        shares = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if shares[s] > MAX_REPEATS * size[s]]
        free = [s for s in free if s not in over]
    return {s: (size[s], float(shares[s]) if s in free else float(MAX_REPEATS * size[s])) for s in size}


def in_code_point_order(sources: list) -> list:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def running_total(rows: DataFrame, key: str, order: list[str], value: str, buckets: Column) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the key's rows that come earlier, by a hash's bucket and then ``order``.

    ``buckets`` is the number of the key's buckets, so that a large key has many."""
    bucket = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("bucket"), *order), buckets))
    sums = bucket.groupBy(key, "_bucket").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(c(key).alias("_key"), c("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (bucket.withColumn("_within", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(base, (c(key) == c("_key")) & (c("_bucket") == c("_b")))
            .withColumn("before", c("_base") + c("_within")).drop("_bucket", "_key", "_b", "_base", "_within"))


def permute(numbers: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Maps each number below its size to another below it, one to one per (size, seed): a Feistel network on the next
    even number of bits, walked on until the value is in range again."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = numbers.astype(np.uint64), np.arange(len(numbers))
    while len(todo):
        x, h, m, seed = out[todo], half[todo], low[todo], seeds[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for turn in range(4):
            left, right = right, left ^ (mix(right ^ mix(seed + np.uint64(turn))) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= sizes[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _draw(seed: int):
    def draw(shard: pd.DataFrame) -> pd.DataFrame:
        """Counts per source of one shard, from the expected counts."""
        shard = shard.sort_values("place", ignore_index=True)
        expected = shard["expected"].to_numpy()
        counts = np.floor(expected).astype(np.int64)
        rest, slots = expected - counts, int(shard["slots"].iloc[0]) - int(counts.sum())
        if slots > 0 and rest.sum() > 0:
            counts = counts + np.random.default_rng([seed, int(shard["shard"].iloc[0])]).multinomial(slots, rest / rest.sum())
        return pd.DataFrame({"shard": shard["shard"], "place": shard["place"], "count": counts})
    return draw


def _to_blocks(seed: int):
    def to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, number = b["blocks"].to_numpy(), b["number"].to_numpy()
            turn = number // n
            seeds = mix((b["place"].to_numpy() * 1_000_003 + turn).astype(np.uint64) + np.uint64(seed))
            yield pd.DataFrame({"place": b["place"], "turn": turn, "block": permute(number % n, n, seeds),
                                "shard": b["shard"], "slot": b["slot"]})
    return to_blocks


def mix_documents(docs: DataFrame, *keep: str, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The documents with size, source_size and target; and the mix: a row per slot and the part of a document in it.

    Documents: doc_id, source, place (the source's number), start (first word in its source), size, source_size, target,
    and the columns ``keep``, which come last in the order of equal ids.
    Mix: shard, slot, place, block, turn, start (the document's), first and words (the part, in words of the document).
    """
    spark = docs.sparkSession
    sized = cut_lineage(docs.select("doc_id", "source", size_of(c("text")).alias("size"), F.xxhash64("text").alias("_text"), *keep), "mix-sizes")
    # a number per source: targets depend on all of them at once
    sums = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    per, rows_of = {r["source"]: r["n"] for r in sums}, {r["source"]: r["rows"] for r in sums}
    order = in_code_point_order(list(per))
    found = targets([(s, per[s]) for s in order])
    rows = []
    for i, s in enumerate(order):
        size, target = found[s]
        blocks = -(-size // BLOCK_WORDS)
        wanted = target * blocks / max(size, 1)  # slots, as the last block may be short
        rows.append((i, s, size, target, blocks, 1 + rows_of[s] // BUCKET_ROWS, wanted))
    wanted = sum(r[-1] for r in rows)
    slots = math.ceil(wanted)
    shards = max(1, -(-slots // SHARD_SLOTS))
    sources = cut_lineage(spark.createDataFrame(
        rows, "place long, source string, source_size long, target double, blocks long, buckets long, wanted double"), "mix-sources")
    known = sized.join(sources.withColumnRenamed("source", "_s"), c("source").eqNullSafe(c("_s"))).drop("_s")
    placed = running_total(known, "place", ["doc_id", "_text", *keep], "size", c("buckets"))
    documents = cut_lineage(placed.select(
        "doc_id", "source", "place", c("before").alias("start"), "size", "source_size", "target", *keep), "mix-documents")

    last = slots - (shards - 1) * SHARD_SLOTS
    expected = sources.filter("blocks > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn(
        "slots", F.when(c("shard") == shards - 1, last).otherwise(SHARD_SLOTS).cast("long")).withColumn(
        "expected", c("slots") * c("wanted") / wanted)
    counts = expected.groupBy("shard").applyInPandas(_draw(seed), "shard int, place long, count long")
    counts = cut_lineage(counts, "mix-counts")
    numbered = running_total(counts, "place", ["shard"], "count", F.lit(1 + shards // BUCKET_ROWS))
    places = sources.select(c("place").alias("_p"), "blocks")
    filled = numbered.filter("count > 0").join(places, c("place") == c("_p")).select(
        "shard", "place", "blocks", "before", F.explode(F.sequence(F.lit(0).cast("long"), c("count") - 1)).alias("slot")).withColumn(
        "number", c("before") + c("slot")).filter(c("number") < MAX_REPEATS * c("blocks"))
    taken = filled.select("place", "blocks", "number", "shard", "slot").mapInPandas(
        _to_blocks(seed), "place long, turn long, block long, shard int, slot long")
    end = c("start") + c("size")
    pieces = documents.filter("size > 0").select(
        "place", "start", "size", F.explode(F.sequence(F.floor(c("start") / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS))).alias("block")).select(
        "place", "start", "block",
        F.greatest(F.lit(0).cast("long"), c("block") * BLOCK_WORDS - c("start")).alias("first"),
        (F.least(end, (c("block") + 1) * BLOCK_WORDS) - F.greatest(c("start"), c("block") * BLOCK_WORDS)).alias("words"))
    return documents, taken.join(pieces, ["place", "block"])


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    documents, mixed = mix_documents(docs)
    taken = mixed.groupBy("place", "start").agg(F.sum("words").alias("taken"))
    return documents.join(taken.withColumnsRenamed({"place": "_p", "start": "_s"}),
                          (c("place") == c("_p")) & (c("start") == c("_s")) & (c("size") > 0), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


@F.pandas_udf(StringType())
def _cut_words(text: pd.Series, firsts: pd.Series, words: pd.Series) -> pd.Series:
    """The words of the parts, in order, a line break between parts that do not follow each other."""
    out = []
    for t, first, n in zip(text, firsts, words):
        if t is None:  # taken whole
            out.append(None)
            continue
        at, cut, begin = [m.span() for m in re.finditer(WORD, t)], [], None
        for i, (a, k) in enumerate(zip(first, n)):
            begin = a if begin is None else begin
            if i + 1 == len(first) or first[i + 1] != a + k:
                cut.append(t[at[begin][0]:at[a + k - 1][1]])
                begin = None
        out.append("\n".join(cut))
    return pd.Series(out, dtype=object)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass over a source a row per document with the words that the pass takes of it.

    A document taken whole keeps its text as it is; otherwise the text is the parts taken. Rows are numbered in a
    written table first, so that repeated rows stay apart.
    """
    row, place, start, other, cut, parts_, whole = free_names(docs, "_row", "_p", "_s", "_r", "_cut", "_parts", "_whole")
    rows = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    documents, mixed = mix_documents(rows, row)
    parts = mixed.groupBy("place", "start", "turn").agg(
        F.sort_array(F.collect_list(F.struct("first", "words"))).alias(parts_), F.sum("words").alias("taken"))
    keys = documents.filter("size > 0").select(c("place").alias(place), c("start").alias(start), c(row).alias(other), "size")
    found = parts.join(keys, (c("place") == c(place)) & (c("start") == c(start))).select(
        other, parts_, (c("taken") == c("size")).alias(whole))
    met = rows.join(found.hint("shuffle_hash"), c(row) == c(other)).withColumn(cut, F.when(~c(whole), _cut_words(
        F.when(~c(whole), c("text")), c(f"{parts_}.first"), c(f"{parts_}.words"))).otherwise(c("text")))
    own = {"text": c(cut)} | ({"n_chars": F.char_length(cut).cast("long")} if "n_chars" in docs.columns else {})
    return met.select(*(own.get(x, c(f"`{x}`")).alias(x) for x in docs.columns))
