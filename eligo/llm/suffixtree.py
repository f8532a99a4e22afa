"""Language-model scores of texts by a probabilistic suffix tree over words.

Words are runs of anything but ASCII white space, A-Z lower-cased; every text has one end symbol after its last word. The
model is a tree of contexts of 0 to DEPTH words, nearest word first:

- The root gives every symbol (count + 1) / (all + different + 1), also one never seen.
- A context is a candidate if it was seen least() times, which is twice in a corpus of any size.
- A context names the next symbols that follow it least() times. Its distribution is smoothed by its parent's, the context
  without its farthest word: with r occurrences followed by other symbols, n / (all + 1) for a named symbol, and to each
  symbol the share (r + 1) / (all + 1) of what the parent gives it.
- Divergence test: a context stays if its distribution gives the learned texts more nats than its parent's does, by
  ln(tokens) for every named symbol and one more. Parents of what stays stay too.

A symbol is scored by the longest context of the tree that ends where it begins.

Nothing is left out that could stay. A context seen n times whose parent was seen N times gains at most n ln((N + 2) / (n + 1))
nats: its parent gives every symbol that it names k times at least k / (N + 1), and the rest loses. One that cannot reach two
times ln(tokens) that way (no context seen once or twice can) is not counted on, unless it may be the parent of one that can;
for that it has to be seen about 2 e ln(tokens) times, where n ln((N + 2) / (n + 1)) is greatest.

Counting: a sequence of n words is a pair of sequences of n - 1, its first and its last. Each task hands out its distinct pairs
with their counts by the first of them, so that a context's next symbols meet in one part; those of contexts seen HOT times
are dealt by the pair, and their sums put together after. Counts cover all texts learned from. Levels of the tree are tables,
joined with the level above by the pair's last sequence.

Scores: the logarithm of what a symbol gets is the root's, and for each context of the tree that ends before it what that one
adds: what it leaves to its parent, and if it names the symbol, the difference. So every sequence has one value (as a named
symbol after its context, and as a context), and a text's score is the sum over its sequences of up to DEPTH + 1 words. The
values form one table. Those of sequences seen held() times are in every task, whose number is bounded by HELD times the
cube root of the corpus; the others are looked up by exchange: tasks ask each part for the sequences that may be there, and the
sums for each text meet again. What may be there is told by sieves, bit maps of at most SIEVE bits; beyond that size they let
more through, which costs time but changes nothing.

Null and empty texts have the end symbol only. Texts of any length are scored whole. Repeated rows are learned from and
scored one by one. With nothing to learn from every symbol has probability 1, which is what the root's formula says. An
empty table gives an empty table. Only doc_id and text are read. Equal sequences have equal 64-bit hashes; that two different
ones of a corpus share one is taken as impossible.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligo.llm.common import chunks, mix, words
from eligo.llm.fragments import runs
from eligo.session import cut_lineage

c = F.col

DEPTH = 3
HELD = 8000
SIEVE = 29  # leading bits of a key that a sieve tells apart, at most
PART_TOKENS = 2_000_000  # of the corpus to a part; what tasks send of them is less
HOT = 4_000_000
FLUSH = 600_000  # entries that a task gathers before it hands them out
CHUNK = 1 << 20  # bytes of text that a task works on at a time, unless a single text is longer
END = np.uint64(0x51AB_FE11_0DDE_47A3)
_BYTES = 6  # of text to a token, about
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SLACK = 1 - 1e-6  # of the bounds, for rounding
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# ---- tokens and sequences of a batch

def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all symbols of the texts, each text's end included, and where each text begins (one more than texts)."""
    h, first = words(column)
    at = first + np.arange(len(first))
    out = np.full(at[-1], END, np.uint64)
    word = np.ones(len(out), bool)
    word[at[1:] - 1] = False
    out[word] = h
    return out, at


class Table:
    """Distinct ascending keys that are even over all numbers, and where those with the same leading bits begin."""

    def __init__(self, keys: np.ndarray):
        self.size, bits = len(keys), max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.append(keys, np.uint64(0xFFFF_FFFF_FFFF_FFFF))
        self.starts = np.searchsorted(keys >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where they are not."""
        at = self.starts[keys >> self.shift].astype(np.int64)
        left = np.flatnonzero(self.keys[at] < keys)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] < keys[left]]
        return np.where((self.keys[at] == keys) & (at < self.size), at, -1)


def pair_up(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The key of a sequence by the keys of it without its last and without its first word."""
    return mix(mix(before) * _ODD + after)


def longer(keys: np.ndarray) -> np.ndarray:
    """From the keys of the sequences of n symbols that end at each place those of n + 1, wrong where a text has fewer before."""
    return np.concatenate([keys[:1], pair_up(keys[:-1], keys[1:])])


def places(first: np.ndarray) -> np.ndarray:
    """How many symbols of its text stand before each symbol."""
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


# ---- counting by parts

def dealt(keys: np.ndarray, bits: int, order_by: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the keys of each part, by the leading bits of a hash; in a part by another number, if one is given."""
    part = mix(keys) >> np.uint64(64 - bits)
    order = np.argsort(part if order_by is None else part << np.uint64(32) | order_by.astype(np.uint64))
    starts, lengths = runs(part[order])
    for a, n in zip(starts.tolist(), lengths.tolist()):
        yield int(part[order[a]]), order[a:a + n]


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    starts, _ = runs(keys[order])
    return keys[order[starts]], np.add.reduceat(n[order], starts, dtype=np.int64) if len(starts) else n[:0]


def _blobs(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)


def _numbers(rows: pa.Table, **kinds: str) -> list[np.ndarray]:
    """The numbers of all rows of packed columns, one array a column."""
    def flat(column: pa.Array, kind: str) -> np.ndarray:
        _, at, data = column.cast(pa.large_binary()).buffers()
        at = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1]
        return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind) if at[-1] > at[0] else np.zeros(0, kind)

    return [np.concatenate([np.zeros(0, t), *(flat(x, t) for x in rows.column(name).chunks)]) for name, t in kinds.items()]


def _hand_out(gathered: list[tuple[np.ndarray, np.ndarray]], bits: int) -> pa.RecordBatch:
    keys, n = summed(*(np.concatenate(x) for x in zip(*gathered)))
    rows = [(part, keys[at].astype("<u8").tobytes(), n[at].astype("<i8").tobytes()) for part, at in dealt(keys, bits)]
    return _blobs(rows, [pa.int64(), pa.binary(), pa.binary()], ["part", "keys", "n"])


def counted(docs: DataFrame, bits: int) -> DataFrame:
    """key and n of all symbols of the texts."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for chunk in chunks(batches, "text", CHUNK):
            gathered.append(np.unique(symbols(chunk.column("text"))[0], return_counts=True))
            size += len(gathered[-1][0])
            if size >= FLUSH:
                yield _hand_out(gathered, bits)
                gathered, size = [], 0
        if gathered:
            yield _hand_out(gathered, bits)

    def total(rows: pa.Table) -> pa.Table:
        keys, n = summed(*_numbers(rows, keys="<u8", n="<i8"))
        return pa.table({"key": keys.view(np.int64), "n": n})

    return docs.select("text").mapInArrow(emit, "part long, keys binary, n binary").groupBy("part").applyInArrow(total, "key long, n long")


def part_bits(docs: DataFrame) -> int:
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(3, math.ceil(math.log2(max(1, size / _BYTES / PART_TOKENS))))


def least(tokens: int) -> int:
    """How often a candidate is seen, and a next symbol that a context names: twice, however many ``tokens`` there are. No context
    seen less often could stay, and a symbol seen once after a context counts with the others that it does not name."""
    return 2


def held(tokens: int) -> int:
    """How often a sequence is seen whose value every task holds; so they are at most HELD times the cube root of ``tokens``
    of one length."""
    return max(2, math.ceil(tokens ** (2 / 3) / HELD))


# ---- sieves

@dataclass(frozen=True)
class Sieve:
    """A bit for the leading bits of keys; a key without its bit is not in the set."""

    bits: int
    map: np.ndarray

    def may(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.bits)
        return (self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def sieve(keys: DataFrame) -> Sieve:
    """Of the column key, which is even over all numbers; 8 to 16 bits to a key."""
    bits = min(SIEVE, max(10, math.ceil(math.log2(8 * (keys.count() + 1)))))
    within = min(bits, 20)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0

        def out():
            at = np.unique(np.concatenate(gathered))
            starts, lengths = runs(at >> np.uint64(within))
            low = (at & np.uint64((1 << within) - 1)).astype("<u4")
            rows = [(int(at[a]) >> within, low[a:a + n].tobytes()) for a, n in zip(starts.tolist(), lengths.tolist())]
            return _blobs(rows, [pa.int64(), pa.binary()], ["part", "at"])

        for batch in batches:
            if batch.num_rows:
                gathered.append(batch.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - bits))
                size += batch.num_rows
            if size >= FLUSH:
                yield out()
                gathered, size = [], 0
        if gathered:
            yield out()

    def total(rows: pa.Table) -> pa.Table:
        mark = np.zeros(1 << within, bool)
        mark[_numbers(rows, at="<u4")[0]] = True
        return pa.table({"part": rows.column("part")[:1], "map": pa.array([np.packbits(mark, bitorder="little").tobytes()], pa.binary())})

    found = keys.select("key").mapInArrow(emit, "part long, at binary").groupBy("part").applyInArrow(total, "part long, map binary").toArrow()
    out, size = np.zeros(1 << bits >> 3, np.uint8), 1 << within >> 3
    for part, map_ in zip(found.column("part").to_pylist(), found.column("map").to_pylist()):
        out[part * size:(part + 1) * size] = np.frombuffer(map_, np.uint8)
    return Sieve(bits, out)


# ---- pairs of sequences

@dataclass(frozen=True)
class Wanted:
    """Which pairs of a level are counted: those that begin with a context that is counted on, and those that may be one of the
    next level themselves, which are seen often enough without their last and without their first word."""

    contexts: Sieve
    starts: Sieve | None = None
    parents: Sieve | None = None

    def of(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        some = self.contexts.may(before)
        if self.parents is not None:
            some |= self.parents.may(after) & self.starts.may(before)
        return some


def _merged(keys: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys)
    starts, _ = runs(keys[order])
    some = order[starts]
    return keys[some], before[some], after[some], np.add.reduceat(n[order], starts, dtype=np.int64) if len(starts) else n[:0]


def _by_pair(prefix: np.ndarray, following: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of each pair, and an order of the pairs by it and what follows."""
    different, at = np.unique(prefix, return_inverse=True)
    at, bits = np.repeat(at.astype(np.uint64), following), np.uint64(max(1, len(different).bit_length()))
    both = at << (np.uint64(64) - bits) | after >> bits
    order = np.argsort(both)
    before, both, after = different[at], both[order], after[order]
    if ((both[1:] == both[:-1]) & (after[1:] != after[:-1])).any():  # different ones whose leading bits are the same
        return before, np.lexsort((after[np.argsort(order)], before))
    return before, order


def _hand_out_pairs(gathered: list[tuple[np.ndarray, ...]], bits: int, hot: Table) -> pa.RecordBatch:
    keys, before, after, n = _merged(*(np.concatenate(x) for x in zip(*gathered)))
    dealt_by = np.where(hot.find(before) >= 0, keys, before) if hot.size else before
    part = mix(dealt_by) >> np.uint64(64 - bits)
    order = np.argsort(part << np.uint64(64 - bits) | before >> np.uint64(bits))  # a prefix may come more than once
    part, before, after, n = part[order], before[order], after[order], n[order]
    rows = []
    for a, size in zip(*(x.tolist() for x in runs(part))):
        starts, lengths = runs(before[a:a + size])
        rows.append((int(part[a]), before[a:a + size][starts].astype("<u8").tobytes(), lengths.astype("<u4").tobytes(),
                     after[a:a + size].astype("<u8").tobytes(), n[a:a + size].astype("<u4").tobytes()))
    return _blobs(rows, [pa.int64(), *[pa.binary()] * 4], ["part", "prefix", "following", "suffix", "n"])


def paired(docs: DataFrame, level: int, bits: int, floor: int, wanted: Wanted | None, hot: Table) -> DataFrame:
    """All wanted sequences of ``level`` + 1 symbols seen ``floor`` times: prefix, suffix, key, n; own, how often the prefix is
    seen, and rest, how often with other symbols after it. own is 0 where that is not known, as not all pairs were counted;
    of the hot prefixes it and rest are those of a part."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for chunk in chunks(batches, "text", CHUNK):
            keys, first = symbols(chunk.column("text"))
            for _ in range(level - 1):
                keys = longer(keys)
            some = np.flatnonzero(places(first) >= level)
            before, after = keys[some - 1], keys[some]
            if wanted is not None:
                some = wanted.of(before, after)
                before, after = before[some], after[some]
            if not len(before):
                continue
            gathered.append(_merged(pair_up(before, after), before, after, np.ones(len(before), np.int64)))
            size += len(gathered[-1][0])
            if size >= FLUSH:
                yield _hand_out_pairs(gathered, bits, hot)
                gathered, size = [], 0
        if gathered:
            yield _hand_out_pairs(gathered, bits, hot)

    def total(rows: pa.Table) -> pa.Table:
        prefix, following, after, n = _numbers(rows, prefix="<u8", following="<u4", suffix="<u8", n="<u4")
        before, order = _by_pair(prefix, following, after)
        before, after = before[order], after[order]
        starts = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (after[1:] != after[:-1])]))
        before, after, n = before[starts], after[starts], np.add.reduceat(n[order], starts, dtype=np.int64)
        starts, lengths = runs(before)
        own, named = np.add.reduceat(n, starts), np.add.reduceat(np.where(n >= floor, n, 0), starts)
        if wanted is not None:
            own = np.where(wanted.contexts.may(before[starts]), own, 0)
        own, rest = np.repeat(own, lengths), np.repeat(own - named, lengths)
        some = n >= floor
        before, after = before[some], after[some]
        return pa.table({"prefix": before.view(np.int64), "suffix": after.view(np.int64), "key": pair_up(before, after).view(np.int64),
                         "n": n[some], "own": own[some], "rest": rest[some]})

    sent = docs.select("text").mapInArrow(emit, "part long, prefix binary, following binary, suffix binary, n binary")
    return sent.groupBy("part").applyInArrow(total, "prefix long, suffix long, key long, n long, own long, rest long")


def _put_together(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The pairs with own and rest of the hot prefixes (key, n) from all their parts."""
    rows = _written(rows, "suffixtree-pairs")
    named = rows.join(F.broadcast(hot.select(c("key").alias("prefix"), c("n").alias("_own"))), "prefix").groupBy("prefix").agg(
        F.max("_own").alias("_own"), F.sum("n").alias("_named"))
    rows = rows.join(F.broadcast(named), "prefix", "left")
    some = c("_own").isNotNull() & (c("own") > 0)
    return rows.select("prefix", "suffix", "key", "n", F.when(some, c("_own")).otherwise(c("own")).alias("own"),
                       F.when(some, c("_own") - c("_named")).otherwise(c("rest")).alias("rest"))


# ---- the tree

@dataclass(frozen=True)
class Model:
    """Values of the sequences that every task holds, and which others may have one: words, and what the sieves let through."""

    bits: int  # of the parts of values, which are half as many as those of counts, as each answers for nearly all texts
    depth: int
    tokens: int
    types: int
    held: Table
    words: np.ndarray  # of the held sequences: whether it is a word
    logs: np.ndarray  # of a word's count and one; 0 for longer sequences
    values: np.ndarray
    contexts: Sieve  # contexts of the tree
    named: Sieve  # contexts of the tree with a symbol that they name after them

    def never_seen(self) -> float:
        """What the root gives a symbol never seen, as a logarithm."""
        return -math.log(self.tokens + self.types + 1)


def _bound(n: Column, above: Column) -> Column:
    """The most nats that a context seen ``n`` times can gain on its parent, seen ``above`` times."""
    return n * F.log((above + 2) / (n + 1))


def _p() -> Column:
    """What a pair's prefix gives its last symbol."""
    return F.when(c("own") > 0, (c("n") + (c("rest") + 1) * c("given")) / (c("own") + 1))


def linked(rows: DataFrame, above: DataFrame, nats: float) -> DataFrame:
    """A level of the tree: the pairs with given, what the prefix's parent gives the last symbol, up, that parent, and whether the
    sequence may gain enough as a context. above: key, n, p and prefix."""
    above = above.select(c("key").alias("suffix"), c("n").alias("_n"), c("p").alias("given"), c("prefix").alias("up"))
    return rows.join(above, "suffix").select(
        "prefix", "key", "n", "own", "rest", "given", "up", (_bound(c("n"), c("_n")) > 2 * nats * _SLACK).alias("may"))


def contexts(level: DataFrame, needed: DataFrame | None, nats: float) -> DataFrame:
    """prefix, n, value (what they leave to their parent, as a logarithm) and up, their parent, of the contexts of a level that
    stay, as they pass or are ``needed`` (prefix)."""
    gain = c("n") * (F.log(_p()) - F.log("given"))
    rows = level.filter(c("own") > 0).groupBy("prefix").agg(
        F.sum(gain).alias("gain"), F.count("*").alias("named"), F.max("own").alias("n"), F.max("rest").alias("rest"), F.max("up").alias("up"))
    rows = rows.withColumn("value", F.log((c("rest") + 1) / (c("n") + 1)))
    stays = c("gain") + c("rest") * c("value") > (c("named") + 1) * nats
    if needed is not None:
        rows, stays = rows.join(needed.withColumn("needed", F.lit(True)), "prefix", "left"), stays | c("needed").isNotNull()
    return rows.filter(stays).select("prefix", "n", "value", "up")


def named(level: DataFrame, kept: DataFrame) -> DataFrame:
    """key, n and value of what the ``kept`` contexts name: by how much its logarithm is more than what they leave to their parent
    and what that one gives."""
    rows = level.filter(c("own") > 0).select("prefix", "key", "n", (F.log(_p()) - F.log("given")).alias("more"))
    return rows.join(kept.select("prefix", "value"), "prefix").select("key", "n", (c("more") - c("value")).alias("value"))


def _written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written and read again; what was shuffled for them goes at once, as nothing reads it again."""
    conf = rows.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        return cut_lineage(rows, name)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)


def _enough(most: int, nats: float) -> int | None:
    """How often a context is seen at least that may gain enough on a parent seen ``most`` times; none if no such can."""
    return next((n for n in range(1, most + 1) if n * math.log((most + 2) / (n + 1)) > 2 * nats * _SLACK), None)


def _next_wanted(above: DataFrame, last: bool, nats: float) -> Wanted | None:
    """What to count after the level ``above``; None if none of its sequences is a context to count on."""
    parent = (c("n") + 2) > 2 * math.e * nats * _SLACK
    contexts = above.filter(c("may") if last else c("may") | parent)
    if contexts.isEmpty():
        return None
    most = None if last else above.agg(F.max("n")).first()[0]
    enough = _enough(most, nats) if most else None
    if enough is None:
        return Wanted(sieve(contexts))
    return Wanted(sieve(contexts), sieve(above.filter(c("n") >= enough)), sieve(above.filter(parent)))


def learn(docs: DataFrame, depth: int = DEPTH) -> tuple[Model, DataFrame]:
    """The model, and the values (key, n, value; n of words, else 0) that tasks do not hold, from all texts of ``docs``."""
    bits = part_bits(docs)
    vocabulary = _written(counted(docs, bits), "suffixtree-words")
    tokens, types = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    nats, floor = math.log(max(2, tokens)), least(tokens)
    above = vocabulary.select("key", "n", ((c("n") + 1) / F.lit(float(tokens + types + 1))).alias("p"), F.lit(None).cast("long").alias("prefix"))
    levels, wanted = [], None
    for level in range(1, depth + 1):
        if level > 1 and (wanted := _next_wanted(above, level == depth, nats)) is None:
            break
        hot = above.filter(c("n") >= HOT).select("key", "n")
        hot_keys = Table(np.sort(hot.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)))
        rows = paired(docs, level, bits, floor, wanted, hot_keys)
        rows = linked(_put_together(rows, hot) if hot_keys.size else rows, above, nats)
        levels.append(_written(rows.filter((c("own") > 0) | c("may")), "suffixtree-level"))
        above = levels[-1].withColumn("p", _p())
    tree, needed = [], None
    for level in reversed(levels):
        kept = _written(contexts(level, needed, nats), "suffixtree-contexts")
        tree.append((kept.select(c("prefix").alias("key"), "n", "value"), _written(named(level, kept), "suffixtree-named")))
        needed = kept.select(c("up").alias("prefix")).distinct()
    inner, entries = (reduce(DataFrame.unionByName, x) for x in zip(*tree))
    values = vocabulary.select("key", "n", c("n").alias("words"), F.lit(0.0).alias("value")).unionByName(
        inner.unionByName(entries).select("key", "n", F.lit(0).cast("long").alias("words"), "value"))
    often = values.filter(c("n") >= held(tokens)).groupBy("key").agg(F.max("words").alias("words"), F.sum("value").alias("value")).toArrow()
    keys, n, value = (often.column(i).to_numpy().astype(t) for i, t in enumerate((np.int64, np.int64, np.float64)))
    order = np.argsort(keys.view(np.uint64))
    n = n[order]
    model = Model(max(3, bits - 1), depth, tokens, types, Table(keys.view(np.uint64)[order]), n > 0, np.where(n > 0, np.log(n + 1.0), 0.0),
                  value[order], sieve(inner), sieve(entries))
    return model, values.filter(c("n") < held(tokens)).select("key", c("words").alias("n"), "value")


# ---- scores

_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"
_SUMS = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_DOCS = pa.list_(_SUMS)
_ROWS = ("part long, block long, keys binary, docs binary, known binary, base binary, more binary, sums array<struct<doc_id: long, "
         "n_tokens: long, n_known: long, base_score: double, score: double>>")
_ARROW = pa.schema([("part", pa.int64()), ("block", pa.int64()), *((x, pa.binary()) for x in ("keys", "docs", "known", "base", "more")), ("sums", _DOCS)])


def local_sums(model: Model, h: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each text the symbols, of these the learned ones, the logarithms of their counts and one, and the values of sequences,
    as far as the task holds them; keys to be asked for, and the texts they are of."""
    size, doc, at, keys = len(first) - 1, np.repeat(np.arange(len(first) - 1), np.diff(first)), places(first), h
    more, asked, of, some = np.zeros(size), [], [], np.arange(len(h))
    for n in range(1, model.depth + 2):
        if n > 1:
            keys = longer(keys)
            before = np.append(False, context[:-1]) & (at >= n - 1)  # a context ends right before
            after = context & (at >= n - 1)  # the sequence without its first word is one
            context = np.zeros(len(h), bool)
            some = np.flatnonzero(after)
            context[some] = model.contexts.may(keys[some])
            some = np.flatnonzero(before)
            before[some] = model.named.may(keys[some])
            some = np.flatnonzero(before | context)
        else:
            context = model.contexts.may(h)
        here = model.held.find(keys[some])
        own, left = here >= 0, some[here < 0]
        here, own = here[own], doc[some[own]]
        if n == 1:
            known = np.bincount(own, model.words[here], size).astype(np.int64)
            base = np.bincount(own, model.logs[here], size)
        more += np.bincount(own, model.values[here], size)
        asked.append(keys[left])
        of.append(doc[left])
    return [np.diff(first), known, base, more], np.concatenate(asked), np.concatenate(of)


def _asked(model: Model):
    """Per block of texts: one row with their sums so far, and for each part a row of the keys asked and the texts of each."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, gathered, size, count = [], [], 0, 0

        def block():
            number = TaskContext.get().partitionId() << 32 | count
            keys, of = (np.concatenate(x) for x in zip(*gathered))
            rows = [(number % (1 << model.bits), number, None, None, None, None, None, docs)]
            for part, at in dealt(keys, model.bits, of):
                rows.append((part, number, keys[at].astype("<u8").tobytes(), of[at].astype("<u4").tobytes(), None, None, None, None))
            return _blobs(rows, _ARROW.types, _ARROW.names)

        for chunk in chunks(batches, "text", CHUNK):
            sums, keys, of = local_sums(model, *symbols(chunk.column("text")))
            gathered.append((keys, of + len(docs)))
            for doc in zip(chunk.column("doc_id").to_pylist(), *(x.tolist() for x in sums)):
                docs.append(dict(zip(("doc_id", "n_tokens", "n_known", "base_score", "score"), doc)))
            size += len(keys) + 16 * chunk.num_rows
            if size >= FLUSH:
                yield block()
                docs, gathered, size, count = [], [], 0, count + 1
        if docs:
            yield block()
    return ask


def _packed_values(bits: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0

        def out():
            keys, n, value = (np.concatenate(x) for x in zip(*gathered))
            rows = [(part, keys[at].astype("<u8").tobytes(), n[at].astype("<i8").tobytes(), value[at].astype("<f8").tobytes()) for part, at in dealt(keys, bits)]
            return _blobs(rows, [pa.int64(), *[pa.binary()] * 3], ["part", "keys", "n", "value"])

        for batch in batches:
            if batch.num_rows:
                gathered.append((batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy(), batch.column("value").to_numpy()))
                size += batch.num_rows
            if size >= FLUSH:
                yield out()
                gathered, size = [], 0
        if gathered:
            yield out()
    return pack


def _answer(asks: pa.Table, values: pa.Table) -> pa.Table:
    """The sums of a part's values for each text of each block, and the blocks' own rows as they are."""
    keys, n, value = _numbers(values, keys="<u8", n="<i8", value="<f8")
    order = np.argsort(keys)
    starts, _ = runs(keys[order])
    keys = keys[order[starts]]
    table = Table(keys)
    if len(keys):
        n, value = np.maximum.reduceat(n[order], starts), np.add.reduceat(value[order], starts)
    rows = []
    for number, asked, docs in zip(*(asks.column(x) for x in ("block", "keys", "docs"))):
        if not asked.is_valid:
            continue
        at, of = table.find(np.frombuffer(asked.as_buffer(), "<u8")), np.frombuffer(docs.as_buffer(), "<u4")
        of, at = of[at >= 0], at[at >= 0]
        if not len(at):
            continue
        first, _ = runs(of)
        word = n[at] > 0
        known, base, more = (np.add.reduceat(x, first) for x in (word.astype("<u4"), np.where(word, np.log(n[at] + 1.0), 0.0), value[at]))
        rows.append((None, number.as_py(), None, of[first].tobytes(), known.astype("<u4").tobytes(), base.astype("<f8").tobytes(), more.astype("<f8").tobytes(), None))
    found = pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(_ARROW.types)], schema=_ARROW)
    return pa.concat_tables([asks.filter(asks.column("keys").is_null()).cast(_ARROW), found])


def _finish(never_seen: float):
    def finish(rows: pa.Table) -> pa.Table:
        parts = rows.to_pylist()
        docs = next(r["sums"] for r in parts if r["sums"] is not None)
        tokens, known, base, more = (np.array([d[x] for d in docs], t) for x, t in
                                     (("n_tokens", np.int64), ("n_known", np.int64), ("base_score", np.float64), ("score", np.float64)))
        for r in parts:
            if r["sums"] is None:
                at = np.frombuffer(r["docs"], "<u4")
                known[at] += np.frombuffer(r["known"], "<u4")
                base[at] += np.frombuffer(r["base"], "<f8")
                more[at] += np.frombuffer(r["more"], "<f8")
        base += tokens * never_seen
        return pa.table([pa.array([d["doc_id"] for d in docs], pa.int64()), tokens, known, base / math.log(10), (base + more) / math.log(10)],
                        schema=pa.schema(_SUMS))
    return finish


def score(docs: DataFrame, model: Model, values: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known (learned ones), base_score (by the root alone) and score of every text, as log10."""
    sent = docs.select(c("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_asked(model), _ROWS)
    table = values.mapInArrow(_packed_values(model.bits), "part long, keys binary, n binary, value binary")
    answers = sent.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(_answer, _ROWS)
    return answers.groupBy("block").applyInArrow(_finish(model.never_seen()), _SCORES)


def held_out():
    """A seventh of the documents, by a checksum of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(c("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
