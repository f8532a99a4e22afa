"""Vertical fragments: the ranges of an order over 64-bit keys, counted separately and summed per owner.

Texts are read in blocks. A block sends each of its distinct keys to the key's fragment once, so a key that very many
documents hold weighs one entry per block, and a fragment's size is bounded by the number of fragments, which follows
the corpus. Each fragment answers every block, and the answers meet again at the block.

Rows on the way are packed: arrays of numbers as binary columns, so that Spark moves few, large rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

PACKED = StructType([StructField("part", IntegerType()), StructField("block", LongType()), StructField("head", BooleanType())]
                    + [StructField(x, BinaryType()) for x in "abcd"])
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("head", pa.bool_())] + [(x, pa.binary()) for x in "abcd"])
FRAGMENT_KEYS = 2_000_000
KEY_BYTES = 6  # of a key beyond the bits that its fragment already says


def fragment_bits(docs: DataFrame) -> int:
    """So many leading bits of a key name its fragment: from the size of all texts, taking six bytes to a key."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(16, max(3, math.ceil(math.log2(max(1, size / 6 / FRAGMENT_KEYS)))))


def block_number(count: int) -> int:
    """The same when a task runs again: its partition, and how many blocks came before."""
    return TaskContext.get().partitionId() << 32 | count


def packed(rows: list[tuple]) -> pa.RecordBatch:
    rows = [(*r, *[None] * (7 - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)] if rows else
                                      [pa.array([], t) for t in _ARROW.types], schema=_ARROW)


def packed_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([packed(rows)], schema=_ARROW)


def pack_ascending(x: np.ndarray) -> bytes:
    """Ascending numbers as differences, which compress."""
    return np.diff(x, prepend=0).astype("<u4").tobytes()


def unpack_ascending(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, "<u4"), dtype=np.int64)


def pack_keys(keys: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray((keys << np.uint64(bits) >> np.uint64(64 - 8 * KEY_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def unpack_keys(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def by_fragment(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The slices of ascending keys that fall into each fragment."""
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = [0, *edges.tolist(), len(keys)]
    for part, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            yield part, slice(a, b)


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(ordered)))


def distinct_with_owner(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys; their owner's number plus 1, or 0 if several hold the key; and a mask of the given
    entries whose key several hold."""
    order = np.argsort(keys, kind="stable")
    starts, lengths = runs(keys[order])
    several = lengths > 1
    mask = np.zeros(len(keys), bool)
    mask[order[np.repeat(several, lengths)]] = True
    return keys[order[starts]], np.where(several, 0, owners[order[starts]] + 1), mask


def to_fragments(block: int, keys: np.ndarray, owners: np.ndarray, bits: int) -> Iterator[tuple]:
    """Packed rows for ascending distinct keys with their owners, each fragment's by owner."""
    for part, s in by_fragment(keys, bits):
        order = np.argsort(owners[s], kind="stable")
        yield part, block, False, pack_keys(keys[s][order], bits), pack_ascending(owners[s][order])


def answer_repeated(rows: pa.Table) -> pa.Table:
    """For one fragment: per block the owners, ascending, of its keys that other blocks hold too. Heads pass."""
    out, keys, owners, blocks = [], [], [], []
    for r in rows.to_pylist():
        if r["head"]:
            out.append((r["part"], r["block"], True, r["a"], r["b"], r["c"], r["d"]))
        else:
            keys.append(unpack_keys(r["a"]))
            owners.append(unpack_ascending(r["b"]))
            blocks.append((r["part"], r["block"]))
    if keys:
        sizes = [len(k) for k in keys]
        all_ = np.concatenate(keys)
        order = np.argsort(all_, kind="stable")
        _, lengths = runs(all_[order])
        shared = np.zeros(len(all_), bool)
        shared[order[np.repeat(lengths > 1, lengths)]] = True
        for (part, block), own, hit in zip(blocks, owners, np.split(shared, np.cumsum(sizes)[:-1])):
            hits = own[hit & (own > 0)]
            if len(hits):
                out.append((part, block, False, pack_ascending(hits)))
    return packed_table(out)


def repeated(docs: DataFrame, emit, merge, schema) -> DataFrame:
    """``emit`` gives packed rows of blocks (one head each); ``merge`` gets a block's head and the answers to it."""
    sent = docs.mapInArrow(emit, PACKED)
    answered = sent.groupBy("part").applyInArrow(answer_repeated, PACKED)
    return answered.groupBy("block").applyInArrow(merge, schema)


def head_and_answers(rows: pa.Table) -> tuple[dict, list[dict]]:
    parts = rows.to_pylist()
    return next(r for r in parts if r["head"]), sorted((r for r in parts if not r["head"]), key=lambda r: r["part"])
