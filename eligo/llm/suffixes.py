"""Repeated passages by a fingerprint join over sparse suffixes.

A passage is repeated if all its words lie in stretches of MIN_WORDS words that another document holds too. Of a text's
suffixes only those at minimisers are kept: in every stretch the place, among its first PLACES, whose few words hash
least, the first of equals. The choice depends on the words alone, so both occurrences of a stretch keep the same place,
and their suffixes there agree for at least MIN_WORDS - PLACES + 1 words.

1. Kept suffixes meet in fragments by a hash of these words, which stands for their order, since only equal words
   matter and hashes are less to move; equal hashes from different documents are candidates. A fragment gets each suffix once per block, whatever number of documents holds it.
2. Each candidate stands for every whole stretch that chose it, and the stretches are compared by their hashes the same
   way. Overlapping and touching stretches make one passage.

Words are runs of anything but ASCII white space, A-Z lower-cased. Null, empty and shorter texts hold no passage. A
repetition inside one document does not count; repeated rows are documents of their own, also with the same doc_id. An
empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.llm.common import chunks, mix, ngrams, words
from eligo.llm.fragments import (block_number, distinct_with_owner, fragment_bits, head_and_answers, pack_ascending, packed,
                                 repeated, to_fragments, unpack_ascending)
from eligo.session import cut_lineage

c = F.col

MIN_WORDS = 50
PLACES = 10
GRAM = 5
NO_ID = np.iinfo(np.int64).min
_ODD = np.uint64(0x9E3779B97F4A7C15)


def stretches(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words at each word that has n - 1 after it, from hashes of halves."""
    size = max(0, len(h) - n + 1)
    out, at, part, width = np.zeros(size, np.uint64), 0, h, 1
    while True:
        if n & width:
            out = mix(out * _ODD ^ part[at:at + size])
            at += width
        if width * 2 > n:
            return out
        part = mix(part[:-width] * _ODD ^ part[width:])
        width *= 2


def choices(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every stretch inside a text, and the place it chooses."""
    if len(h) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.arange(len(h) - MIN_WORDS + 1)
    starts = starts[starts + MIN_WORDS <= first[own[starts] + 1]]
    grams = ngrams(h, GRAM)
    least = np.lib.stride_tricks.sliding_window_view(grams, PLACES)
    out = np.empty(len(starts), np.int64)
    for at in range(0, len(starts), 1 << 18):
        some = starts[at:at + (1 << 18)]
        out[at:at + (1 << 18)] = some + least[some].argmin(axis=1)
    return starts, out


def _send(block: int, ids: np.ndarray, docs: np.ndarray, at: np.ndarray, keys: np.ndarray, texts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The head (ids, text keys, and each item's document, place and number of its key, or 0 if the block itself has the
    key in several documents) and the distinct keys of a block, given items in order of document and place."""
    if len(keys):
        distinct, back = np.unique(keys, return_inverse=True)
        pairs = np.unique(np.stack([back, docs]), axis=1)[0]
        several = np.bincount(pairs, minlength=len(distinct)) > 1
        number = np.where(several, 0, np.arange(1, len(distinct) + 1))
    else:
        distinct, back, number = keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    per_doc = np.bincount(docs, minlength=len(ids))
    yield packed([(block % (1 << bits), block, True, np.stack([ids, texts, per_doc], 1).astype("<i8").tobytes(),
                   at.astype("<u4").tobytes(), number[back].astype("<u4").tobytes())])
    for row in to_fragments(block, distinct, number, bits):
        yield packed([row])


def _hits(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From a block's head and answers: the document table, and document and place of the items that are repeated."""
    head, answers = head_and_answers(rows)
    table = np.frombuffer(head["a"], "<i8").reshape(-1, 3)
    at, number = np.frombuffer(head["b"], "<u4").astype(np.int64), np.frombuffer(head["c"], "<u4").astype(np.int64)
    found = np.zeros(int(number.max(initial=0)) + 1, bool)
    found[0] = True
    for r in answers:
        found[unpack_ascending(r["a"])] = True
    hit = found[number]
    return table, np.repeat(np.arange(len(table)), table[:, 2])[hit], at[hit]


def _kept(bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for count, chunk in enumerate(chunks(batches, "text")):
            h, first = words(chunk.column("text"))
            kept = np.unique(choices(h, first)[1])
            docs = np.searchsorted(first, kept, side="right") - 1
            keys = stretches(h, MIN_WORDS - PLACES + 1)[kept]
            yield from _send(block_number(count), _ids(chunk), docs, kept - first[docs], keys, _texts(chunk), bits)
    return emit


def _candidates(rows: pa.Table) -> pa.Table:
    table, docs, at = _hits(rows)
    some, begin = np.unique(docs, return_index=True)
    return pa.table({"doc_id": pa.array(table[some, 0], mask=table[some, 0] == NO_ID), "text_key": table[some, 1],
                     "at": pa.array([x.astype("<u4").tobytes() for x in np.split(at, begin[1:])] if len(some) else [], pa.binary())})


def _whole(bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for count, chunk in enumerate(chunks(batches, "text")):
            h, first = words(chunk.column("text"))
            starts, place = choices(h, first)
            flags = np.zeros(len(h) + 1, bool)
            for i, at in enumerate(chunk.column("at").to_pylist()):
                flags[first[i] + np.frombuffer(at, "<u4")] = True
            starts = starts[flags[place]]
            docs = np.searchsorted(first, starts, side="right") - 1
            keys = stretches(h, MIN_WORDS)[starts]
            yield from _send(block_number(count), _ids(chunk), docs, starts - first[docs], keys, _texts(chunk), bits)
    return emit


def _passages(rows: pa.Table) -> pa.Table:
    table, docs, at = _hits(rows)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (at[1:] > at[:-1] + MIN_WORDS)
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(at))[:len(begin)] - 1
    ids = table[docs[begin], 0] if len(begin) else np.zeros(0, np.int64)
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "start_word": pa.array(at[begin], pa.int64()),
                     "n_words": pa.array(at[last] - at[begin] + MIN_WORDS, pa.int64())})


def _ids(chunk: pa.RecordBatch) -> np.ndarray:
    return chunk.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _texts(chunk: pa.RecordBatch) -> np.ndarray:
    return chunk.column("text_key").to_numpy(zero_copy_only=False)


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word (from 0) and n_words of every repeated passage."""
    bits = fragment_bits(docs)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = cut_lineage(repeated(docs, _kept(bits), _candidates, "doc_id long, text_key long, at binary").distinct(), "suffix-candidates")
    found = found.select(c("doc_id").alias("_id"), c("text_key").alias("_key"), "at")
    met = docs.join(found.hint("shuffle_hash"), c("doc_id").eqNullSafe(c("_id")) & (c("text_key") == c("_key"))).select(
        "doc_id", "text", "text_key", "at")
    return repeated(met, _whole(bits), _passages, "doc_id long, start_word long, n_words long")
