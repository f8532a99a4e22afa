"""What several operators share: columns by name, bounded batches, the words of texts as numbers.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. They are hashed eight bytes at a time,
whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 8 << 20  # text that one task works on at a time, unless a single document is longer
CHUNK_ROWS = 50_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column has them (column names ignore case)."""
    taken, out = {x.lower() for x in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and where each text begins (one more than texts). Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut at rows so that each holds about ``limit`` bytes (of a list: entries) of ``column``, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        if pa.types.is_list(values.type):
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False))])
        else:
            ends = text_bytes(values)[1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), start + CHUNK_ROWS, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix(lengths.astype(np.uint64) + _ODD)
    rows, at, left = slice(None), starts, lengths
    while len(left):
        h[rows] = mix(h[rows] * _ODD ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        rows = more if isinstance(rows, slice) else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of its first word (one more than texts)."""
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, bool)  # no word runs across edge i, which lies before byte i
    edge[1:-1] = space[:-1] | space[1:]
    edge[offsets] = True
    starts = np.flatnonzero(~space & edge[:-1])
    ends = np.flatnonzero(~space & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, and for each text the number of its first word (one more than texts)."""
    data, offsets = text_bytes(column)
    data = _FOLD[data]
    starts, ends, first = word_spans(data, offsets)
    return hash_spans(data, starts, ends - starts), first


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, at each word that has n - 1 after it (across texts; the caller cuts)."""
    size = max(0, len(h) - n + 1)
    out = np.full(size, np.uint64(n))
    for i in range(n):
        out = mix(out * _ODD ^ h[i:i + size]) if i == n - 1 else out * _ODD + (h[i:i + size] ^ (h[i:i + size] >> np.uint64(31)))
    return out
