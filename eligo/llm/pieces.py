"""SentencePiece encoding and decoding: batched Viterbi search over a given vocabulary.

A text gets a space in front and spaces stand for the piece mark. A text may be cut between two characters that no piece has
side by side (such as before each run of spaces); the units are searched once each, all units of one length advancing together.
Substring hashes are looked up in the sorted hashes of the pieces, and the best way to every position is kept with a
backpointer (ties: the longer last piece). Found units stay in a cache of bounded size.

For a vocabulary of the unigram kind the best way has the largest sum of scores. For one of the merge (BPE) kind, such as
the shipped one, scores are merge ranks, whose sum means nothing; there a step is allowed only if the merges of its two
pieces would not run across their border, and the one allowed way is the merge order's result. Units for which that
leaves no single way, which can only be where a piece's parts rank after it, are merged one by one.

Characters without a piece become byte pieces, so that decoding gives back every text exactly; the mark itself, occurring
in a text, is spelled in bytes too (other processors would give back a space).

Null gives null, the empty text no ids. Repeated rows need no rule. An empty table gives an empty table. Columns of the
input stay; the new column takes the name given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from eligo.llm.common import chunks, hash_spans, mix, ragged, text_bytes

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
CHUNK = 2 << 20
CACHE_UNITS = 1_000_000
BORDER_SLOTS = 1 << 21
_BASE = np.uint64(0x9E6C63D0876A9A47)  # odd, so it has an inverse among 64-bit numbers
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MARK_IN_TEXT = np.uint32(0x110000)  # not a code point: the mark where a text has it


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as arrays: small (it is as large as the model file), sent with each task."""

    keys: np.ndarray  # ascending hashes of the pieces that text can match
    ids: np.ndarray  # their ids
    scores: np.ndarray  # their scores, float32
    longest: int  # code points of the longest piece
    unknown_score: np.float32
    merges: bool  # of the merge kind; then also, by place in keys:
    hashes_power: np.ndarray  # base to the number of code points
    left: np.ndarray  # places of the two parts that merge into a piece last, -1 for a character
    right: np.ndarray
    time: np.ndarray  # the rank at which it is formed: the largest of its own and its parts' times
    byte_ids: np.ndarray  # 256 ids
    pool: np.ndarray  # the bytes that the ids decode to, one after the other
    starts: np.ndarray  # where each id's bytes begin, and the end
    cuts: np.ndarray  # for each pair of bytes (first * 256 + second), whether no piece can hold it

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        with open(path, "rb") as f:
            merges = _model_kind(f.read()) == 2
        return cls.of([names[i] for i in plain], [model.get_score(i) for i in plain], plain,
                      {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}, size, merges)

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], ids: list[int], byte_ids: dict[int, int], size: int,
           merges: bool = False) -> Vocabulary:
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary must have all byte pieces, or texts could not be decoded")
        if merges:  # pieces that the merges of their own characters do not form can never occur
            rank = {p: -s for p, s in zip(pieces, scores)}
            formed = [(p, s, i, m) for p, s, i in zip(pieces, scores, ids) if (m := _last_merge(p, rank)) is not None]
            pieces, scores, ids, parts = ([f[k] for f in formed] for k in range(4))
        hashes = np.array([_hashes(_points(p)[None, :])[0, -1] for p in pieces], np.uint64)
        order = np.argsort(hashes)
        power, (left, right), time = np.zeros(0, np.uint64), np.zeros((2, 0), np.int32), np.zeros(0)
        if merges:
            place = {pieces[j]: i for i, j in enumerate(order.tolist())}
            left, right = np.array([[place.get(x, -1) for x in parts[j]] for j in order.tolist()], np.int32).T
            by_size = sorted(range(len(order)), key=lambda i: len(pieces[order[i]]))
            time = -np.array(scores, np.float64)[order]
            for i in by_size:
                time[i] = max(time[i], *(time[x] for x in (left[i], right[i]) if x >= 0)) if left[i] >= 0 else -1
            power = _powers(max(map(len, pieces)))[0][[len(pieces[j]) for j in order.tolist()]]
        spelled = [b""] * size
        for i, p in zip(ids, pieces):
            spelled[i] = p.replace(MARK, " ").encode()
        for b, i in byte_ids.items():
            spelled[i] = bytes([b])
        return cls(hashes[order], np.array(ids, np.int32)[order], np.array(scores, np.float32)[order], max(map(len, pieces)),
                   np.float32(min(scores) - UNKNOWN_PENALTY), merges, power, left, right, time, np.array([byte_ids[b] for b in range(256)], np.int32),
                   np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in spelled])]), _cuts(pieces))


    @cached_property
    def id_of(self) -> dict[str, int]:
        """The id of each piece that text can match."""
        texts = (self.pool[a:b].tobytes().decode().replace(" ", MARK) for a, b in zip(self.starts[self.ids], self.starts[self.ids + 1]))
        return dict(zip(texts, self.ids.tolist()))

    @cached_property
    def rank(self) -> dict[str, float]:
        score = dict(zip(self.ids.tolist(), self.scores.tolist()))
        return {p: -score[i] for p, i in self.id_of.items()}


def _cuts(pieces: list[str]) -> np.ndarray:
    """ASCII pairs that no piece has next to each other; the mark counts as a space. Other bytes are never cut at."""
    cuts = np.zeros((256, 256), bool)
    cuts[:128, :128] = True
    for p in pieces:
        b = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8)
        cuts[b[:-1], b[1:]] = False
    return cuts.ravel()


def _model_kind(model: bytes) -> int:
    """The model_type of the trainer_spec in a model file: 1 unigram, 2 merges."""
    def fields(data: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                byte = data[at]
                at += 1
                out |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return out

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                size = {1: 8, 5: 4}.get(tag & 7) or number()
                yield tag >> 3, data[at:at + size]
                at += size

    return next((kind for field, spec in fields(model) if field == 2 for name, kind in fields(spec) if name == 3), 1)


def merged(symbols: list[str], rank: dict[str, float]) -> tuple[list[str], tuple[str, str]]:
    """What repeated merging of the best-ranked neighbours (the leftmost of equals) makes of symbols, and the last merge."""
    last = ("", "")
    while len(symbols) > 1:
        best, at = min((rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
        if best == np.inf:
            break
        last = (symbols[at], symbols[at + 1])
        symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2:]]
    return symbols, last


def _last_merge(piece: str, rank: dict[str, float]) -> tuple[str, str] | None:
    symbols, last = merged(list(piece), rank)
    return last if len(symbols) == 1 else None


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x))]).astype(np.uint64) for x in (_BASE, _INVERSE))


def _hashes(points: np.ndarray) -> np.ndarray:
    """Prefix sums, one column more than points, whose differences times inverse powers are hashes of substrings."""
    power, _ = _powers(points.shape[1])
    terms = mix(points.astype(np.uint64) + np.uint64(1)) * power[:-1]
    return np.concatenate([np.zeros((len(points), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)


def stays_apart(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the merges that form pieces a and b, side by side, never run across their border.

    Going back in time: as long as the symbols at the border are a and b, their own merge would come at its rank; it
    happens if that is before either is merged with its other neighbour (of equals the leftmost comes first)."""
    apart, todo = np.ones(len(a), bool), np.arange(len(a))
    rank = -v.scores.astype(np.float64)
    until_a, until_b = np.full((2, len(a), 2), np.inf)  # time and rank of the merge that takes a, and b
    while len(todo):
        wanted = v.keys[a] + v.keys[b] * v.hashes_power[a]
        at = np.minimum(np.searchsorted(v.keys, wanted), len(v.keys) - 1)
        r = np.where(v.keys[at] == wanted, rank[at], np.inf)
        t = np.maximum(r, np.maximum(v.time[a], v.time[b]))
        crosses = np.isfinite(r) & ((t < until_a[:, 0]) | ((t == until_a[:, 0]) & (r < until_a[:, 1]))) & (
            (t < until_b[:, 0]) | ((t == until_b[:, 0]) & (r <= until_b[:, 1])))
        apart[todo[crosses]] = False
        whole = (v.left[a] < 0) & (v.left[b] < 0)
        go = ~crosses & ~whole
        todo, a, b, until_a, until_b = todo[go], a[go], b[go], until_a[go], until_b[go]
        back_a = (v.left[b] < 0) | ((v.left[a] >= 0) & (v.time[a] > v.time[b]))
        until_a = np.where(back_a[:, None], np.stack([v.time[a], rank[a]], 1), until_a)
        until_b = np.where(back_a[:, None], until_b, np.stack([v.time[b], rank[b]], 1))
        a, b = np.where(back_a, v.right[a], a), np.where(back_a, b, v.left[b])
    return apart


class Borders:
    """Remembers answers of stays_apart(), one per slot; a pair that falls on another's slot takes its place."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pairs, self.apart = np.full(BORDER_SLOTS, -1, np.int64), np.zeros(BORDER_SLOTS, bool)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs = a.astype(np.int64) << 32 | b
        slots = (mix(pairs.astype(np.uint64)) % np.uint64(BORDER_SLOTS)).astype(np.int64)
        out, new = self.apart[slots], self.pairs[slots] != pairs
        if new.any():
            fresh, back = np.unique(pairs[new], return_inverse=True)
            answers = stays_apart(self.vocabulary, fresh >> 32, fresh & 0xFFFFFFFF)[back]
            out[new], self.pairs[slots[new]], self.apart[slots[new]] = answers, pairs[new], answers
        return out


def viterbi(points: np.ndarray, vocabulary: Vocabulary, borders: Borders | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best pieces of words of one length (a row each): their places in the vocabulary's keys, -1 for a character
    without a piece, and code points of each piece, both right-aligned in rows as long as the words, 0 points where no
    piece is; and whether the way was the only one allowed (always, by scores)."""
    count, n = points.shape
    sums, (_, inverse) = _hashes(points), _powers(n)
    longest = min(vocabulary.longest, n)
    places = np.full((longest, count, n), -2, np.int32)  # by length - 1, word, start; -2: no way
    for k in range(1, longest + 1):
        wanted = (sums[:, k:] - sums[:, :-k]) * inverse[:n - k + 1]
        at = np.minimum(np.searchsorted(vocabulary.keys, wanted), len(vocabulary.keys) - 1)
        places[k - 1, :, :n - k + 1] = np.where(vocabulary.keys[at] == wanted, at, -1 if k == 1 else -2)
    best, back = np.zeros((count, n + 1), np.float32), np.zeros((count, n + 1), np.int32)
    last, only = np.full((count, n + 1), -1, np.int32), np.ones(count, bool)
    for end in range(1, n + 1):
        lengths = np.arange(min(longest, end), 0, -1)  # the longest first, and so first among equals
        place, before = places[lengths - 1, :, end - lengths].T, last[:, end - lengths]
        if borders is None:
            score = np.where(place >= 0, vocabulary.scores[place], np.where(place == -1, vocabulary.unknown_score, -np.inf))
            options = best[:, end - lengths] + score
        else:
            allowed = place >= -1
            ask = (place >= 0) & (before >= 0)
            allowed[ask] = borders(before[ask], place[ask])
            options = np.where(allowed, np.float32(0), -np.inf)
            only &= allowed.sum(1) == 1
        choice = options.argmax(axis=1)[:, None]
        best[:, end] = np.take_along_axis(options, choice, 1)[:, 0]
        last[:, end] = np.take_along_axis(place, choice, 1)[:, 0]
        back[:, end] = lengths[choice[:, 0]]
    out, width = np.full((count, n), -1, np.int32), np.zeros((count, n), np.int32)
    rows, end, slot = np.arange(count), np.full(count, n), n - 1
    while len(rows):
        k = back[rows, end]
        out[rows, slot], width[rows, slot] = last[rows, end], k
        end, slot = end - k, slot - 1
        rows, end = rows[end > 0], end[end > 0]
    return out, width, only


def _search(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary, borders: Borders | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units (byte spans), one unit after the other, and how many each has."""
    text = data[ragged(starts, ends - starts)]
    points = _points(text.tobytes().decode()).copy()
    cuts = np.cumsum(ends - starts)
    first = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])[np.concatenate([[0], cuts])]
    first, sizes = first[:-1], np.diff(first)
    points[points == ord(MARK)] = _MARK_IN_TEXT
    points[points == 32] = ord(MARK)
    units, ids, counts = [], [], []  # in the order of search
    for n in np.unique(sizes).tolist():
        group = np.flatnonzero(sizes == n)
        step = max(1, 1_000_000 // (n * min(n, vocabulary.longest)))  # bounds the tables of one search
        for some in np.split(group, range(step, len(group), step)):
            place, width, only = viterbi(points[first[some][:, None] + np.arange(n)], vocabulary, borders)
            use = width > 0
            plain = only & ~((place < 0) & use).any(1)
            units.append(some[plain])
            ids.append(vocabulary.ids[place[plain][use[plain]]])
            counts.append(use[plain].sum(1))
            for row in np.flatnonzero(~plain).tolist():
                i = some[row]
                word = data[starts[i]:ends[i]].tobytes().decode()
                at = width[row][use[row]] if only[row] else [len(x) for x in merged(_marked(word), vocabulary.rank)[0]]
                spelled = _spell(word, np.cumsum(at), vocabulary)
                units.append([i]), ids.append(spelled), counts.append([len(spelled)])
    units, ids, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (units, ids, counts))
    order = np.argsort(units)
    at = np.cumsum(counts) - counts
    return ids[ragged(at[order], counts[order])].astype(np.int32), counts[order]


def _marked(word: str) -> list[str]:
    return list(word.replace(MARK, chr(0x10FFFF)).replace(" ", MARK))


def _spell(word: str, cuts: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Ids of a word cut at ``cuts``, parts without a piece in bytes."""
    marked, out, at = "".join(_marked(word)), [], 0
    id_of = vocabulary.id_of
    for end in cuts.tolist():
        piece = id_of.get(marked[at:end])
        out.extend([piece] if piece is not None else vocabulary.byte_ids[np.frombuffer(word[at:end].encode(), np.uint8)].tolist())
        at = end
    return np.array(out, np.int32)


class Encoder:
    """Encodes batches of texts, remembering units up to CACHE_UNITS."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.borders = vocabulary, Borders(vocabulary) if vocabulary.merges else None
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, data, starts, ends, hashes) -> None:
        if len(self.hashes) + len(hashes) > CACHE_UNITS:
            self._forget()
        ids, count = _search(data, starts, ends, self.vocabulary, self.borders)
        at = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        all_ = np.concatenate([self.hashes, hashes])
        order = np.argsort(all_)
        self.hashes, self.at, self.count = all_[order], np.concatenate([self.at, at])[order], np.concatenate([self.count, count])[order]

    def __call__(self, texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        full = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][full], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        begin = np.zeros(len(data), bool)
        begin[1:] = self.vocabulary.cuts[data[:-1].astype(np.uint16) << 8 | data[1:]]
        begin[offsets[:-1][full]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        hashes = hash_spans(data, starts, ends - starts)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        if len(self.hashes) + new.sum() > CACHE_UNITS:
            self._forget()
            new[:] = True
        if new.any():
            self._learn(data, starts[where[new]], ends[where[new]], distinct[new])
        unit = np.searchsorted(self.hashes, distinct)[back]
        count = self.count[unit]
        ids = self.ids[ragged(self.at[unit], count)]
        total = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, offsets)]
        out = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(ids, pa.int32()))
        return out if not texts.null_count else pa.ListArray.from_arrays(
            pa.array(total, pa.int32(), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False)), out.values)


def decode_batch(lists: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    """The texts: the pieces' bytes without the space that encoding put in front."""
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(vocabulary.starts)[ids]
    data = vocabulary.pool[ragged(vocabulary.starts[ids], lengths)]
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
    full = offsets[1:] > offsets[:-1]
    data = np.delete(data, offsets[:-1][full])
    offsets = (offsets - np.concatenate([[0], np.cumsum(full)])).astype(np.int32)
    texts = pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets), pa.py_buffer(data.tobytes()))
    return pa.array([None if n else t.as_py() for n, t in zip(lists.is_null().to_pylist(), texts)], pa.string()) if lists.null_count else texts


_encoders: dict[str, Encoder] = {}  # of this Python worker, by vocabulary


def _with_columns(docs: DataFrame, added: dict, column: str, limit: int, make) -> DataFrame:
    schema = StructType([*docs.schema.fields, *(StructField(n, kind) for n, kind in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, column, limit):
            yield pa.RecordBatch.from_arrays([*chunk.columns, *make(chunk.column(column))], names=[*chunk.schema.names, *added])

    return docs.mapInArrow(run, schema)


_IDS = ArrayType(IntegerType(), False)


def _encoder(vocabulary: Vocabulary):
    name = f"{hash(vocabulary.keys.tobytes())}-{hash(vocabulary.scores.tobytes())}"

    def of(texts: pa.Array) -> pa.Array:
        if name not in _encoders:
            _encoders[name] = Encoder(vocabulary)
        return _encoders[name](texts)

    return of


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as one more column ``to``, an array of int."""
    ids_of = _encoder(vocabulary)
    return _with_columns(docs, {to: _IDS}, text, CHUNK, lambda x: [ids_of(x)])


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", to: str = "text") -> DataFrame:
    """``docs`` with the text of ``ids`` as one more column ``to``."""
    return _with_columns(docs, {to: StringType()}, ids, CHUNK // 4, lambda x: [decode_batch(x, vocabulary)])


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", to: str = "ids", back: str = "decoded") -> DataFrame:
    """``docs`` with the ids of ``text`` and the text that these give again, in one pass: one Python worker a task, not two."""
    ids_of = _encoder(vocabulary)

    def both(texts: pa.Array) -> list[pa.Array]:
        ids = ids_of(texts)
        return [ids, decode_batch(ids, vocabulary)]

    return _with_columns(docs, {to: _IDS, back: StringType()}, text, CHUNK, both)


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gives the text back, for every document."""
    both = encode_and_decode(docs.select("doc_id", "text"), vocabulary)
    return both.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids",
                       F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))
