r"""Chat formatting at the level of tokens, and reading it back.

A turn is  <s> role [INST] text [/INST] </s> ; the four marks are reserved ids after the vocabulary's own. Role and text are
encoded separately, with no special tokens, so no text can produce a reserved id. In the formatted text the marks are
strings, so control strings occurring in a role or text are escaped: a backslash goes in after their first character, and
every backslash of the text is doubled. Unescaping drops the first of two backslashes and every single one, which gives
back every text.

Segment lengths add up to offsets, and the loss mask (the tokens of assistant texts) is the running sum of +1 at a
segment's start and -1 at its end. A conversation is written in parts of whole turns, at most PART_TOKENS tokens unless one
turn has more, so that a conversation of any length streams through in bounded memory; its digests are sequential by
nature and made in one task.

Turns are in order of (turn, role, text); repeated rows are turns of their own. Null text and null role are read as empty;
rows with a null conv_id are one conversation. An empty table gives an empty table. Only these four columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public splitting pattern that belongs to these ranks.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARKS = ("<s>", "[INST]", "[/INST]", "</s>")  # turn, text, end of text, end of turn
CONTROL = (*MARKS, "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
PART_TOKENS = 65_536

_TO_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Coder:
    """The byte-level vocabulary, and the reserved ids after it."""

    _made: dict[int, Coder] = {}  # of this Python worker

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.coder = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.turn, self.text, self.end_text, self.end_turn = range(len(table), len(table) + 4)

    @classmethod
    def of(cls, ranks: bytes) -> Coder:
        key = hash(ranks)
        if key not in cls._made:
            cls._made[key] = cls(ranks)
        return cls._made[key]

    def decode(self, ids: np.ndarray) -> str:
        return self.coder.decode_bytes(ids.tolist()).decode()


def load_ranks(path: str = RANKS) -> bytes:
    """The vocabulary file, read where the job starts and sent with its tasks (its size does not depend on the data)."""
    with open(path, "rb") as f:
        return f.read()


def _encode(ranks: bytes):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(ranks).coder
        for b in batches:
            roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
            ids = [[coder.encode_ordinary(escape(x)) for x in column] for column in (roles, texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.list_(pa.int32())) for x in ids)],
                                             names=[*b.schema.names, "role_ids", "text_ids"])
    return encode


def _part(turns: list[tuple], coder: Coder, loss_role: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of some turns (role, role ids, text ids)."""
    segments, loss = [], []
    for role, role_ids, text_ids in turns:
        segments += [[coder.turn], role_ids, [coder.text], text_ids, [coder.end_text, coder.end_turn]]
        loss += [False, False, False, role == loss_role, False]
    lengths = np.array([len(s) for s in segments])
    ends = np.cumsum(lengths)
    steps = np.zeros(ends[-1] + 1, np.int64)
    np.add.at(steps, (ends - lengths)[loss], 1)
    np.add.at(steps, ends[loss], -1)
    return np.concatenate([np.asarray(s, np.int32) for s in segments]), np.cumsum(steps)[:-1] > 0


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Rows with the null key as None, so that equal keys are equal."""
    for b in batches:
        keys = [None if pd.isna(k) else int(k) for k in b["conv_id"]]
        yield from zip(keys, *(b[x] for x in b.columns if x != "conv_id"))


def _assemble(ranks: bytes, loss_role: str):
    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder.of(ranks)

        def row(conv, part, first, turns):
            ids, mask = _part(turns, coder, loss_role)
            return pd.DataFrame({"conv_id": pd.array([conv], "Int64"), "part": [part], "first_token": [first], "ids": [ids], "loss": [mask]})

        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            part, first, size, turns = 0, 0, 0, []
            for _, role, role_ids, text_ids in rows:
                more = len(role_ids) + len(text_ids) + 4
                if turns and size + more > PART_TOKENS:
                    yield row(conv, part, first, turns)
                    part, first, size, turns = part + 1, first + size, 0, []
                turns.append((role, role_ids, text_ids))
                size += more
            yield row(conv, part, first, turns)
    return assemble


def format_conversations(conversations: DataFrame, ranks: bytes, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, part, first_token, ids and loss (a boolean per id) of every conversation, in parts of whole turns."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    coded = turns.mapInArrow(_encode(ranks), "conv_id long, turn long, role string, text string, role_ids array<int>, text_ids array<int>")
    ordered = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "role_ids", "text_ids").mapInPandas(
        _assemble(ranks, loss_role), "conv_id long, part long, first_token long, ids array<int>, loss array<boolean>")


def _read(ranks: bytes):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, out = Coder.of(ranks), []
        for conv, parts in groupby(_rows(batches), key=lambda r: r[0]):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, ids, mask in parts:
                ids, mask = np.asarray(ids), np.asarray(mask, bool)
                for a, b, e in zip(*(np.flatnonzero(ids == x) for x in (coder.turn, coder.text, coder.end_text))):
                    role, text = coder.decode(ids[a + 1:b]), coder.decode(ids[b + 1:e])
                    chars += len(role) + len(text) + sum(map(len, MARKS))
                    turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    n += 1
                # masked ids run together only inside a text, so each run is one text
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                for a, b in zip(edges[::2], edges[1::2]):
                    text = unescape(coder.decode(ids[a:b]))
                    loss.update(text.encode())
                    loss_chars += len(text)
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) == 10_000:
                yield _digest_rows(out)
                out = []
        if out:
            yield _digest_rows(out)
    return read


def _digest_rows(rows: list[tuple]) -> pd.DataFrame:
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})


def read_back(formatted: DataFrame, ranks: bytes) -> DataFrame:
    """Per conversation what its ids and mask say: turns, loss text, and the length of the formatted text."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.select("conv_id", "ids", "loss").mapInPandas(
        _read(ranks), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def rendered(ids: np.ndarray, coder: Coder) -> str:
    """The formatted text of ids, with the marks as strings."""
    names, out, at = dict(zip((coder.turn, coder.text, coder.end_text, coder.end_turn), MARKS)), [], 0
    for i in np.flatnonzero(ids >= coder.turn).tolist():
        out += [coder.decode(ids[at:i]), names[int(ids[i])]]
        at = i + 1
    return "".join(out) + coder.decode(ids[at:])
