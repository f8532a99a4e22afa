r"""Repair of conversation structure by a parallel Viterbi search.

A repaired conversation's roles begin with the letters (s?(ua)+)?. Edits: keep a row (0), give it the role user or assistant
(2), delete it (3), insert an empty turn of user or assistant anywhere (2); a truncated row that is not deleted costs 1
more, blank and duplicate rows have to go. The cheapest edits are taken, of equally cheap ones those whose letters (D, I, K,
R) come first. Four states are enough: nothing yet, after the system turn, after a user, after an assistant.

Rows are sorted over the cluster by conversation and turn, so a conversation of any length lies in consecutive parts. In a
part, conversations are cut into chunks of CHUNK rows that are worked on side by side, from their ends: each chunk starts
from a speculative vector of costs to go, one entry for a state. Fix-up passes then start the chunks again from what the
chunk after them has found, until the new vector differs from the one found before by a constant only: all vectors before
that, and all edits they lead to, are the same. Stitched in this way the costs lead the tracing: every chunk is traced from
all four states, and the state in which the chunk before ends says which trace holds.

A conversation that goes on in the next part is a few numbers there: the costs from each state to each, found by the same
search from four unit vectors. At most one conversation crosses from a part to the next, so what the driver stitches
is bounded by the number of parts, not by rows.

Null turns come first, rows of one turn in order of (role, text). Null roles and texts are read as one space, and null
conv_ids are one conversation. Rows equal in everything are counted before they move: all but the first are duplicates (or
blank). Empty and very long texts are rows like others; texts are compared by their sha256. An empty table gives an empty
table. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.session import cut_lineage

c = F.col

CHUNK = 64
SPACE = r"\x20\x09-\x0D"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
S, U, A, OTHER = range(4)  # first letters of roles
START, SYSTEM, USER, ASSISTANT = range(4)  # states
NEXT = np.array([USER, USER, ASSISTANT, USER])  # by the one user or assistant turn that may follow
WANTED = np.array([U, U, A, U])
CLOSING = np.array([0, 2, 1, 0])  # turns still to insert at the end
REROLE, DELETE, INSERT = 2, 3, 2
FAR = 1 << 20
LETTERS = np.array(["D", "K", "R"])


# ---- costs to go of many chunks at once

def after_inserts(op: np.ndarray) -> np.ndarray:
    """Costs (rows, states) when up to two turns may be inserted first; more never pay."""
    return np.minimum(np.minimum(op, INSERT + op[:, NEXT]), 2 * INSERT + op[:, NEXT[NEXT]])


def row_costs(x: np.ndarray, fault: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one row in each chunk: costs of deleting, keeping and giving a role, from the costs to go after the row."""
    late = (fault == TRUNCATED).astype(np.int64)[:, None]
    onward = later[:, NEXT] + late
    kept = np.where(x[:, None] == WANTED, onward, FAR)
    kept[:, START] = np.where(x == S, later[:, SYSTEM] + late[:, 0], kept[:, START])
    forced = ((fault == BLANK) | (fault == DUPLICATE))[:, None]
    return later + DELETE, np.where(forced, FAR, kept), np.where(forced, FAR, onward + REROLE)


def least_costs(x: np.ndarray, fault: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Costs to go before a row of each chunk."""
    return np.minimum(after_inserts(np.minimum.reduce(row_costs(x, fault, later))), FAR)


def rooted(costs: np.ndarray) -> np.ndarray:
    """Each vector less its minimum."""
    return costs - costs.min(axis=-1, keepdims=True)


class Chunks:
    """The rows of one part in chunks that end at the same column; ``segment`` numbers the conversations, from 0 and in order."""

    def __init__(self, x: np.ndarray, fault: np.ndarray, segment: np.ndarray):
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        within = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
        first = np.flatnonzero(within % CHUNK == 0)  # row each chunk begins with
        size = np.diff(np.append(first, len(x)))
        self.width = int(size.max())
        self.head = self.width - size  # column each chunk begins in
        self.all = np.arange(len(first))
        self.segment = segment[first]
        self.more = np.append(self.segment[1:] == self.segment[:-1], False)  # the conversation goes on in the next chunk
        chunk = np.repeat(self.all, size)
        self.place = chunk, np.arange(len(x)) - first[chunk] + self.head[chunk]
        self.x, self.fault = np.zeros((2, len(first), self.width), np.int8)
        self.x[self.place], self.fault[self.place] = x, fault

    def search(self, ends: np.ndarray) -> np.ndarray:
        """Costs to go (chunks, columns + 1, states), each vector less its minimum, given those after every segment."""
        goal = rooted(np.where(self.more[:, None], CLOSING * INSERT, ends[self.segment]))  # speculative unless the segment ends here
        stage = np.full((len(self.all), self.width + 1, 4), -1, np.int32)
        open_ = self.all
        while len(open_):
            stage[open_, self.width] = goal[open_]
            rows, changed = open_, []
            for t in range(self.width - 1, -1, -1):
                new = rooted(least_costs(self.x[rows, t], self.fault[rows, t], stage[rows, t + 1].astype(np.int64)))
                differs = (new != stage[rows, t]).any(axis=1)  # by more than a constant
                rows = rows[differs]
                stage[rows, t] = new[differs]
                done = self.head[rows] == t
                changed.append(rows[done])
                rows = rows[~done]
                if not len(rows):
                    break
            before = np.concatenate(changed) - 1  # these end in another vector now
            before = before[before >= 0]
            before = before[self.more[before]]
            goal[before] = stage[before + 1, self.head[before + 1]]
            open_ = before[(goal[before] != stage[before, self.width]).any(axis=1)]
        return stage

    def trace(self, stage: np.ndarray, state: np.ndarray, note=None) -> np.ndarray:
        """The state in which each chunk ends if it begins in ``state``; ``note`` gets every column's inserts and edits."""
        state = state.copy()
        for t in range(self.width):
            rows = np.flatnonzero(self.head <= t)
            x, now = self.x[rows, t], state[rows]
            costs = row_costs(x, self.fault[rows, t], stage[rows, t + 1].astype(np.int64))
            best, at = after_inserts(np.minimum.reduce(costs)), np.arange(len(rows))
            inserts = np.zeros(len(rows), np.int8)
            for _ in range(2):
                goes = (costs[0][at, now] != best[at, now]) & (INSERT + best[at, NEXT[now]] == best[at, now])
                inserts += goes
                now = np.where(goes, NEXT[now], now)
            edit = np.where(costs[0][at, now] == best[at, now], 0, np.where(costs[1][at, now] == best[at, now], 1, 2))
            state[rows] = np.where(edit == 0, now, np.where((edit == 1) & (x == S), SYSTEM, NEXT[now]))
            if note:
                note(rows, t, inserts, edit)
        return state

    def ways(self, stage: np.ndarray) -> list[list[int]]:
        """Per chunk the state it ends in, for each state at its start."""
        return np.stack([self.trace(stage, np.full(len(self.all), s)) for s in range(4)], axis=1).tolist()

    def matrices(self, segments: list[int]) -> dict[int, np.ndarray]:
        """For each of ``segments`` the least cost from each state at its start to each state at its end, less the least of
        all: by unit vectors at the ends of its chunks, and the chunks' products."""
        rows = np.flatnonzero(np.isin(self.segment, segments))
        total = np.repeat(np.where(np.eye(4, dtype=bool), 0, FAR)[None], len(rows), axis=0)  # chunk, state at its end, at its start
        for t in range(self.width - 1, -1, -1):
            at = np.flatnonzero(self.head[rows] <= t)
            x, fault = (np.repeat(v[rows[at], t], 4) for v in (self.x, self.fault))
            total[at] = least_costs(x, fault, total[at].reshape(-1, 4)).reshape(-1, 4, 4)
        out = {}
        for i, s in zip(range(len(rows)), self.segment[rows].tolist()):
            own = total[i].T
            both = (out[s][:, :, None] + own[None]).min(axis=1) if s in out else own
            out[s] = np.where(both >= FAR, FAR, both - both.min())
        return out

    def maps(self, stage: np.ndarray) -> dict[int, list[int]]:
        """Per segment the state it ends in, for each state at its start."""
        out = {}
        for s, end in zip(self.segment.tolist(), self.ways(stage)):
            out[s] = [end[k] for k in out.get(s, range(4))]
        return out

    def edits(self, stage: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row the turns inserted before it and its edit, given each segment's first state; and each segment's last state."""
        last, begin = starts.copy(), np.zeros(len(self.all), np.int64)
        for i, (s, end) in enumerate(zip(self.segment.tolist(), self.ways(stage))):
            begin[i] = last[s]
            last[s] = end[last[s]]
        inserts, edit = np.zeros((2, len(self.all), self.width), np.int8)

        def note(rows, t, a, b):
            inserts[rows, t], edit[rows, t] = a, b

        self.trace(stage, begin, note)
        return inserts[self.place], edit[self.place], last


# ---- rows

def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults put in by a checksum of conv_id and turn."""
    one = F.lit(" ")
    key = F.concat(F.coalesce(c("conv_id").cast("string"), one), F.lit(":"), F.coalesce(c("turn").cast("string"), one))
    hit = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"), hit.alias("hit"))
    return rows.filter("hit <> 0").select(
        "conv_id", "turn", F.when(c("hit") == 4, "user").otherwise(c("role")).alias("role"),
        F.when(c("hit") == 1, "").when(c("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(c("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(c("hit") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """The written table of distinct rows with their number of copies; ``id`` is their order over all, ``part`` its first bits."""
    one = F.lit(" ")
    d = rows.select(c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"),
                    F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"))
    d = d.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    by = [c("conv_id").asc_nulls_first(), c("turn").asc_nulls_first(), c("role"), c("text")]
    placed = d.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id())
    return cut_lineage(placed.withColumn("part", F.shiftright("id", 33)), "repair-turns")


def with_faults(turns: DataFrame) -> DataFrame:
    """part, id, conv_id, x (first letter of the role) and fault of the first copy of every row; no texts."""
    first = F.substring("role", 1, 1)
    rows = turns.select(
        "part", "id", "conv_id", "role", F.sha2("text", 256).alias("key"),
        F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(OTHER).alias("x"),
        F.when(~c("text").rlike(f"[^{SPACE}]"), BLANK).when(~c("text").rlike(rf"[.!?][{SPACE}]*\z"), TRUNCATED).otherwise(NONE).alias("own"))
    said = rows.filter(c("own") != BLANK).groupBy("conv_id", "role", "key").agg(F.min("id").alias("_first"), F.count("*").alias("_n"))
    said = said.filter("_n > 1").select(*(c(k).alias(f"_{k}") for k in ("conv_id", "role", "key")), "_first")
    same = c("conv_id").eqNullSafe(c("_conv_id")) & (c("role") == c("_role")) & (c("key") == c("_key"))
    return rows.join(said, same, "left").select(
        "part", "id", "conv_id", "x", F.when((c("own") != BLANK) & (c("id") > c("_first")), DUPLICATE).otherwise(c("own")).alias("fault"))


# ---- parts

def _part(rows: pa.Table) -> tuple[np.ndarray, pa.Table, Chunks]:
    rows = rows.sort_by("id")
    null = rows.column("conv_id").is_null().to_numpy()
    conv = rows.column("conv_id").fill_null(0).to_numpy()
    fresh = np.ones(len(conv), bool)
    fresh[1:] = (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])
    segment = np.cumsum(fresh) - 1
    return segment, rows, Chunks(rows.column("x").to_numpy(), rows.column("fault").to_numpy(), segment)


def _ends(segment: np.ndarray, given: dict[int, list[int]]) -> np.ndarray:
    out = np.repeat((CLOSING * INSERT)[None, :], segment[-1] + 1, axis=0)
    for s, v in given.items():
        out[s] = v
    return out


def crossings(faults: DataFrame) -> dict[int, tuple[bool, bool]]:
    """Of parts whose first conversation began in an earlier part or whose last goes on in the next: which of both."""
    key = F.struct("conv_id")
    rows = faults.groupBy("part").agg(F.min_by(key, "id").alias("a"), F.max_by(key, "id").alias("b")).orderBy("part").collect()
    goes = [a["b"]["conv_id"] == b["a"]["conv_id"] for a, b in zip(rows, rows[1:])]
    both = zip(rows, [False, *goes], [*goes, False])
    return {r["part"]: (back, forth) for r, back, forth in both if back or forth}


def _stitched(faults: DataFrame) -> tuple[dict, dict, set]:
    """For the segments (part, number) that cross parts: costs to go after them, and their first state; and those that go on."""
    cross = crossings(faults)
    if not cross:
        return {}, {}, set()

    def of_crossing(numbers):
        """A row of numbers for each crossing segment of a part."""
        def rows(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py()
            back, forth = cross.get(part, (False, False))
            segment, _, chunks = _part(table)
            own = [0] * back + [int(segment[-1])] * (forth and not (back and segment[-1] == 0))
            found = numbers(part, segment, chunks, own) if own else []
            return pa.table({"part": pa.array([part] * len(own), pa.int64()), "segment": pa.array(own, pa.int64()),
                             "goes_on": pa.array([forth and s == segment[-1] for s in own], pa.bool_()),
                             "numbers": pa.array(found, pa.list_(pa.int64()))})
        kind = "part long, segment long, goes_on boolean, numbers array<long>"
        return sorted(faults.groupBy("part").applyInArrow(rows, kind).collect(), key=lambda r: (r.part, r.segment))

    def costs(part, segment, chunks, own):
        found = chunks.matrices(own)
        return [found[s].ravel().tolist() for s in own]

    after, nearer = {}, None
    for r in reversed(of_crossing(costs)):
        key, matrix = (r.part, r.segment), np.array(r.numbers).reshape(4, 4)
        after[key] = nearer if r.goes_on else (CLOSING * INSERT).tolist()
        nearer = rooted((matrix + np.array(after[key])).min(axis=1)).tolist()

    def ways(part, segment, chunks, own):
        maps = chunks.maps(chunks.search(_ends(segment, {s: after[part, s] for s in own})))
        return [maps[s] for s in own]

    starts, ends, goes_on = {}, START, set()
    for r in of_crossing(ways):
        key = (r.part, r.segment)
        starts[key] = ends if r.segment == 0 and cross[r.part][0] else START
        ends = r.numbers[starts[key]]
        if r.goes_on:
            goes_on.add(key)
    return after, starts, goes_on


def edits(faults: DataFrame) -> DataFrame:
    """conv_id, id, fault, inserts (turns inserted before the row), edit (D, K or R) and closing (turns inserted after a
    conversation's last row), given a written table of with_faults()."""
    after, starts, goes_on = _stitched(faults)

    def part_edits(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        segment, rows, chunks = _part(rows)
        ends = {0, int(segment[-1])}
        first = np.full(segment[-1] + 1, START)
        for s in ends:
            first[s] = starts.get((part, s), START)
        given = {s: after[part, s] for s in ends if (part, s) in after}
        inserts, edit, last = chunks.edits(chunks.search(_ends(segment, given)), first)
        closing = np.zeros(len(segment), np.int32)
        closing[np.flatnonzero(np.append(segment[1:] != segment[:-1], True))] = CLOSING[last]
        if (part, int(segment[-1])) in goes_on:
            closing[-1] = 0
        return pa.table({"conv_id": rows.column("conv_id"), "id": rows.column("id"), "fault": rows.column("fault"),
                         "inserts": inserts.astype(np.int32), "edit": pa.array(LETTERS[edit].tolist(), pa.string()), "closing": closing})

    return faults.groupBy("part").applyInArrow(part_edits, "conv_id long, id long, fault int, inserts int, edit string, closing int")


# ---- repaired turns

_TURNS = pa.schema([("conv_id", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                    ("fault", pa.int32()), ("turn", pa.int64()), ("was", pa.string())])
_BATCH_ROWS, _BATCH_CHARS = 10_000, 8 << 20


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(col.to_pylist() for col in b.columns))


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per edit, in order, from rows in order of (conv_id, id) whose edit comes right before their text."""
    out, chars = [], 0
    for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
        state, plan = START, None
        for _, _, _, fault, inserts, edit, closing, turn, role, text, copies in rows:
            if edit is not None:
                plan = fault, inserts, edit, closing
                continue
            fault, inserts, edit, closing = plan
            late = int(fault == TRUNCATED)
            for _ in range(inserts):
                out.append((conv, "I", INSERT, "assistant" if state == USER else "user", "", None, None, None))
                state = int(NEXT[state])
            if edit == "D":
                out.append((conv, "D", DELETE, None, None, fault, turn, role))
            elif edit == "K":
                out.append((conv, "K", late, role, text, fault, turn, role))
                state = SYSTEM if role[:1] == "s" else int(NEXT[state])
            else:
                out.append((conv, "R", REROLE + late, "assistant" if state == USER else "user", text, fault, turn, role))
                state = int(NEXT[state])
            chars += len(text)
            for _ in range(copies - 1):
                out.append((conv, "D", DELETE, None, None, BLANK if fault == BLANK else DUPLICATE, turn, role))
                if len(out) >= _BATCH_ROWS:
                    yield _batch(out, _TURNS)
                    out, chars = [], 0
            for _ in range(closing):
                out.append((conv, "I", INSERT, "assistant" if state == USER else "user", "", None, None, None))
                state = int(NEXT[state])
            if len(out) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                yield _batch(out, _TURNS)
                out, chars = [], 0
    if out:
        yield _batch(out, _TURNS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, edit, cost, role and text after it (null if deleted), and fault, turn and role (``was``) of the row edited
    (null if inserted): a row per edit, those of a conversation in one partition and in order."""
    turns = ordered(rows)
    found = edits(cut_lineage(with_faults(turns), "repair-faults"))
    plans = found.select("conv_id", "id", F.lit(0).alias("kind"), "fault", "inserts", "edit", "closing")
    empty = {"fault": "int", "inserts": "int", "edit": "string", "closing": "int"}
    texts = turns.select("conv_id", "id", F.lit(1).alias("kind"), *(F.lit(None).cast(t).alias(x) for x, t in empty.items()),
                         "turn", "role", "text", "copies")
    both = plans.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "id", "kind")
    return both.mapInArrow(_mended, "conv_id long, edit string, cost long, role string, text string, fault int, turn long, was string")


_AUDIT = pa.schema([("conv_id", pa.int64()), *((x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                    ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
        digest, letters, faults, total, lines = hashlib.sha256(), [], [0, 0, 0, 0], 0, 0
        low = high = before = None
        distinct = illegal = 0
        for _, edit, cost, role, text, fault, turn, was in rows:
            letters.append(edit)
            total += cost
            if edit != "D":
                digest.update(("\n" * (lines > 0) + f"{role}:{text}").encode())
                lines += 1
            if edit == "I":
                continue
            faults[fault] += 1
            illegal += before is not None and before + was[:1] not in ("su", "ua", "au")
            before = was[:1]
            if turn is not None and turn != high:
                low, high, distinct = turn if low is None else low, turn, distinct + 1
        gaps = 0 if low is None else high - low + 1 - distinct
        out.append((conv, gaps, *faults[1:], illegal, total, "".join(letters), digest.hexdigest()))
        if len(out) >= _BATCH_ROWS:
            yield _batch(out, _AUDIT)
            out = []
    if out:
        yield _batch(out, _AUDIT)


def audits(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """What ails each conversation of ``conversations`` in ``rows``, what its repair costs, the edits' letters, and a digest
    of the repaired turns. The digest of one conversation is sequential and streams through one task."""
    found = repaired(rows).mapInArrow(_audited, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                                "cost long, audit string, repaired_sha256 string")
    ids = conversations.select(c("conv_id").cast("long").alias("conv_id")).distinct()
    counts = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found.withColumnRenamed("conv_id", "_conv_id"), c("conv_id").eqNullSafe(c("_conv_id")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
