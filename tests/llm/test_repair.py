"""Conversation repair against a plain search over whole conversations."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eligo.llm import queries, repair
from tests.compare import connect, rows as cells

SOLID, DONE = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}  # last letter, next letter


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if not SOLID.search(text):
            out.append(1)
        elif (role, text) in seen:
            out.append(2)
        else:
            out.append(0 if DONE.search(text) else 3)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Least (cost, letters) over all edits, row by row; with them the repaired turns."""
    def inserted(best):
        for _ in range(3):
            for last, (cost, audit, turns) in list(best.items()):
                for role in ("user", "assistant"):
                    if (last, role[0]) in STEP:
                        put(best, STEP[last, role[0]], (cost + 2, audit + "I", (*turns, f"{role}:")))
        return best

    def put(best, last, found):
        if last not in best or found[:2] < best[last][:2]:
            best[last] = found

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, plain_faults(rows)):
        late, new = int(fault == 3), {}
        for last, (cost, audit, turns) in inserted(best).items():
            put(new, last, (cost + 3, audit + "D", turns))
            if fault in (1, 2):
                continue
            if (last, role[:1]) in STEP:
                put(new, STEP[last, role[:1]], (cost + late, audit + "K", (*turns, f"{role}:{text}")))
            for to in ("user", "assistant"):
                if (last, to[0]) in STEP:
                    put(new, STEP[last, to[0]], (cost + 2 + late, audit + "R", (*turns, f"{to}:{text}")))
        best = new
    return min(v for k, v in inserted(best).items() if k in ("", "a"))


def plain_audit(rows):
    """rows of one conversation: (turn, role, text), any of them None, in any order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, turns = plain_faults(rows), [t for t, _, _ in rows if t is not None]
    cost, audit, texts = plain_repair(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in (1, 2, 3)),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())


def by_chunks(x, fault, segment):
    chunks = repair.Chunks(np.array(x), np.array(fault), np.array(segment))
    ends = np.repeat((repair.CLOSING * repair.INSERT)[None], segment[-1] + 1, axis=0)
    inserts, edit, last = chunks.edits(chunks.search(ends), np.zeros(segment[-1] + 1, np.int64))
    letters = ["I" * i + "DKR"[e] for i, e in zip(inserts, edit)]
    return ["".join(a for a, s in zip(letters, segment) if s == k) + "I" * repair.CLOSING[last[k]] for k in range(segment[-1] + 1)]


LETTER = {"s": 0, "u": 1, "a": 2, "x": 3}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("suax"), st.integers(0, 3)), min_size=1, max_size=14), min_size=1, max_size=6), st.integers(1, 5))
def test_chunks_give_the_least_edits(conversations, size):
    rows = [(i, LETTER[x], f) for i, conv in enumerate(conversations) for x, f in conv]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(repair, "CHUNK", size)
        got = by_chunks([x for _, x, _ in rows], [f for _, _, f in rows], [i for i, _, _ in rows])
    for conv, audit in zip(conversations, got):
        texts = {0: "t{}.", 1: " ", 3: "t{}"}
        plain = []
        for n, (x, f) in enumerate(conv):
            if f == 2:  # said before: put an equal row in front
                plain += [(0, x, f"t{n}."), (0, x, f"t{n}.")]
            else:
                plain.append((0, x, texts[f].format(n)))
        if all(f != 2 for _, f in conv):
            assert audit == plain_repair(plain)[1]


@pytest.mark.parametrize("roles", ["s", "x", "uax", "suua", "ssssu"])
def test_searches_that_never_converge(monkeypatch, roles):
    """Vectors of rows that only get roles swap for ever, and rows that must go pass every vector on."""
    monkeypatch.setattr(repair, "CHUNK", 3)
    rows = [(0, roles[i % len(roles)], f"t{i}.") for i in range(80)]
    fault = [1 if 20 < i < 60 else 0 for i in range(80)]
    want = plain_repair([(t, r, " " if f else x) for (t, r, x), f in zip(rows, fault)])[1]
    assert by_chunks([LETTER[r] for _, r, _ in rows], fault, [0] * 80) == [want]


def odd_rows():
    rng = np.random.default_rng(3)
    roles, texts = ["user", "assistant", "system", None, "", "umpire", "User"], ["Yes.", "No", None, "", " \n", "Why?\x0b", "a.b", "é!"]
    rows = [(int(rng.integers(0, 40)), int(rng.integers(0, 9)) if rng.random() < 0.9 else None,
             roles[min(6, int(rng.exponential(1.2)))], f"{texts[rng.integers(0, 8)] or ''}") for _ in range(300)]
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (50, None, "user", "Hi."), (51, 7, "system", "Be."), (52, 1, "user", "x" * 200_000)]
    rows += [(53, i % 200, ["user", "assistant", "system"][i * i % 3], f"t{i * 7919 % 900}" + "." * (i % 3)) for i in range(1500)]  # crosses parts
    rows += [(54, i, "system", f"s{i}.") for i in range(300)] + [(55, 2, "user", "Same.")] * 400 + [(55, 3, "assistant", "Ok.")]
    return rows


def test_odd_rows_over_several_parts(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, id int, fault string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = repair.ordered(df)
        faults = repair.with_faults(turns)
        assert len(repair.crossings(faults)) > 2
        got = {r.conv_id: tuple(r)[1:] for r in repair.audits(df, df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == plain_audit([r[1:] for r in rows if r[0] == conv]), conv


def test_repaired_turns_are_whole(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "What?"), (1, 2, "user", "What?"), (2, 0, "user", " ")],
                               "conv_id long, turn long, role string, text string")
    got = [(r.conv_id, r.edit, r.cost, r.role, r.text, r.fault, r.was) for r in repair.repaired(df).collect()]
    assert sorted(got, key=lambda r: r[0]) == [
        (1, "I", 2, "user", "", None, None), (1, "K", 0, "assistant", "Hi.", 0, "assistant"), (1, "K", 0, "user", "What?", 0, "user"),
        (1, "D", 3, None, None, 2, "user"), (1, "I", 2, "assistant", "", None, None), (2, "D", 3, None, None, 1, "user")]


def test_query_equals_its_sql_with_nulls_and_lost_conversations(spark, tmp_path):
    con = connect("/root/testdata/sf0.01")
    rows = [(i, t, ["user", "assistant"][t % 2], f"Turn {t} of {i}.") for i in range(400) for t in range(i % 3 + 1)]
    rows += [(None, t, None, "A.") for t in range(5)] + [(500, None, "user", None), (500, None, "assistant", "B")]
    pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(tmp_path / "conversations.parquet")
    con.sql(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet'")
    query = queries.op13_conversation_repair(spark, str(tmp_path))
    wanted = con.sql(f"select * replace (cast(conv_id as varchar) as conv_id) from ({queries.SQL['op13_conversation_repair']})").df()
    assert cells(query.withColumn("conv_id", query.conv_id.cast("string")).toPandas()) == cells(wanted)
    assert query.filter("audit = ''").count() > 3  # all rows dropped


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.audits(repair.damage(none), none).count() == 0
