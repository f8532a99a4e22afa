"""Exact n-gram Jaccard join by vertical partitioning, and the groups its links form.

A document's set is its distinct 5-word shingles (fewer words: the whole sequence as one; none: the empty set, which
links with nothing). Two documents link when 100 * intersection >= 75 * union.

1. Fragments of the n-gram order are counted separately: each says which n-grams of a block other blocks hold too, and the
   sums per document tell how many of its n-grams anybody shares. Fewer than three quarters: no link is possible.
2. Documents with equal sets are one class from here on; only one text of each is read again.
3. The order is refined to (number of classes that hold the n-gram, n-gram). Linked sets share one of their first
   n - ceil(0.75 n) + 1 n-grams in any such order, so only these are posted, without those nobody shares.
4. Members of a posting list are compared with one hub of the list, not with each other: the overlap is counted per
   fragment and summed per pair. Groups form, and a second round takes other hubs for lists that still span several groups.
5. Classes on lists that span several groups even then are gathered into families by the lists they share. A family is
   cut into blocks, and a task counts, fragment by fragment, the overlaps of all classes of two blocks as a matrix; only
   links between groups leave it. So no link is lost, and pairs are rows only for hubs and links.

Null and empty texts have the empty set. A repeated doc_id is one node per row; component_id is the smallest doc_id of the
group, null ids not counted unless there are only such. An empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.llm.common import chunks, free_names, mix, ngrams, words
from eligo.llm.fragments import (PACKED, block_number, by_fragment, distinct_with_owner, fragment_bits, head_and_answers,
                                 pack_keys, packed, packed_table, repeated, runs, to_fragments, unpack_ascending, unpack_keys)
from eligo.session import cut_lineage

c = F.col

N = 5
HOT = 1000
PERCENT = 75
ROUNDS = 2
SEGMENTS = 4  # fragments in which a pair's overlap is counted
BLOCK = 2048  # classes of a family that meet another such block in one task
COLUMNS = 2048  # shingles in a fragment of a block's matrix
NO_ID = np.iinfo(np.int64).min
_INFO = "doc_id long, n long, shared long, cls binary"


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending within a text, and how many each text has."""
    h, first = words(texts)
    count = np.diff(first)
    own = np.repeat(np.arange(len(count), dtype=np.int32), count)
    grams = ngrams(h, N)
    whole = np.arange(N, len(h) + 1) <= first[own[:len(grams)] + 1] if len(grams) else np.zeros(0, bool)
    keys, owners = grams[whole], own[:len(grams)][whole]
    edges = np.searchsorted(owners, np.arange(len(count) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        keys[a:b].sort()
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    keys, owners = keys[fresh], owners[fresh]
    short, sequences = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    for k in range(1, N):
        at = np.flatnonzero(count == k).astype(np.int32)
        if len(at):
            short.append(at)
            sequences.append(ngrams(h[(first[at][:, None] + np.arange(k)).ravel()], k)[::k])
    short = np.concatenate(short)
    where = np.searchsorted(owners, short)
    return np.insert(keys, where, np.concatenate(sequences)), np.bincount(np.insert(owners, where, short), minlength=len(count))


def classes_of(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """16 bytes that name each set: two sums of its mixed shingles."""
    ends = np.cumsum(sizes)
    sums = []
    for salt in (1, 2):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(keys ^ mix(np.full(1, salt, np.uint64))), dtype=np.uint64)])
        sums.append(mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)))
    return np.stack(sums, axis=1).astype("<u8")


def _emit(bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for count, chunk in enumerate(chunks(batches, "text")):
            block = block_number(count)
            keys, sizes = shingle_sets(chunk.column("text"))
            owners = np.repeat(np.arange(len(sizes)), sizes)
            distinct, owner, several = distinct_with_owner(keys, owners)
            ids = chunk.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            local = np.bincount(owners[several], minlength=len(sizes))
            yield packed([(block % (1 << bits), block, True, ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(),
                           local.astype("<u4").tobytes(), classes_of(keys, sizes).tobytes())])
            for row in to_fragments(block, distinct, owner, bits):
                yield packed([row])
    return emit


def _merge(rows: pa.Table) -> pa.Table:
    head, answers = head_and_answers(rows)
    ids, sizes = np.frombuffer(head["a"], "<i8"), np.frombuffer(head["b"], "<u4").astype(np.int64)
    shared = np.frombuffer(head["c"], "<u4").astype(np.int64)
    for r in answers:
        shared = shared + np.bincount(unpack_ascending(r["a"]) - 1, minlength=len(ids))
    return pa.table({"doc_id": pa.array(ids, mask=ids == NO_ID), "n": sizes, "shared": shared,
                     "cls": pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(head["d"])]).cast(pa.binary())})


def _needed(n):
    return (PERCENT * n + 99) // 100


def _pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of class texts: classes, sizes and all shingles."""
    for count, chunk in enumerate(chunks(batches, "text")):
        keys, sizes = shingle_sets(chunk.column("text"))
        names = classes_of(keys, sizes)
        wanted = np.frombuffer(b"".join(chunk.column("cls").to_pylist()), "<u8").reshape(-1, 2)
        keep = (names == wanted).all(1)  # a repeated doc_id may bring another text along
        keys = keys[np.repeat(keep, sizes)]
        yield packed([(0, block_number(count), True, names[keep].tobytes(), sizes[keep].astype("<u4").tobytes(), keys.tobytes())])


def _sets_to_fragments(bits: int):
    def emit(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys = np.sort(np.frombuffer(r["c"], "<u8"))
                starts, lengths = runs(keys)
                keys = keys[starts]
                for part, s in by_fragment(keys, bits):
                    yield packed([(part, r["block"], False, pack_keys(keys[s], bits), lengths[s].astype("<u4").tobytes())])
    return emit


def _answer_counts(rows: pa.Table) -> pa.Table:
    """For one fragment: per block, for each of its keys the number of classes that hold it, on a fine logarithmic scale."""
    rows = rows.to_pylist()
    keys, held = [unpack_keys(r["a"]) for r in rows], [np.frombuffer(r["b"], "<u4") for r in rows]
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.floor(1024 * np.log2(np.bincount(back, weights=np.concatenate(held))[back])).astype("<u2")
    cut = np.split(total, np.cumsum([len(k) for k in keys])[:-1])
    return packed_table([(r["part"], r["block"], False, t.tobytes()) for r, t in zip(rows, cut)])


def _post(rows: pa.Table) -> pa.Table:
    """The classes of a block that can still link: their shared shingles, and those of the refined order's beginning."""
    head, answers = head_and_answers(rows)
    sizes, keys = np.frombuffer(head["b"], "<u4").astype(np.int64), np.frombuffer(head["c"], "<u8")
    owners = np.repeat(np.arange(len(sizes)), sizes)
    _, back = np.unique(keys, return_inverse=True)
    held = np.frombuffer(b"".join(r["a"] for r in answers), "<u2")[back] if len(keys) else np.zeros(0, np.uint16)
    several = held > 0
    count = np.bincount(owners[several], minlength=len(sizes))
    length = count - _needed(sizes) + 1
    alive = (length > 0) & (sizes > 0)
    use = several & alive[owners]
    keys, owners, held = keys[use], owners[use], held[use]
    edges = np.searchsorted(owners, np.arange(len(sizes) + 1))
    order = np.lexsort((keys, held, owners))
    at, cls, n, all_, begin = np.flatnonzero(alive), [], [], [], []
    for i in at:
        cls.append(head["a"][16 * i:16 * i + 16])
        n.append(int(sizes[i]))
        all_.append(keys[edges[i]:edges[i + 1]].tobytes())
        begin.append(keys[order[edges[i]:edges[i] + length[i]]].view(np.int64))
    return pa.table({"cls": pa.array(cls, pa.binary()), "n": pa.array(n, pa.int64()), "keys": pa.array(all_, pa.binary()),
                     "begin": pa.array(begin, pa.list_(pa.int64()))})


def _segments(batches):
    """A row per class and fragment: the shingles that fall into it."""
    bits = SEGMENTS.bit_length() - 1
    for batch in batches:
        cls, n, part, seg = [], [], [], []
        for r in batch.to_pylist():
            keys = np.frombuffer(r["keys"], "<u8")
            for p, s in by_fragment(keys, bits):
                cls.append(r["cls"]), n.append(r["n"]), part.append(p), seg.append(keys[s].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(part, pa.int32()),
                                          pa.array(seg, pa.binary())], names=["cls", "n", "part", "seg"])


def _overlaps(batches):
    """Partial overlaps: how many shingles of one segment are in the other."""
    for batch in batches:
        both = []
        for name in ("seg_a", "seg_b"):
            segs = batch.column(name).to_pylist()
            keys = np.frombuffer(b"".join(segs), "<u8")
            rows = np.repeat(np.arange(len(segs)), [len(s) // 8 for s in segs])
            both.append((mix(rows.astype(np.uint64)) ^ keys, rows))  # a key of its own in every row
        (a, rows), (b, _) = both
        common = np.bincount(rows[np.isin(a, b)], minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("a", "b", "n_a", "n_b")), pa.array(common, pa.int64())],
                                         names=["a", "b", "n_a", "n_b", "common"])


def linked(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Of (a, b) class pairs those that link: partial overlaps per fragment, summed per pair."""
    one = segments.select(c("cls").alias("a"), c("n").alias("n_a"), "part", c("seg").alias("seg_a"))
    two = segments.select(c("cls").alias("b"), c("n").alias("n_b"), "part", c("seg").alias("seg_b"))
    met = pairs.join(one, "a").join(two, ["b", "part"]).select("a", "b", "n_a", "n_b", "seg_a", "seg_b")
    parts = met.mapInArrow(_overlaps, "a binary, b binary, n_a long, n_b long, common long")
    sums = parts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    return sums.filter(100 * c("common") >= PERCENT * (c("n_a") + c("n_b") - c("common"))).select("a", "b")


def merge_groups(groups: DataFrame, links: DataFrame, of: str = "cls") -> DataFrame:
    """Groups (``of``, label) after links (a, b): labels spread to neighbours, then follow their own label, to the end."""
    at = lambda x: groups.select(c(of).alias(x), c("label").alias(f"l{x}"))
    edges = cut_lineage(links.join(at("a"), "a").join(at("b"), "b").filter("la != lb").select(
        F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y")).distinct(), "group-links")
    ways = edges.unionByName(edges.select(c("y").alias("x"), c("x").alias("y")))
    to = cut_lineage(ways.groupBy("x").agg(F.least(F.min("y"), c("x")).alias("to")), "group-labels")
    while True:
        near = ways.join(to.select(c("x").alias("y"), "to"), "y").groupBy("x").agg(F.min("to").alias("near"))
        step = to.join(near, "x").withColumn("new", F.least("to", "near"))
        jump = step.select(c("x").alias("new"), c("new").alias("next"))
        moved = cut_lineage(step.join(jump, "new").select("x", "to", F.least("new", "next").alias("new")), "group-labels")
        changed = moved.filter("to != new").limit(1).count()
        to = moved.select("x", c("new").alias("to"))
        if not changed:
            break
    return cut_lineage(groups.join(to, groups["label"] == to["x"], "left").select(
        of, F.coalesce("to", "label").alias("label")), "groups")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    bits = fragment_bits(docs)
    docs = docs.select("doc_id", "text")
    info = cut_lineage(repeated(docs, _emit(bits), _merge, _INFO), "jaccard-documents")
    able = info.filter((c("n") > 0) & (c("shared") >= F.floor((PERCENT * c("n") + 99) / 100)))
    classes = cut_lineage(able.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "jaccard-classes")

    texts = docs.join(classes.select(c("least").alias("_least"), "cls").hint("shuffle_hash"), c("doc_id").eqNullSafe(c("_least")))
    sets = cut_lineage(texts.select("text", "cls").mapInArrow(_pack_sets, PACKED), "jaccard-sets")
    answers = sets.mapInArrow(_sets_to_fragments(bits), PACKED).groupBy("part").applyInArrow(_answer_counts, PACKED)
    alive = cut_lineage(sets.unionByName(answers).groupBy("block").applyInArrow(
        _post, "cls binary, n long, keys binary, begin array<long>").dropDuplicates(["cls"]), "jaccard-alive")
    segments = cut_lineage(alive.select("cls", "n", "keys").mapInArrow(
        _segments, "cls binary, n long, part int, seg binary"), "jaccard-segments")
    posts = cut_lineage(alive.select("cls", "n", F.explode("begin").alias("gram")), "jaccard-posts")
    groups = _group(posts, segments, alive, cut_lineage(alive.select("cls", c("cls").alias("label")), "groups"))

    least = groups.join(classes, "cls").select("label", "least").groupBy("label").agg(F.min("least").alias("component"))
    named = cut_lineage(classes.join(groups.join(least, "label"), "cls", "left").select(
        "cls", F.coalesce("component", "least").alias("component"), "copies"), "jaccard-named")
    # classes with more than a HOT part of all rows, so fewer than HOT of them, go to the tasks; their rows do not meet
    hot = c("copies") * HOT > info.count()
    few = F.broadcast(named.filter(hot).select("cls", "component"))
    rest = info.join(few.select("cls"), "cls", "left_anti").join(named.filter(~hot).select("cls", "component"), "cls", "left")
    return info.join(few, "cls").select(*rest.columns).unionByName(rest).select(
        "doc_id", c("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _group(posts: DataFrame, segments: DataFrame, alive: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups (cls, label) of the classes that links connect."""
    alike = (100 * c("n") >= PERCENT * c("n_b")) & (100 * c("n_b") >= PERCENT * c("n"))
    seen = None
    for turn in range(ROUNDS + 1):
        listed = posts.join(groups, "cls")
        hubs = listed.groupBy("gram").agg(
            F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), c("cls").alias("b"), c("n").alias("n_b"),
                           c("label").alias("label_b"))).alias("hub"),
            F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("gram", "hub.*")
        stars = listed.join(hubs, "gram").filter(c("cls") != c("b"))
        if turn == ROUNDS:
            return _across(cut_lineage(stars.select(c("cls").alias("a"), "b").distinct(), "jaccard-lists"), alive, groups)
        pairs = stars.filter((c("label") != c("label_b")) & alike).select(
            F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = seen = cut_lineage(pairs, "jaccard-pairs")
        if pairs.isEmpty():
            continue
        groups = merge_groups(groups, cut_lineage(linked(pairs, segments), "jaccard-links"))
    return groups


def _across(same_list: DataFrame, alive: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups after all links between classes on the lists left over, given as stars (a, b)."""
    if same_list.isEmpty():
        return groups
    left = same_list.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    families = merge_groups(cut_lineage(left.select("cls", c("cls").alias("label")), "jaccard-left"), same_list)
    blocks = families.groupBy(c("label").alias("family")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = families.select("cls", c("label").alias("family")).join(blocks, "family").join(groups, "cls").join(
        alive.select("cls", "n", "keys"), "cls").withColumn("own", F.pmod(F.xxhash64("cls", F.lit(7)), "blocks").cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), c("blocks") - 1))).select(
        "family", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cls", "n", "label", "keys")
    links = met.groupBy("family", "low", "high").applyInArrow(_cell, "a binary, b binary")
    return merge_groups(groups, cut_lineage(links, "jaccard-links"))


def _cell(rows: pa.Table) -> pa.Table:
    """Links between different groups among the classes of two blocks of a family."""
    if len(rows) < 2:
        return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
    low, high, own = (rows.column(x).to_numpy() for x in ("low", "high", "own"))
    sets = [np.frombuffer(k, "<u8") for k in rows.column("keys").to_pylist()]
    n = rows.column("n").to_numpy()
    label = np.unique(np.array(rows.column("label").to_pylist(), object), return_inverse=True)[1]
    distinct, column = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    held = np.bincount(column)
    use = (held > 1)[column]  # in order of the shingles' place in the order
    order = np.argsort(column[use], kind="stable")
    column, of = (np.cumsum(held > 1) - 1)[column[use][order]], of[use][order]
    first, second = (np.arange(len(sets)),) * 2 if low[0] == high[0] else (np.flatnonzero(own == low[0]), np.flatnonzero(own == high[0]))
    place = np.zeros((2, len(sets)), np.int64)
    place[0, first], place[1, second] = np.arange(len(first)), np.arange(len(second))
    common = np.zeros((len(first), len(second)), np.float32)
    in_first, in_second = np.isin(of, first), np.isin(of, second)
    for start in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        partial = []
        for side, inside, some in ((0, in_first, first), (1, in_second, second)):
            at = np.flatnonzero(inside[a:b]) + a
            partial.append(np.zeros((len(some), COLUMNS), np.float32))
            partial[-1][place[side, of[at]], column[at] - start] = 1
        rows_a, rows_b = (np.flatnonzero(x.any(1)) for x in partial)  # most classes have nothing in most fragments
        common[np.ix_(rows_a, rows_b)] += partial[0][rows_a] @ partial[1][rows_b].T
    ok = (100 * common >= PERCENT * (n[first][:, None] + n[second][None, :] - common)) & (label[first][:, None] != label[second][None, :])
    i, j = np.nonzero(ok)
    cls = np.array(rows.column("cls").to_pylist(), object)
    # one link for each pair of groups is enough
    _, once = np.unique(np.stack([label[first[i]], label[second[j]]]), axis=1, return_index=True)
    return pa.table({"a": pa.array(cls[first[i[once]]].tolist(), pa.binary()), "b": pa.array(cls[second[j[once]]].tolist(), pa.binary())})


def filter_documents(docs: DataFrame) -> DataFrame:
    """One row of each group with its columns: the one with the smallest doc_id, a null one coming last.

    Rows are numbered in a written table first, so that rows that share their doc_id, or have none, stay apart.
    """
    row, stays = free_names(docs, "_row", "_stays")
    rows = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-rows")
    groups = components(rows.select(c(row).alias("doc_id"), "text")).select(c("doc_id").alias(row), "component_id")
    met = groups.join(rows.select(row, c("doc_id").alias("id")), row)
    kept = met.groupBy("component_id").agg(F.min(F.struct(c("id").isNull(), "id", row))[row].alias(stays)).select(stays)
    return rows.join(kept.hint("shuffle_hash"), c(row) == c(stays), "left_semi").select(*(c(f"`{x}`") for x in docs.columns))
