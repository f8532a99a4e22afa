"""Operators against plain re-computations of the same rules, over the small tables."""

import base64
import hashlib
import io
import math
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from eligo.llm import chat, jaccard, langid, lines, mixing, permutations, pieces, quality, queries, suffixes, warc

SMALL, MEDIUM, LARGE = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read(sf, name):
    return pd.read_parquet(f"{sf}/{name}.parquet")


# ---- quality rules

def plain_statistics(text):
    words, rows = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside.update(range(i, i + 8))
    return [len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text or ""), len(rows) - len(set(rows)), len(inside), len(rows)]


def plain_mcd(x):
    """Location and scatter of the rows of x, by the documented steps."""
    scales, p = np.array(list(quality.SCALES.values())), x.shape[1]
    factor = quality.consistency(quality.COVERAGE, p)

    def estimate(rows):
        cov = np.cov(rows.T, bias=True) * factor
        return rows.mean(0), cov + np.diag(scales ** 2)

    def distance(m, s):
        d = x - m
        return np.einsum("ij,ij->i", d, np.linalg.solve(s, d.T).T)

    low = lambda v: np.sort(v, axis=0)[math.ceil(len(v) / 2) - 1]
    middle = low(x)
    best = None
    for m, s in (estimate(x), (middle, np.diag((1.4826 * low(abs(x - middle))) ** 2 + scales ** 2))):
        for _ in range(quality.STEPS):
            cell = np.minimum(np.floor(quality.GRID * np.log2(np.maximum(distance(m, s), 2.0 ** -20))), 40 * quality.GRID)
            order = np.sort(cell)
            last = order[math.ceil(quality.COVERAGE * len(x)) - 1]
            m, s = estimate(x[cell <= last])
        if best is None or np.linalg.slogdet(s)[1] < best[0] - 1e-9:
            best = np.linalg.slogdet(s)[1], distance(m, s)
    return best[1]


def test_quality_against_plain_steps(spark):
    docs = read(MEDIUM, "documents")
    want = docs[["doc_id", "lang", "source"]].copy()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    want[names] = [plain_statistics(t) for t in docs["text"]]
    want["base_failed"] = (want.n_words < 20) | (100 * want.n_repeat_words > 30 * want.n_words)
    fine = want[~want.base_failed].copy()
    # sf0.01 has no source of 50 documents in any language: all groups are languages
    assert fine.groupby(["lang", "source"]).size().max() < quality.MIN_GROUP <= fine.groupby("lang").size().min()
    x = np.stack([np.log((fine.word_chars + 250) / (fine.n_words + 50)), np.log1p(1000 * fine.n_symbols / (fine.word_chars + 250)),
                  fine.n_dup_lines / (fine.n_lines + 4), fine.n_repeat_words / (fine.n_words + 50)], 1)
    fine["d2"] = 0.0
    for lang in fine.lang.unique():
        fine.loc[fine.lang == lang, "d2"] = plain_mcd(x[(fine.lang == lang).to_numpy()])
    got = quality.quality(spark.read.parquet(f"{MEDIUM}/documents.parquet")).toPandas().merge(want, on="doc_id", suffixes=("", "_w"))
    for n in names[:-1] + ["base_failed"]:
        assert (got[n] == got[n + "_w"]).all(), n
    both = got.merge(fine[["doc_id", "d2"]], on="doc_id", suffixes=("", "_w"))
    assert np.allclose(both.d2, both.d2_w, rtol=1e-6)
    limit = quality.chi2_quantile(quality.QUANTILE, quality.P)
    assert set(got[got.kept].doc_id) == set(fine[fine.d2 <= limit].doc_id)
    labels = read(MEDIUM, "labels")
    judged = got.merge(labels, on="doc_id")
    assert judged[(judged.quality == 1) & ~judged.base_failed].kept.mean() > 0.99
    assert judged[judged.quality == 0].kept.mean() < 0.05


def test_quantiles_and_group_choice(spark):
    assert abs(quality.chi2_quantile(0.95, 4) - 9.4877) < 1e-3
    rows = [(i, "en", "a", False) for i in range(60)] + [(i, "en", "b", False) for i in range(30)] + [(i, "en", None, False) for i in range(25)]
    rows += [(i, None, None, False) for i in range(10)] + [(1, "en", "c", True)]
    df = spark.createDataFrame(rows, "doc_id int, lang string, source string, base_failed boolean")
    got = {(r.lang, r.source): r.grp for r in quality.grouped(df).collect()}
    assert got["en", "a"] == '{"by":"source","lang":"en","source":"a"}' and got["en", "b"] == got["en", None] == got["en", "c"] == '{"by":"lang","lang":"en"}'
    assert got[None, None] == '{"by":"all"}' and quality.grouped(df).count() == len(rows)


# ---- n-gram Jaccard join

def plain_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def test_jaccard_chains_hubs_and_thresholds(spark):
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(5000)]
    texts = []
    for _ in range(12):  # chains of small edits, so that ends do not link directly
        words = rng.choices(vocabulary, k=rng.randint(30, 120))
        for _ in range(15):
            texts.append(" ".join(words))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    passage = rng.choices(vocabulary, k=60)  # shared by texts that are not alike
    for _ in range(60):
        own = rng.choices(vocabulary, k=rng.choice((8, 15, 20, 40, 60)))
        texts.append(" ".join(own + passage if rng.random() < 0.5 else passage + own))
    texts += [" ".join(passage), "a b c", "A  b\nc", "a b", "", None]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df).collect()}
    assert got == dict(enumerate(plain_components(texts)))


def test_a_large_group_is_joined_through_hubs(spark, monkeypatch):
    rng = random.Random(5)
    base = rng.choices([f"t{i}" for i in range(9000)], k=200)
    texts = []
    for _ in range(400):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(200)] = f"n{rng.randrange(10 ** 9)}"
        texts.append(" ".join(words))
    counted = []
    plain = jaccard.linked
    monkeypatch.setattr(jaccard, "linked", lambda pairs, segments: counted.append(pairs.count()) or plain(pairs, segments))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.component_id for r in jaccard.components(df).collect()}
    assert got == {top for _, top in plain_components(texts)}
    assert sum(counted) < 400 * 399 / 8  # far from all pairs


# ---- line dedup

def test_store_undoes_what_it_did(spark, tmp_path):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    first, second = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 != 0")
    store = lines.LineStore(spark, str(tmp_path / "store"), shards=3)
    store.insert(first)
    counts = {tuple(r) for r in store.counts().collect()}
    drops = lambda d: {r.doc_id: sorted(r.keys) for r in store.drops(lines.key_pairs(d)).collect()}
    alone = drops(first)
    store.insert(second)
    both = drops(docs)
    assert both != alone
    store.delete(second)
    assert {tuple(r) for r in store.counts().collect()} == counts and drops(first) == alone
    frequent = store.counts().filter("n >= 3").toPandas()
    for r in store.filters.collect():  # after the deletions the filters hold these keys and nothing else
        tables = lines._tables(r.tables)
        own = frequent[frequent["shard"] == r.shard]
        assert lines.cuckoo_contains(tables, own.k1.to_numpy(), own.k2.to_numpy()).all()
        assert sum(int((t != 0).sum()) for t in tables) == len(own)
    one = lines.LineStore(spark, str(tmp_path / "one"), shards=1)
    one.insert(docs)
    assert {r.doc_id: sorted(r.keys) for r in one.drops(lines.key_pairs(docs)).collect()} == both
    store.delete(spark.createDataFrame([(1, "a line that the store has never met")], "doc_id long, text string"))
    assert {tuple(r) for r in store.counts().collect()} == counts


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    k1, k2 = rng.integers(-2 ** 63, 2 ** 63 - 1, (2, 30_000))
    tables = []
    for at in range(0, 30_000, 7_000):
        tables = lines.cuckoo_insert(tables, k1[at:at + 7_000], k2[at:at + 7_000])
    assert lines.cuckoo_contains(tables, k1, k2).all() and lines.cuckoo_contains(tables, k2, k1).mean() < 0.002
    tables = lines.cuckoo_delete(tables, k1[:20_000], k2[:20_000])
    assert lines.cuckoo_contains(tables, k1[20_000:], k2[20_000:]).all()
    assert sum(int((t != 0).sum()) for t in tables) == 10_000
    assert lines.cuckoo_insert([], k1[:0], k2[:0]) == []


# ---- mixing

def test_targets():
    assert mixing.targets([("a", 100), ("b", 10), ("c", 1000), (None, 5)]) == {"a": (100, 300.0), "b": (10, 30.0), "c": (1000, 770.0), None: (5, 15.0)}
    assert mixing.targets([("a", 0), ("b", 8)]) == {"a": (0, 0.0), "b": (8, 8.0)} and mixing.targets([]) == {}
    assert mixing.in_code_point_order(["b", None, "B", "é", ""]) == ["", "B", "b", "é", None]


def test_permutations_are_one_to_one():
    for n in (1, 2, 3, 5, 64, 1000):
        for seed in (0, 7):
            assert sorted(mixing.permute(np.arange(n), np.full(n, n), np.full(n, seed, np.uint64)).tolist()) == list(range(n))


def test_mix_keeps_its_promises(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = mixing.taken_words(docs).toPandas().sort_values("doc_id", ignore_index=True)
    again = mixing.taken_words(docs.repartition(7)).toPandas().sort_values("doc_id", ignore_index=True)
    assert got.equals(again)
    plain = read(MEDIUM, "documents")
    plain["words"] = [len(WORD.findall(t or "")) for t in plain.text]
    both = got.merge(plain, on="doc_id")
    assert (both["size"] == both.words).all() and (both.taken <= 3 * both["size"]).all()
    by = both.groupby("source", dropna=False).agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.told).all() and (abs(by.taken - by.target) <= 0.03 * by.target + 64).all()
    documents, mixed = mixing.mix_documents(docs)
    rows = mixed.toPandas()
    slots = rows.groupby(["shard", "place", "slot"]).agg(n=("words", "sum"), blocks=("block", "nunique"), turns=("turn", "nunique"))
    assert slots.n.max() == mixing.BLOCK_WORDS and slots.blocks.max() == slots.turns.max() == 1
    assert rows.groupby(["place", "turn", "block", "start"]).size().max() == 1  # a pass uses a block once
    assert rows.turn.max() < mixing.MAX_REPEATS


# ---- pieces

def model_of_kind(kind):
    """The shipped model file with another model_type, for the library to apply its pieces and scores by that rule."""
    raw = open(pieces.MODEL, "rb").read()

    def number(data, at):
        out = shift = 0
        while True:
            out |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return out, at

    at = 0
    while True:
        tag, at = number(raw, at)
        size, at = number(raw, at)
        if tag >> 3 == 2:
            break
        at += size
    spec, i = raw[at:at + size], 0
    while True:
        tag, i = number(spec, i)
        if tag == 3 << 3:
            return raw[:at] + spec[:i] + bytes([kind]) + spec[i + 1:] + raw[at + size:]
        if tag & 7 == 0:
            _, i = number(spec, i)
        else:
            n, i = number(spec, i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            i += n


ODD = ["Hello world", "", "  two  spaces ", "naïve café", "\n\ttabs", "日本語のテキスト", "aaaa bbbb  ", "emoji 😀 x", " ", "x" * 3000, "The the THE", "ab" * 700,
       "1234567890 3.14", "foo.bar@example.com", "á", "don't", "(see [x])", "ﬁne", "ÀÉÎ ßüö"]


def test_pieces_are_the_librarys(spark):
    from sentencepiece import SentencePieceProcessor

    vocabulary, library = pieces.Vocabulary.load(), SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ODD + read(SMALL, "documents").text.tolist() + [p.replace("▁", " ") for p in (library.id_to_piece(i) for i in range(259, 32000, 7))]
    encoder = pieces.Encoder(vocabulary)
    ids = encoder(pa.array(texts))
    assert ids.to_pylist() == library.encode(texts)
    assert encoder(pa.array(texts)).equals(ids)  # from the cache
    assert pieces.decode_batch(ids, vocabulary).to_pylist() == texts


def test_best_scores_are_the_librarys():
    from sentencepiece import SentencePieceProcessor

    full, library = pieces.Vocabulary.load(), SentencePieceProcessor(model_proto=model_of_kind(1))
    names = [library.id_to_piece(i) for i in range(32000)]
    plain = [i for i in range(259, 32000)]
    vocabulary = pieces.Vocabulary.of([names[i] for i in plain], [library.get_score(i) for i in plain], plain, {b: b + 3 for b in range(256)}, 32000)
    assert not vocabulary.merges and (full.byte_ids == vocabulary.byte_ids).all()
    words = sorted({w for t in read(SMALL, "documents").text for w in t.split()})[:4000] + ["日本語", "", "é", "😀a"]
    assert pieces.Encoder(vocabulary)(pa.array(words)).to_pylist() == library.encode(words)


def test_viterbi_against_all_ways():
    rng = random.Random(2)
    spelled = {"a": -5.0, "b": -5.0, "c": -6.0, "ab": -3.0, "bc": -3.5, "abc": -9.0, "ca": -4.0, "aa": -3.0, "▁": -2.0, "▁a": -2.5}
    vocabulary = pieces.Vocabulary.of(list(spelled), list(spelled.values()), list(range(300, 300 + len(spelled))), {b: b for b in range(256)}, 400)

    def ways(word):
        if not word:
            yield ()
        for k in range(1, len(word) + 1):
            if word[:k] in spelled or k == 1:
                for rest in ways(word[k:]):
                    yield (word[:k], *rest)

    for _ in range(200):
        word = "▁" + "".join(rng.choices("abcz", k=rng.randint(0, 7)))
        ids = pieces.Encoder(vocabulary)(pa.array([word[1:]])).to_pylist()[0]
        if len(word) == 1:
            assert ids == []
            continue
        score = lambda way: sum(spelled.get(x, min(spelled.values()) - 10) for x in way)
        names = {300 + i: p for i, p in enumerate(spelled)}
        assert math.isclose(sum(spelled[names[i]] if i in names else min(spelled.values()) - 10 for i in ids), max(map(score, ways(word))))


# ---- language

def test_held_out_accuracy(spark):
    docs = read(MEDIUM, "documents")
    got = queries.op2_language_id(spark, MEDIUM).toPandas().merge(docs, on="doc_id")
    import zlib

    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.97


def test_gradient():
    rng = np.random.default_rng(0)
    p = {"vectors": rng.normal(0, 0.5, (256, langid.VECTOR)), "bias": rng.normal(0, 0.1, langid.FILTERS * 3),
         "weights": rng.normal(0, 0.3, (langid.FILTERS * 3, 2)), "offset": np.zeros(2)}
    p |= {w: rng.normal(0, 0.3, (w, langid.VECTOR, langid.FILTERS)) for w in langid.WIDTHS}
    rows, labels, weight = rng.integers(97, 123, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones(4)
    g, _ = langid._gradient(p, rows, labels, weight)
    for name, at in (("weights", (3, 1)), ("bias", (5,)), (3, (1, 2, 3)), ("vectors", (100, 4))):
        costs = []
        for step in (1e-3, -1e-3):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            costs.append(langid._gradient(q, rows, labels, weight)[1] / 4)
        assert abs((costs[0] - costs[1]) / 2e-3 - g[name][at]) < 2e-3


def test_windows():
    rows, count = langid.windows(pa.array(["A" * 300, "", "é1b"]))
    assert count.tolist() == [2, 0, 1] and rows.shape == (3, 256)
    assert bytes(rows[1]) == b"a" * 44 + b" " * 212 and bytes(rows[2][:4]) == "é b".encode()


# ---- neighbours

def test_recall(spark):
    data = read(LARGE, "embeddings")
    x = np.stack(data.embedding.to_numpy()).astype(np.float64)
    got = queries.op5_nearest_neighbours(spark, LARGE).toPandas()
    found, total = 0, 0
    for q, rows in got.groupby("query_id"):
        i = int(np.flatnonzero(data.vec_id == q)[0])
        score = (x * x[i]).sum(1)
        score[i] = -np.inf
        best = data.vec_id.to_numpy()[np.lexsort((data.vec_id, -score))[:20]]
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, 21)) and rows.score.is_monotonic_decreasing
        assert np.allclose(rows.score, [score[np.flatnonzero(data.vec_id == v)[0]] for v in rows.vec_id], atol=1e-12)
        found, total = found + len(set(best) & set(rows.vec_id)), total + 20
    assert got.query_id.nunique() == (data.vec_id % 20 == 0).sum() and found / total >= 0.9


def test_blocks_of_a_hot_file_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(permutations, "BLOCK_ENTRIES", 7)
    monkeypatch.setattr(permutations, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(200, 4)), 1).astype(np.float32)
    x[40:90] = x[3]  # very common
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in permutations.nearest(df, 5, 10).collect()}
    for q in range(0, 200, 5):  # one pivot at this size, so the answer is exact
        score = (x.astype(np.float64) * x[q].astype(np.float64)).sum(1)
        score[q] = -np.inf
        assert [got[q, r] for r in range(1, 11)] == np.lexsort((np.arange(200), -score))[:10].tolist()


def test_footrule():
    rng = np.random.default_rng(1)
    orders = np.stack([rng.permutation(30)[:8] for _ in range(50)])

    def plain(a, b):
        place = lambda o, p: list(o).index(p) if p in o else 8
        return sum(abs(place(a, p) - place(b, p)) for p in range(30))

    got = permutations.footrule(orders[0], orders, 30)
    want = np.array([plain(orders[0], o) for o in orders])
    assert (got - got[0] == want).all()


# ---- passages

def test_passages_against_all_stretches(spark):
    rng = random.Random(1)
    shared = [rng.choices([f"s{i}" for i in range(400)], k=n) for n in (49, 50, 51, 80, 120)]
    texts = []
    for i in range(80):
        words = rng.choices([f"w{j}" for j in range(30)], k=rng.randint(0, 90))
        if i % 2:
            cut = rng.choice(shared)
            a, b = sorted((rng.randint(0, 30), rng.randint(0, 30)))
            words[a:a] = cut[max(0, a - 5):len(cut) - (b - a)]
        texts.append(" ".join(words))
    texts += [" ".join(shared[4]) + " mid " + " ".join(shared[4]), texts[1]]
    where = {}
    tokens = [t.split() for t in texts]
    for d, w in enumerate(tokens):
        for i in range(len(w) - 49):
            where.setdefault(tuple(w[i:i + 50]), set()).add(d)
    want = []
    for d, w in enumerate(tokens):
        hits = [i for i in range(len(w) - 49) if len(where[tuple(w[i:i + 50])]) > 1]
        spans = []
        for i in hits:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + 50
            else:
                spans.append([i, i + 50])
        want += [(d, a, b - a) for a, b in spans]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = sorted((r.doc_id, r.start_word, r.n_words) for r in suffixes.passages(df).collect())
    assert got == sorted(want) and len(want) > 10


# ---- chat

CONTROL_TEXT = st.lists(st.sampled_from(["\\", "<s>", "[INST]", "[/INST]", "</s>", "<", "s>", "[", "INST]", "<<SYS>>", "<</SYS>>", "x", "é", "\n"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(CONTROL_TEXT)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(x in out for x in chat.CONTROL)


def test_mask_and_rendered_text(spark):
    ranks = chat.load_ranks()
    coder = chat.Coder.of(ranks)
    rows = [(1, 0, "user", "hi [INST]"), (1, 1, "assistant", "yes\\no"), (1, 2, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    part, = chat.format_conversations(df, ranks).collect()
    ids, mask = np.array(part.ids), np.array(part.loss)
    assert chat.rendered(ids, coder) == "<s>user[INST]hi [\\INST][/INST]</s><s>assistant[INST]yes\\\\no[/INST]</s><s>assistant[INST][/INST]</s>"
    assert coder.decode(ids[mask]) == "yes\\\\no" and part.first_token == 0


def test_long_conversations_are_written_in_parts(spark, monkeypatch):
    ranks = chat.load_ranks()
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} " * 3) for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    coded = df.sort("turn").coalesce(1).select("conv_id", "turn", "role", "text").mapInArrow(
        chat._encode(ranks), "conv_id long, turn long, role string, text string, role_ids array<int>, text_ids array<int>").toPandas()
    whole = list(chat._assemble(ranks, "assistant")(iter([coded.drop(columns=["turn", "text"])])))
    monkeypatch.setattr(chat, "PART_TOKENS", 100)
    parts = list(chat._assemble(ranks, "assistant")(iter([coded.drop(columns=["turn", "text"])])))
    assert len(whole) == 1 and len(parts) > 10
    assert np.concatenate([p.ids[0] for p in parts]).tolist() == whole[0].ids[0].tolist()
    assert np.concatenate([p.loss[0] for p in parts]).tolist() == whole[0].loss[0].tolist()
    assert [p.first_token[0] for p in parts] == np.cumsum([0] + [len(p.ids[0]) for p in parts])[:-1].tolist()


# ---- archives

def test_pages_come_back(spark):
    pages = read(SMALL, "pages")
    got = queries.op8_warc_packages(spark, SMALL).toPandas().set_index("page_id")
    firsts = {}
    for r in pages.sort_values("page_id").itertuples():
        payload = (r.html or "").encode()
        first = firsts.setdefault(payload, r.page_id)
        row = got.loc[r.page_id]
        assert row.payload_bytes == len(payload) and row.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (row.record_type, row.refers_to) == ("response", row.refers_to) if first == r.page_id else ("revisit", first)
    assert len(got) == len(pages)


def make_package(n=5):
    rows = [(i, f"http://x/{i}", b"p" * i, i, warc.payload_digest(b"p" * i), None) for i in range(n)]
    return warc.package(rows)


@pytest.mark.parametrize("zip64", [False, True])
def test_reader_follows_directories_and_ranges(zip64, monkeypatch):
    if zip64:  # every size and offset above 10 goes to 64-bit fields
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = make_package()
    monkeypatch.undo()
    if zip64:
        assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    asked = []

    def fetch(at, n):
        asked.append((at, n))
        return data[at:at + n]

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [m.name for m in warc.members(fetch, len(data))] == z.namelist() and all(i.compress_type == 0 for i in z.infolist())
        place = z.getinfo(warc.WARC)
    asked.clear()
    got = list(warc.records(fetch, len(data)))
    assert [r.block.partition(b"\r\n\r\n")[2] for r in got] == [b"p" * i for i in range(5)]
    assert not any(at <= place.header_offset and at + n >= place.header_offset + place.file_size and n < len(data) for at, n in asked)


def test_reader_takes_comments_and_refuses_damage():
    out = io.BytesIO(make_package())
    with zipfile.ZipFile(out, "a") as z:
        z.comment = b"a PK\x05\x06 in the comment" + b"-" * 20
    data = out.getvalue()
    assert len(list(warc.records(lambda at, n: data[at:at + n], len(data)))) == 5
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.INDEX, "x" * 100)
        z.writestr(warc.WARC, "x" * 100)
    data = packed.getvalue()
    with pytest.raises(ValueError, match="compressed"):
        list(warc.records(lambda at, n: data[at:at + n], len(data)))
    with pytest.raises(ValueError, match="ZIP"):
        list(warc.members(lambda at, n: b"", 0))


# ---- pipeline

def test_pipeline_is_its_stages(spark):
    docs = read(SMALL, "documents")
    now = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, now, SMALL)
    rejected = quality.quality(now).filter("not kept").toPandas().doc_id
    assert sorted(kept.toPandas().doc_id) == sorted(set(docs.doc_id) - set(rejected))
    clean = stages["line_dedup"](spark, kept, SMALL).toPandas()
    seen = {}
    for r in kept.toPandas().itertuples():
        for key in {k for k in (x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)}) for x in r.text.split("\n")) if len(k) >= 20}:
            seen.setdefault(key, set()).add(r.doc_id)
    last = {k: max(d) for k, d in seen.items() if len(d) >= 3}
    for r in kept.toPandas().itertuples():
        lines_left = [x for x in r.text.split("\n") if last.get(x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)}), r.doc_id) <= r.doc_id]
        assert clean.set_index("doc_id").text[r.doc_id] == "\n".join(lines_left)
    frame = spark.createDataFrame(clean)
    single = stages["near_duplicates"](spark, frame, SMALL).toPandas()
    tops = plain_components(clean.text.tolist())
    groups = {}
    for i, (_, top) in enumerate(tops):
        groups.setdefault(top, []).append(clean.doc_id[i])
    assert sorted(single.doc_id) == sorted(min(g) for g in groups.values())
    assert single.merge(clean, on="doc_id").eval("text_x == text_y").all()
    mixed = stages["source_mix"](spark, spark.createDataFrame(single), SMALL).toPandas()
    sizes = {r.doc_id: len(WORD.findall(r.text)) for r in single.itertuples()}
    used = Counter()
    for r in mixed.itertuples():
        used[r.doc_id] += len(WORD.findall(r.text))
    assert all(n <= 3 * sizes[i] for i, n in used.items()) and abs(sum(used.values()) / sum(sizes.values()) - 1) < 0.02
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.MODEL)
    assert out.exact.all() and sorted(map(tuple, out.ids)) == sorted(map(tuple, library.encode(mixed.text.tolist())))
