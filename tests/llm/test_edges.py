"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eligo.llm import chat, jaccard, langid, lines, mixing, permutations, pieces, quality, suffixes, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs far away into the deep green wood where nobody ever goes by night at all"
ROWS = [
    (1, PROSE, "en", "a"), (2, None, None, None), (None, "one\ntwo words", "en", "a"), (3, "", "de", None), (4, " \t\n\x0b ", None, "b"),
    (5, LONG, "en", "b"), (6, PROSE + " tonight", "en", "a"), (6, PROSE + " tonight", "en", "a"), (7, "x" * 30_000, "en", "c"),
    (8, "ümlaut ▁ mark", "de", "c"), (9, PROSE, "fr", None), (10, "1234 5678", "en", "a"), (11, "A shared line of some length\n" * 3, "en", "a"),
    (12, "a SHARED line of some length  \nown", "en", "b"), (13, "\ta shared line of some length\r\nlast", "en", "b"),
]
CLASHES = ["n_words", "kept", "grp", "ids", "size", "place", "start", "target", "words", "keys", "shard", "cls", "n", "part", "block",
           "known", "decoded", "row", "turn", "seg", "first", "count", "_t", "_w", "_row", "_gone", "_drop_id", "d2", "x_word"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in ROWS], DOCS)
    return plain.withColumns({x: F.lit("clash") for x in CLASHES})


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.limit(0)


def test_quality(docs, none):
    got = {(r.doc_id, r.n_words): r for r in quality.quality(docs).collect()}
    assert len(quality.quality(docs).collect()) == len(ROWS) and quality.quality(none).count() == 0
    assert got[2, 0].base_failed and got[2, 0].word_chars == 0 and not got[2, 0].kept
    assert got[3, 0].n_dup_lines == 0 and got[4, 0].base_failed
    assert got[5, 40_000].kept and not got[5, 40_000].base_failed and got[7, 1].word_chars == 30_000
    assert got[11, 18].n_dup_lines == 2 and got[11, 18].n_repeat_words == 18
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 6, 9]


def test_lines(docs, none):
    got = {r.doc_id: r for r in lines.dedup_lines(docs.select("doc_id", "text")).collect()}
    assert got[2].n_lines == 1 and got[2].kept_text == "" and got[3].n_lines == 1
    assert got[11].n_dropped == 3 and got[11].kept_text == "" and got[11].n_lines == 4
    assert got[12].n_dropped == 1 and got[12].kept_text == "own"
    assert got[13].n_dropped == 0 and got[None].n_dropped == 0
    assert lines.dedup_lines(none.select("doc_id", "text")).count() == 0
    out = lines.filter_documents(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[2].text is None and texts[2].n_chars is None and texts[12].text == "own" and texts[12].n_chars == 3
    assert texts[12]["keys"] == "clash"


def test_jaccard(docs, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()), key=str)
    by_id = {r[0]: r for r in got}
    assert len(got) == len(ROWS) and jaccard.components(none).count() == 0
    assert by_id[2][1:] == (0, 2) and by_id[3][1:] == (0, 3) and by_id[7][1:] == (1, 7) and by_id[None][1:] == (1, None)
    assert by_id[6][2] == 1 and by_id[9][2] == 1 and by_id[5][1] == 39_996
    kept = jaccard.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in ROWS if r[0] not in (6, 9))


def test_mixing(docs, none):
    got = mixing.taken_words(docs).collect()
    assert len(got) == len(ROWS) and mixing.taken_words(none).count() == 0
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].size == 0 and by_id[2].taken == 0 and by_id[5].size == 40_000
    # null comes last: sources a, b, c weigh 5, 2, 1 and null 5 again
    assert by_id[2].source_size == len(PROSE.split()) and by_id[2].target == 3 * len(PROSE.split())
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    out = mixing.filter_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text) and r["_row"] == r["place"] == "clash"
    assert words == {i: n for i, n in ((i, sum(r.taken for r in got if r.doc_id == i)) for i in by_id) if n}
    assert mixing.filter_documents(none).count() == 0


def test_pieces(docs, none):
    vocabulary = pieces.Vocabulary.load()
    got = pieces.round_trip(docs, vocabulary).collect()
    assert len(got) == len(ROWS) and all(r.exact for r in got)
    assert {r.doc_id: r.ids for r in got}[2] is None and {r.doc_id: r.ids for r in got}[3] == []
    assert pieces.round_trip(none, vocabulary).count() == 0
    assert pieces.encode(docs, vocabulary, to="piece_ids").columns == [*docs.columns, "piece_ids"]


def test_language(docs, none):
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i in (2, 3, 4, 10):
        assert got[i].lang_pred == "und" and got[i].score == 0
    assert set(model.languages) == {"en", "de", "fr"} and all(0 <= r.score <= 1 for r in got.values())
    assert langid.learn(none) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0
    assert len(langid.predict(docs, model).collect()) == len(ROWS)


def test_passages(docs, none, spark):
    assert suffixes.passages(docs).count() == 0  # nothing of 50 words is in two rows
    assert suffixes.passages(none).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    some = spark.createDataFrame([(1, "x " + text), (2, f"y y {text.upper()} z"), (2, f"y y {text.upper()} z"), (None, text[4:]),
                                  (3, f"{text} {text}"), (4, None), (5, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.start_word, r.n_words) for r in suffixes.passages(some.withColumn("at", F.lit(1))).collect()), key=str)
    assert got == sorted([(1, 1, 60), (2, 0, 63), (2, 0, 63), (None, 1, 58), (3, 0, 120)], key=str)


def test_chat(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (1, 1, "assistant", "two"), (2, 0, None, None),
            (None, 0, "assistant", "</s>\\[INST]"), (None, None, "user", "x" * 100_000), (3, 0, "[INST]\\", "")]
    some = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(0)).withColumn("part", F.lit(0))
    ranks = chat.load_ranks()
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(some, ranks), ranks).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\none\nassistant\ntwo\nassistant\ntwo\n")
    assert got[1].loss_chars == 6 and got[1].loss_sha256 == sha("twotwo")
    assert got[2].turns_sha256 == sha("\n\n") and got[2].loss_chars == 0 and got[2].loss_sha256 == sha("")
    assert got[None].loss_sha256 == sha("</s>\\[INST]") and got[None].n_turns == 2
    assert got[3].turns_sha256 == sha("[INST]\\\n\n")
    empty = chat.format_conversations(some.limit(0), ranks)
    assert empty.count() == 0 and chat.read_back(empty, ranks).count() == 0


def test_warc(spark):
    rows = [(3, "http://b/\r\nX: y", "same"), (1, None, "same"), (2, "http://c", None), (None, "d", "same"), (4, "e", ""),
            (5, "f", "ü" * 500_000), (6, "g", "other"), (6, "g", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(0)).withColumn("digest", F.lit(0))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_packages(warc.write_packages(pages)).collect()), key=str)
    assert got == sorted([(3, 4, "revisit", 1), (1, 4, "response", None), (None, 4, "revisit", 1), (2, 0, "response", None), (4, 0, "revisit", 2),
                          (5, 1_000_000, "response", None), (6, 5, "response", None), (6, 5, "response", None)], key=str)
    assert {r.record_type for r in warc.read_packages(warc.write_packages(pages, min_revisit=5)).filter("payload_bytes < 5").collect()} == {"response"}
    assert warc.read_packages(warc.write_packages(pages.limit(0))).count() == 0


def test_neighbours(spark):
    rows = [(20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (40, [0.0, 1.0]), (8, []), (60, [1.0, 0.0, 0.0]), (1, [2.0, 0.0]), (80, None), (None, [1.0, 1.0])]
    some = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(9), "score": F.lit(9), "members": F.lit(9)})
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in permutations.nearest(some, 20, 3).collect())
    assert got == [(20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 40, 0.0), (40, 1, 1, 0.0), (40, 2, 2, 0.0), (40, 3, 20, 0.0)]
    assert permutations.nearest(some.limit(0), 20).count() == 0


def test_stages_pass_odd_and_empty_documents_on(spark, docs, none):
    for given in (docs, none):
        some = given
        for name, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, None)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert some.columns == docs.columns, name
        out = some.collect()
        assert all(r.exact for r in out) and (len(out) > 0) == (given is docs)
