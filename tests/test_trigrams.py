"""The trigram index against patterns tried on every text."""

import random
import re

import pytest

from eligo.operators import trigrams
from eligo.plans import search
from tests.test_vectors import found

ROWS = [("1", "Loan for Women", "a_b", None, "C-1"), ("2", "women", "WOMEN and loans", "", None), ("3", None, None, None, None),
        ("4", "ab", "x", "aabaab", "100%"), ("5", "abab abab", "back\\slash", "ümlaut ÄÖ", ""), ("6", "banana bandana", "aaaa", "na", "n")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(5)
    more = [(str(100 + i), *("".join(rng.choice("abc _%") for _ in range(rng.randrange(12))) for _ in range(4))) for i in range(150)]
    rows = spark.createDataFrame(ROWS + more, "id string, name string, description string, ministry string, scheme_code string")
    return trigrams.build(rows, str(tmp_path_factory.mktemp("trigrams"))), ROWS + more


def plain(text, rows):
    pattern = re.compile("".join({"%": ".*", "_": "."}.get(x, re.escape(x)) for x in text.strip().lower()), re.S)
    return {r[0] for r in rows if text.strip() and any(v and pattern.search(v.lower()) for v in r[1:])}


def test_patterns_find_what_trying_them_finds(spark, index):
    index, rows = index
    rng = random.Random(6)
    texts = ["women", " LOAN ", "ab", "a", "b%a", "an_", "ana", "nana", "banan", "%", "_", "a_b", "a%b%c", "100%", "zzz", "abx", "aba",
             "back\\slash", "äö", "_____________", "aaaa", "aaaaa", "%%", "women and", "_omen", "ab ab", "ban%ban"]
    texts += ["".join(rng.choice("abc _%") for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    asked = spark.createDataFrame([*((str(i), t) for i, t in enumerate(texts)), ("none", None), ("blank", "  ")], "query_id string, text string")
    got = {}
    for r in trigrams.matches(asked, index).collect():
        assert r.id not in got.setdefault(r.query_id, set())
        got[r.query_id].add(r.id)
    for i, t in enumerate(texts):
        assert got.get(str(i), set()) == plain(t, rows), repr(t)
    assert not {"none", "blank"} & set(got)


def test_unknown_trigrams_read_no_posting(spark, index):
    asked = spark.createDataFrame([("1", "zebra crossing")], "query_id string, text string")
    assert trigrams._picks(trigrams.patterns(asked), index[0].table("counts")).count() == 0


def test_a_common_trigram_is_looked_up_by_the_rarest(spark, index):
    asked = spark.createDataFrame([("1", "banana")], "query_id string, text string")
    n = {r.tri: r.n for r in index[0].table("counts").collect()}
    picks = trigrams._picks(trigrams.patterns(asked), index[0].table("counts")).collect()
    assert len(picks) == 2 and n[min(picks, key=lambda r: n[r.tri]).tri] == min(n[x] for x in ("ban", "ana", "nan"))


def test_empty_catalog(spark, tmp_path):
    rows = spark.createDataFrame([], "id string, name string, description string, ministry string, scheme_code string")
    index = trigrams.build(rows, str(tmp_path))
    assert trigrams.matches(spark.createDataFrame([("1", "abc"), ("2", "%")], "query_id string, text string"), index).count() == 0


def test_hybrid_search_falls_back_by_query(spark, tmp_path):
    kind = "id string, name string, description string, ministry string, scheme_code string, status string, data_quality_score int, created_at timestamp"
    rows = spark.sql("select cast(id as string) id, concat('scheme ', id) name, '' description, cast(null as string) ministry, '' scheme_code, "
                     "if(id % 5 = 0, 'suspended', 'active') status, cast(id as int) data_quality_score, timestamp'2024-01-01' created_at from range(30)").to(
        spark.createDataFrame([], kind).schema)
    vectors = spark.sql("select cast(id as string) scheme_id, array(1d, cast(id as double)) embedding from range(8)")
    asked = spark.createDataFrame([("a", " ", [1.0, 0.0]), ("b", "x", [1.0, 0.0]), ("c", "scheme 1", [0.0, 0.0]), ("d", "scheme 2", None), ("e", "none", None),
                                   ("f", None, None)], "query_id string, text string, embedding array<double>")
    out = search.hybrid(rows, vectors, asked, trigrams.build(rows, str(tmp_path)), 4)
    methods = {r.query_id: r.method for r in out.select("query_id", "method").distinct().collect()}
    assert methods == {"a": "listing", "b": "vector", "c": "keyword", "d": "keyword", "f": "listing"}
    got = found(out)
    assert got["a"] == got["f"] == ["29", "28", "27", "26"] and got["b"] == ["1", "2", "3", "4"]
    assert got["c"] == ["19", "18", "17", "16"] and got["d"] == ["29", "28", "27", "26"]


def test_equal_texts_are_indexed_once(spark, tmp_path):
    """The index's texts and postings do not grow with the rows that hold the same."""
    kind = "id string, name string, description string, ministry string, scheme_code string"
    rows = spark.createDataFrame([(str(i), "Loan for Women", "loan FOR women", "M", "") for i in range(40)], kind)
    index = trigrams.build(rows, str(tmp_path))
    assert index.table("texts").count() == 2 and index.table("postings").count() == len("loan for women") + 1
    got = trigrams.matches(spark.createDataFrame([("1", "women"), ("2", "m")], "query_id string, text string"), index)
    assert sorted((r.query_id, r.id) for r in got.collect()) == sorted((q, str(i)) for q in "12" for i in range(40))
