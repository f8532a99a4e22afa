"""Search against brute force in numpy."""

import numpy as np
import pytest

from eligo.operators import dedup, vectors

DIM = 8


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    corpus = rng.standard_normal((300, DIM))
    corpus[5] = 0
    corpus[7] = corpus[8]  # a tie
    return corpus, rng.standard_normal((20, DIM))


def frames(spark, data):
    corpus, queries = data
    c = spark.createDataFrame([(f"s{i:03d}", v.tolist()) for i, v in enumerate(corpus)], "scheme_id string, embedding array<double>")
    c = c.unionByName(spark.createDataFrame([("null", None), ("short", [1.0])], c.schema)).repartition(4)
    q = spark.createDataFrame([(f"q{i:02d}", v.tolist()) for i, v in enumerate(queries)], "query_id string, embedding array<double>")
    return c, q.unionByName(spark.createDataFrame([("zero", [0.0] * DIM)], q.schema))


def brute(data, k):
    corpus, queries = data
    out = {}
    for i, q in enumerate(queries):
        norms = np.linalg.norm(corpus, axis=1)
        ok = np.nonzero(norms)[0]
        sims = np.round(corpus[ok] @ q / norms[ok] / np.linalg.norm(q), 6)
        order = sorted(range(len(ok)), key=lambda j: (-sims[j], f"s{ok[j]:03d}"))[:k]
        out[f"q{i:02d}"] = [f"s{ok[j]:03d}" for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.scheme_id)
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_search(spark, data, block):
    c, q = frames(spark, data)
    assert found(vectors.cosine_top_k(q, c, 10, block)) == brute(data, 10)


def test_no_queries(spark, data):
    c, q = frames(spark, data)
    assert vectors.cosine_top_k(q.where("false"), c, 3).count() == 0


def test_near_names_match_brute_force(spark):
    words = ["abc", "abd", "abcd", "bc", "xyz", "xy", "qqqq", "qqqr", "rqqq", "", "abcde", "zzz9", "zzz", "same", "same"]

    def drops(w):
        return {w} | {w[:i] + w[i + 1:] for i in range(len(w))}

    distinct = sorted({w for w in words if w})
    want = {a for a in distinct for b in distinct if a != b and drops(a) & drops(b)}
    df = spark.createDataFrame([(w,) for w in words], "name_key string")
    got = dedup.near_names(df).collect()
    assert {r.name_key for r in got} == want
    assert all(r.review_low <= r.name_key <= r.review_high for r in got)


def test_embedding_is_deterministic_and_blank_text_has_none(spark):
    df = spark.createDataFrame([(1, "Loans for women"), (2, "loans FOR women!"), (3, " "), (4, None)], "id int, text string")
    rows = {r.id: r for r in vectors.embed(df, "text", dim=32).collect()}
    assert rows[1].embedding == rows[2].embedding and rows[1].embedding_dim == 32
    assert rows[3].embedding is None and rows[4].embedding_dim == 0 and rows[4].embedding_model == ""


def test_one_per_model(spark):
    df = spark.createDataFrame([("a", "m", [1.0], 1), ("a", "m", [2.0], 2), ("a", "n", [3.0], 1)],
                               "scheme_id string, embedding_model string, embedding array<double>, v int")
    assert {(r.embedding_model, r.v) for r in vectors.one_per_model(df, "v").collect()} == {("m", 2), ("n", 1)}
