"""The stored vector index against brute force."""

import numpy as np
import pytest

from eligo.operators import ann, vectors
from eligo.registry import REGISTRY
from eligo.registry.common import Tables
from tests.test_vectors import DIM, brute, data, found, frames  # noqa: F401


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):  # noqa: F811
    return ann.build(frames(spark, data)[0], str(tmp_path_factory.mktemp("ann")), DIM)


def test_all_cells_give_the_exact_answer(spark, data, index):  # noqa: F811
    q = frames(spark, data)[1]
    assert found(ann.top_k(q, index, 10, probes=1000, shortlist=0)) == brute(data, 10)
    assert found(ann.top_k(q, index, 10, probes=1000, shortlist=1000)) == brute(data, 10)


def test_every_vector_is_filed_once(spark, data, index):  # noqa: F811
    for name in ("codes", "vectors"):
        rows = index.table(name).collect()
        assert sorted(r.scheme_id for r in rows) == [f"s{i:03d}" for i in range(300) if i != 5]
    assert index.rows.sum() == 299 and len(index.rows) == 17


def test_probed_cells_and_shortlists_find_most(spark, data, index):  # noqa: F811
    q = frames(spark, data)[1]
    exact = vectors.cosine_top_k(q, frames(spark, data)[0], 10)
    assert vectors.recall(ann.top_k(q, index, 10), exact).first().recall > 0.8
    assert vectors.recall(ann.top_k(q, index, 10, probes=17, shortlist=30), exact).first().recall > 0.9


def test_shards_and_blocks_change_nothing(spark, data, index, monkeypatch):  # noqa: F811
    q = frames(spark, data)[1]
    whole = found(ann.top_k(q, index, 10, probes=6, shortlist=40))
    monkeypatch.setattr(ann, "SHARD_ROWS", 11)  # below the rows of most cells, so that these are cut
    monkeypatch.setattr(ann, "QUERY_BLOCK", 6)
    first, parts = index.shards()
    taken = [s for a, n in zip(first, parts) if n > 1 for s in range(a, a + n)]
    assert parts.max() > 1 and len(taken) == len(set(taken)) and not set(taken) & {a for a, n in zip(first, parts) if n == 1}
    assert found(ann.top_k(q, index, 10, probes=6, shortlist=40)) == whole


def test_a_loaded_index_answers_alike(spark, data, index):  # noqa: F811
    q = frames(spark, data)[1]
    assert found(ann.top_k(q, ann.load(spark, index.path), 5, probes=4)) == found(ann.top_k(q, index, 5, probes=4))


def test_only_probed_folders_are_read(spark, data, index):  # noqa: F811
    one = frames(spark, data)[1].where("query_id = 'q03'")
    plan = ann.top_k(one, index, 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_codes_are_near_their_vectors():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids, books = ann.train(x[:3000], 20)
    cell, code = ann.encode(x, centroids, books)
    parts = np.stack([books[m][code[:, m]] for m in range(len(books))], axis=1).reshape(len(x), -1)[:, :10]
    left = x - centroids[cell] - parts
    assert code.shape == (4000, 3) and (left ** 2).sum(1).mean() < 0.1


def test_empty_corpus_and_no_queries(spark, data, index, tmp_path):  # noqa: F811
    c, q = frames(spark, data)
    none = ann.build(c.where("false"), str(tmp_path), DIM)
    assert ann.top_k(q, none, 3).count() == 0 and ann.top_k(q.where("false"), index, 3).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_nine_in_ten_of_the_nearest_are_found(spark, sf):
    """With a tenth of the vectors compared at most (all of them are asked with)."""
    t = Tables(spark, f"/root/testdata/{sf}")
    assert REGISTRY.queries["e08_recall"](t).first().recall >= 0.9
    if sf == "sf0.1":
        assert ann.SHORTLIST * 10 <= 0.1 * t.embeddings.count()
