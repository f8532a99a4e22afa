"""Cases of the second review in which less than the whole job was done."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from eligo.llm import jaccard, lines, permutations


def recall(spark, path, n, every, k=20):
    """Of the neighbour search on n unit vectors without any structure, against brute force."""
    x = np.random.default_rng(3).standard_normal((n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))})
    pq.write_table(table, path / "vectors.parquet", row_group_size=20_000)
    got = permutations.nearest(spark.read.parquet(str(path / "vectors.parquet")), every, k).toPandas()
    found = 0
    for q in range(0, n, every):
        score = x @ x[q]
        score[q] = -np.inf
        found += len(set(np.argpartition(-score, k)[:k]) & set(got.vec_id[got.query_id == q]))
    return found / (k * len(range(0, n, every)))


@pytest.mark.parametrize("n", [20_000, 100_000, 600_000])
def test_recall_holds_as_vectors_grow(spark, tmp_path, n):
    assert recall(spark, tmp_path, n, n // 40) >= 0.9


def test_repeated_rows_lose_no_neighbour(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [2.0, 0.0]) for i in range(1, 11) for _ in range(3)] + [(i, [0.5, 0.5]) for i in range(11, 31)]
    rows += [(40, [1.0, 1.0]), (40, [1.0, -1.0])]  # two rows with one id and, for the query, one score
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = permutations.nearest(df, 1000, 20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [*range(1, 11), 40, 40, *range(11, 19)]


def test_double_vectors_lose_no_digit(spark):
    rows = [(0, [0.6, 0.3]), (1, [0.9, 0.4]), (2, [1e39, 1e39]), (3, [0.1, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in permutations.nearest(df, 1000, 20).collect()}
    assert got == {1: 0.6 * 0.9 + 0.3 * 0.4, 2: 0.6 * 1e39 + 0.3 * 1e39, 3: 0.6 * 0.1 + 0.3 * 0.1}


def test_one_row_of_each_group_stays(spark):
    a, b, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abd")
    rows = [(1, a), (2, a), (2, b), (3, d), (3, d), (None, " ".join(f"n{i}" for i in range(60))), (None, " ".join(f"n{i}" for i in range(60))), (None, d)]
    got = jaccard.filter_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in got) == [("1", "a"), ("2", "b"), ("3", "d"), ("None", "n")]


def test_deletion_leaves_other_keys_findable(spark, tmp_path):
    rng = np.random.default_rng(5)
    first = rng.integers(-2 ** 63, 2 ** 63 - 1, (2, 200))
    size = len(lines.cuckoo_insert([], *first)[0])
    # later keys with the prints and the buckets of the first ones, which land in a second table
    k1 = rng.integers(-2 ** 63, 2 ** 63 - 1, 400_000)
    at, picked = lines._first_bucket(k1, size), []
    for i in range(200):
        same = np.flatnonzero(at == lines._first_bucket(first[0][i:i + 1], size)[0])[:4]
        picked += [(k, first[1][i]) for k in k1[same]]
    later = np.array(picked).T

    def pairs(keys):
        return spark.createDataFrame([(int(a), int(b), d) for a, b in keys.T for d in range(lines.MIN_DOCS)], "k1 long, k2 long, doc_id long")

    store = lines.LineStore(spark, str(tmp_path / "store"), shards=1)
    store.insert_pairs(pairs(first))
    store.insert_pairs(pairs(later))
    assert store.filters.first().tables.__len__() > 1
    store._update(pairs(later), -1)
    tables = lines._tables(store.filters.first().tables)
    assert lines.cuckoo_contains(tables, *first).all() and sum(int((t != 0).sum()) for t in tables) == 200
