"""Tables that are small as stored and grow on the way are worked on in many tasks."""

import duckdb
import pytest
from pyspark.sql import functions as F

from eligo.registry import REGISTRY
from eligo.registry import normalize as RN
from eligo.registry.common import Tables
from eligo.session import ROWS_PER_TASK, spread
from tests.compare import assert_same

c = F.col
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with parts enough for three tasks, in one file, and the pages."""
    path = str(tmp_path_factory.mktemp("many"))
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    copies = -(-(2 * ROWS_PER_TASK + 1) // part.count())
    part.crossJoin(spark.range(copies)).withColumn("p_partkey", c("p_partkey") + c("id") * 1_000_000).drop("id").coalesce(
        1).write.parquet(f"{path}/part.parquet")
    spark.read.parquet(f"{SMALL}/pages.parquet").write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    for name in ("part", "pages"):
        con.sql(f"create view {name} as select * from '{path}/{name}.parquet/*.parquet'")
    return path, con


def test_rows_are_dealt_and_kept(spark, many):
    part = spark.read.parquet(f"{many[0]}/part.parquet")
    dealt = spread(part, "p_partkey")
    assert dealt.rdd.getNumPartitions() == 3 > part.rdd.getNumPartitions()
    assert dealt.schema.simpleString() == part.schema.simpleString()
    assert dealt.exceptAll(part).isEmpty() and part.exceptAll(dealt).isEmpty()


@pytest.mark.parametrize("name", ["f_raw", "f_schemes", "f_json"])
def test_fixtures_of_a_compact_file(spark, many, name):
    assert getattr(Tables(spark, many[0]), name).rdd.getNumPartitions() == 3


def test_filters_stay_above_the_shuffle(spark, many):
    good = RN.normal(Tables(spark, many[0])).where("data_quality_score >= 60")
    below = good._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "Filter" not in below


def test_odd_json_is_read_in_many_tasks(spark, many):
    assert REGISTRY.queries["a17_odd_json"](Tables(spark, many[0])).rdd.getNumPartitions() == 3


@pytest.mark.parametrize("name", ["a17_odd_json", "b25_documents", "b26_normalize", "b29_snapshot", "d10_versions", "d15_stats"])
def test_results_of_many_tasks(spark, many, name):
    assert_same(REGISTRY.queries[name](Tables(spark, many[0])), REGISTRY.sql[name], many[1])
