"""Pages that share a url."""

import duckdb
import pytest
from pyspark.sql import functions as F

from eligo.registry import REGISTRY
from eligo.registry.common import Tables
from tests.compare import assert_same

c = F.col


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """A folder of pages whose urls come twice, with other content."""
    path = str(tmp_path_factory.mktemp("twice"))
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    more = pages.withColumns({"page_id": c("page_id") + 14_000, "html": F.concat("html", F.lit("<p>again</p>"))})
    pages.unionByName(more).coalesce(1).write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{path}/pages.parquet/*.parquet'")
    return path, con


@pytest.mark.parametrize("name", ["d15_error_messages", "i02_newest_fetches"])
def test_pages_that_share_a_url(spark, twice, name):
    assert_same(REGISTRY.queries[name](Tables(spark, twice[0])), REGISTRY.sql[name], twice[1])
