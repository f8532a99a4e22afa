"""Records are worked out once: no filter over what normalization makes lies below it."""

import re

import pytest

from eligo.registry import REGISTRY
from eligo.registry.common import Tables


@pytest.mark.parametrize("name", ["b23_rules", "b25_documents", "b27_category_filter"])
def test_nothing_made_by_normalization_is_filtered_below_it(spark, name):
    df = REGISTRY.queries[name](Tables(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    filters = re.findall(r"(?m)^[ :+\-]*Filter (.*)$", plan)
    assert not [f for f in filters if "named_struct" in f or "concat_ws" in f]
