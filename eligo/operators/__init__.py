"""DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the schema's columns; absent ones are null."""
    have = set(df.columns)
    return df.selectExpr(*[
        f"cast({f'`{f.name}`' if f.name in have else 'null'} as {f.dataType.simpleString()}) as `{f.name}`"
        for f in schema.fields
    ])
