"""Joins whose left side may have a hot key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread_by: str | list[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Null-safe equi-join that spreads every key over ``salts`` partitions.

    The right side is repeated once per salt, so it must be the small one (a
    list per state, a score per segment). The salt is a hash of a row's own
    id: a task run again after a lost executor gives the same salt. Where
    Spark sees that the right side fits its broadcast threshold it broadcasts
    instead, and the salt costs nothing.
    """
    renamed = {k: f"_r_{k}" for k in on}
    r = right.withColumnsRenamed(renamed).withColumn(
        "_r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    l = left.withColumn("_salt", F.pmod(F.xxhash64(*([spread_by] if isinstance(spread_by, str) else spread_by)), F.lit(salts)).cast("int"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(v)) for k, v in renamed.items()])
    return l.join(r, same & (F.col("_salt") == F.col("_r_salt")), how).drop(
        "_salt", "_r_salt", *renamed.values()
    )


def salts_for(rows: DataFrame, on: list[str], per_part: int) -> int:
    """So many salts that no key has more than about ``per_part`` rows in one part; the count is of keys, one per row."""
    most = rows.groupBy(*on).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return 1 + most // per_part
