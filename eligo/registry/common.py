"""How a query is registered: a name, a Spark function, and its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.fixtures import fixture, table, with_duck
from eligo.session import tune

Query = Callable[["Tables"], DataFrame]
c = F.col


class Tables:
    """The given tables and the fixtures derived from them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name) if name.startswith("f_") else table(self.spark, self.sf_dir, name)


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None, uses: str = "") -> None:
        """``uses`` names the fixtures whose definitions go in front of ``sql``."""
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = with_duck(sql, *uses.split()) if uses else sql


def joined(x: Column, by: str = "|") -> Column:
    return F.array_join(x, by)


def big(x) -> Column:
    return (c(x) if isinstance(x, str) else x).cast("bigint")


def case(expr: str, pairs, default: str) -> str:
    """A CASE whose tests come from a mapping; ``expr`` has {k} for the key."""
    whens = " ".join(f"when {expr.format(k=k)} then '{v}'" for k, v in pairs)
    return f"case {whens} else {default} end"


def contained(text: str, mapping: dict[str, str], default: str) -> str:
    return case(f"contains({text}, '{{k}}')", mapping.items(), default)


def exact(text: str, mapping: dict[str, str], default: str) -> str:
    return case(f"{text} = '{{k}}'", mapping.items(), default)


def any_word(text: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def values_list(rows) -> str:
    def lit(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    return "(values " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"
