"""Parsers as table-valued functions: one payload in, any number of records out, with the columns its declaration names.

A user gives a plain function from the payload's bytes and url to dictionaries, and the columns as DDL, which travel as the
schema's JSON. The function is called
laterally, per payload, in the Python workers; the columns are worked out when the query is analyzed (``analyze``), so one
function class serves every declaration. A payload that the function cannot read (it raises ValueError) gives no record.
"""

from __future__ import annotations

import json

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from eligo import schemas as S
from eligo.operators import conform
from eligo.sources.json_records import with_ord

Read = Callable[[bytes, str], Iterable[dict]]


def register(spark: SparkSession, name: str, read: Read) -> None:
    """Makes ``read`` callable in SQL as ``name(content, url, schema)``, a lateral table function."""
    class Parser:
        @staticmethod
        def analyze(content: AnalyzeArgument, url: AnalyzeArgument, schema: AnalyzeArgument) -> AnalyzeResult:
            if not schema.isConstantExpression or schema.value is None:
                raise ValueError("the columns must be a constant text")
            fields = StructType.fromJson(json.loads(schema.value)).fields
            return AnalyzeResult(StructType([StructField("record_index", IntegerType()), *fields]))

        def eval(self, content: bytes, url: str, schema: str) -> Iterator[tuple]:
            names = [x["name"] for x in json.loads(schema)["fields"]]
            try:
                for i, record in enumerate(read(bytes(content), url) if content is not None else ()):
                    yield i, *(record.get(n) for n in names)
            except ValueError:
                return

    spark.udtf.register(name, F.udtf(Parser))


def parser(name: str, ddl: str, source_id: str) -> Callable[[DataFrame], DataFrame]:
    """A parser for ``dispatch.parse`` from a registered function; columns it does not declare are null."""
    def parse(payloads: DataFrame) -> DataFrame:
        schema = StructType.fromDDL(ddl)
        called = payloads.sparkSession.sql(
            f"select p.* except (content), r.* from {{payloads}} as p, lateral {name}(p.content, p.url, :schema) as r",
            args={"schema": schema.json()}, payloads=payloads)
        rows = with_ord(called).withColumns({"_source_id": F.lit(source_id), "_source_url": F.col("url")})
        own = schema.names
        kept = [x for x in ("ingest_ord", "content_hash", "_source_id", "_source_url") if x in rows.columns]
        return conform(rows.select(*kept, *[x for x in own if x not in kept]), S.RAW)
    return parse
