"""Which parser reads which source."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.sources import html_records as H
from eligo.sources import json_records as J

Parser = Callable[[DataFrame], DataFrame]

PARSERS: dict[str, Parser] = {
    "apisetu_myscheme": J.portal_api,
    "myscheme_web": H.card_listing,
    "india_gov_schemes": H.link_listing,
    "data_gov_in": J.open_data_api,
    "national_services_portal": H.link_listing,
    "msme_ministry": H.ministry_page,
    "mudra_portal": H.ministry_page,
    "standupmitra": H.ministry_page,
    "kvic": H.ministry_page,
}


def parse(payloads: DataFrame, parsers: dict[str, Parser] | None = None,
          default: Parser = J.generic) -> DataFrame:
    """Raw records of all payloads, each read by its source's parser.

    ``parsers`` adds to or replaces the built-in ones: any function from a
    DataFrame of payloads to one of raw records. Sources with the same parser
    share one branch; on payloads landed by source a branch reads only its own
    folders.
    """
    table = {**PARSERS, **(parsers or {})}
    groups: dict[Parser, list[str]] = {}
    for source_id, parser in table.items():
        groups.setdefault(parser, []).append(source_id)
    source = F.col("source_id")
    branches = [p(payloads.where(source.isin(ids))) for p, ids in groups.items()]
    rest = payloads.where(source.isNull() | ~source.isin(list(table)))
    return reduce(DataFrame.unionByName, [*branches, default(rest)])


def unreadable(payloads: DataFrame) -> DataFrame:
    """Payloads of JSON sources that are no JSON; they give no record."""
    page_sources = [k for k, p in PARSERS.items() if p.__module__ == H.__name__]
    docs = J.parsed(payloads.where(~F.coalesce(F.col("source_id").isin(page_sources), F.lit(False))))
    return docs.where(F.col("doc").isNull()).drop("doc", "content")
