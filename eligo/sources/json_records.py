"""JSON payloads to raw records, through the VARIANT type.

What that type refuses though it can be read (keys given twice, of which the last counts, NaN and infinities, which count as
null, byte order marks) is read by Python's parser, in Arrow batches, and written again as plain JSON.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligo import schemas as S
from eligo.functions import text as X
from eligo.operators import conform
from eligo.sources.fetches import decoded

c = F.col
# fixed values: JSON texts that count as "not given"
FALSY = ["null", '""', "0", "0.0", "-0.0", "false", "[]", "{}"]


def _list(v: Column) -> Column:
    """A list's values; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _dict(v: Column) -> Column:
    """An object's members; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _holds(v: Column) -> Column:
    return ~F.to_json(v).isin(FALSY)


def given(members: Column, blanks: bool = False) -> Column:
    """The members of an object that hold something, with their values spelled out.

    Null, blank, zero, false and empty values count as not given, as they do where a field is the first of several that
    holds something. With ``blanks`` only null does, and ``holds`` says which of the others hold something. A value keeps
    its text (numbers without an exponent), its items if it is a list, and
    whether it was a quoted text. Worked out once per object; the fields below
    are look-ups in this map.
    """
    def spell(_, m: Column) -> Column:
        x, js = m["v"], m["js"]
        number = js.rlike("^-?[0-9]") & js.contains("E")
        return F.struct(
            F.when(number, x.cast("double").cast("decimal(38,6)").cast("string")).otherwise(x.cast("string")).alias("text"),
            F.when(js.startswith("["), F.try_variant_get(x, "$", "array<string>")).alias("items"),
            js.startswith('"').alias("quoted"),
            (~js.isin(FALSY)).alias("holds"),
        )

    # inside a lambda nothing that comes twice is worked out once, so each value's JSON is kept beside it
    told = F.transform_values(members, lambda _, x: F.struct(x.alias("v"), F.to_json(x).alias("js")))
    return F.transform_values(F.map_filter(told, lambda _, m: m["js"] != "null" if blanks else ~m["js"].isin(FALSY)), spell)


# Field readers: SQL over ``rec``, the map of given values.

def text(*keys: str) -> str:
    """First given value among the keys, as text."""
    return "coalesce(" + ", ".join(f"rec['{k}'].text" for k in keys) + ", null)"


def items(*keys: str, separators: str = "[,;/]") -> str:
    """First given value as a list: a list's items, or the parts of a text."""
    def one(k: str) -> str:
        parts = f"transform(split(rec['{k}'].text, '{separators}'), x -> {X.strip_sql('x')})"
        return (f"case when rec['{k}'].items is not null then rec['{k}'].items "
                f"when rec['{k}'].quoted then filter({parts}, x -> x <> '') "
                f"when rec['{k}'] is not null then cast(array() as array<string>) end")

    return "coalesce(" + ", ".join(one(k) for k in keys) + ", cast(array() as array<string>))"


def flag(*keys: str) -> str:
    return "(" + " or ".join(f"coalesce(rec['{k}'].holds, false)" for k in keys) + ")"


def _plain(value):
    """A parsed value without numbers that JSON has no text for."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _rewritten(text: str | None) -> str | None:
    try:
        return json.dumps(_plain(json.loads(text.removeprefix("\ufeff"))), ensure_ascii=False) if text else None
    except (ValueError, RecursionError):
        return None


def lenient(text: Column) -> Column:
    """The JSON texts that Python's parser reads, written again; null for others."""
    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        return texts.map(_rewritten, na_action="ignore").astype(object)

    return rewrite(text)


def parsed(payloads: DataFrame) -> DataFrame:
    """Adds ``doc``, the payload as a variant; null where it is no JSON."""
    docs = payloads.withColumn("_text", decoded(c("content"))).withColumn("doc", F.try_parse_json("_text"))
    # only refused texts go through Python
    again = docs.withColumn("_again", lenient(F.when(c("doc").isNull(), c("_text"))))
    return again.withColumn("doc", F.coalesce("doc", F.try_parse_json("_again"))).drop("_text", "_again")


def unwrap(docs: DataFrame, keys: list[str], bare_list: bool = True) -> DataFrame:
    """One row per object of a list envelope: (.., record_index, rec).

    The list is the document itself or its first given key; a key that holds
    something else than a list gives no record and hides the keys after it.
    """
    top = docs.withColumn("_members", _dict(c("doc")))
    listed = F.array(*[c("_members")[k] for k in keys])
    first = F.get(F.filter(listed, _holds), 0)
    bare = _list(c("doc")) if bare_list else F.lit(None).cast("array<variant>")
    return objects(top.withColumn("_records", F.coalesce(_list(first), bare)).drop("_members"))


def objects(docs: DataFrame, blanks: bool = False) -> DataFrame:
    """One row per object among the ``_records`` of a document, with its given values."""
    each = docs.drop("doc", "content").select("*", F.posexplode("_records").alias("record_index", "rec"))
    members = each.drop("_records").withColumn("rec", _dict(c("rec"))).where(c("rec").isNotNull())
    return members.withColumn("rec", given(c("rec"), blanks))


def with_ord(df: DataFrame) -> DataFrame:
    """Arrival order: source, then url, then payload (by its hash, should a url have been fetched twice), then place in it.

    Only records that are equal in all of these can tie, and they say the same.
    """
    rank = c("source_rank") if "source_rank" in df.columns else F.lit(0)
    return df.withColumn("ingest_ord", F.struct(
        rank.cast("int").alias("source"), c("url"), _hash_of(df).alias("fetch"), c("record_index").cast("int").alias("record")))


def _hash_of(df: DataFrame) -> Column:
    return c("content_hash") if "content_hash" in df.columns else F.lit(None).cast("string")


def _records(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Raw records from field definitions in SQL."""
    out = rows.withColumn("content_hash", _hash_of(rows))
    return conform(out.selectExpr(
        "ingest_ord", "content_hash", "url as _source_url", *[f"{sql} as `{n}`" for n, sql in fields.items()]), S.RAW)


def portal_api(payloads: DataFrame) -> DataFrame:
    """The listing API: 22 fields, each with its spellings."""
    rows = with_ord(unwrap(parsed(payloads), ["schemes", "data", "results", "items"]))
    return _records(rows, {
        "_source_id": "'apisetu_myscheme'",
        "name": text("schemeName", "name", "title"),
        "scheme_code": text("schemeId", "scheme_id", "id"),
        "description": text("schemeDescription", "description"),
        "ministry": text("ministry", "nodal_ministry"),
        "department": text("department"),
        "implementing_agency": text("implementingAgency", "implementing_agency"),
        "government_level": text("level", "schemeType"),
        "states": items("state", "states", "applicableStates", separators=","),
        "beneficiary_types": items("targetBeneficiary", "beneficiary"),
        "gender_eligibility": items("gender"),
        "social_categories": items("caste", "socialCategory"),
        "age_min": text("minAge", "ageMin"),
        "age_max": text("maxAge", "ageMax"),
        "income_limit": text("annualIncome", "incomeLimit"),
        "disability_eligibility": flag("disability", "pwd"),
        "eligibility_text": text("eligibility", "eligibilityCriteria"),
        "benefits_text": text("benefits", "schemeDetails"),
        "application_url": text("applicationUrl", "applyLink"),
        "official_application_url": text("officialUrl", "applicationUrl"),
        "business_types": items("sector", "categories"),
        "udyam_required": flag("udyamRequired"),
        "status": text("status"),
        "source_type": "'api'",
    }).withColumns({
        "government_level": X.api_level(c("government_level")), "status": X.api_status(c("status")),
    })


def open_data_api(payloads: DataFrame) -> DataFrame:
    """The open-data API: records or data, five fields."""
    rows = with_ord(unwrap(parsed(payloads), ["records", "data"], bare_list=False))
    return _records(rows, {
        "_source_id": "'data_gov_in'",
        "name": text("scheme_name", "SchemeName", "title"),
        "ministry": text("ministry", "Ministry"),
        "description": text("description", "Description"),
        "benefits_text": text("benefits", "Benefits"),
        "eligibility_text": text("eligibility", "Eligibility"),
        "source_type": "'api'",
    })


def generic(payloads: DataFrame) -> DataFrame:
    """Any other JSON: each object is a record, its known keys are kept with the values they have, 0 and false included."""
    docs = parsed(payloads)
    one = F.when(_dict(c("doc")).isNotNull(), F.array(c("doc")))
    rows = with_ord(objects(docs.withColumn("_records", F.coalesce(_list(c("doc")), one)), blanks=True))
    own = {"ingest_ord", "content_hash", "_source_url"}
    readers = {"boolean": flag, "array<string>": items}
    return _records(rows, {
        f.name: readers.get(f.dataType.simpleString(), text)(f.name) for f in S.RAW.fields if f.name not in own})
