"""Numbers read from text, and numbers printed into text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligo import constants as K
from eligo.functions.text import has_any, strip


def nonzero(c: Column) -> Column:
    """True where a number is neither null nor zero; never null."""
    return F.coalesce(c != 0, F.lit(False))


def _scaled(text: Column, pattern: str, small_units: bool) -> Column:
    value = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    factor = F.when(unit.startswith("la"), 100_000.0).when(unit.startswith("cr"), 10_000_000.0)
    if small_units:
        factor = factor.when(unit.isin("thousand", "k"), 1_000.0)
    return value * factor.otherwise(1.0)


def parse_amount(text: Column, group_commas: bool = False) -> Column:
    """The first number of a text times its unit.

    A comma ends the number, so "10,00,000" reads as 10; ``group_commas``
    drops commas between digits first.
    """
    if group_commas:
        text = F.regexp_replace(text, r"(?<=\d),(?=\d)", "")
    return _scaled(text, K.AMOUNT, small_units=True)


def income_limit(text: Column) -> Column:
    return _scaled(text, K.INCOME, small_units=False)


def number_texts(text: Column, low: Column) -> dict[str, Column]:
    """The text where it can hold an age from, an age up to, or an income, else ''; ``low`` is the text lowered.

    Patterns look at every place of a text; the words they cannot do without are found much faster.
    """
    return {name: F.when(has_any(text, words, low), text).otherwise("") for name, words in K.NUMBER_WORDS.items()}


def parse_float(text: Column) -> Column:
    return strip(text).try_cast("double")


def parse_bool(text: Column) -> Column:
    """Null stays null; a few words are true; all else is false."""
    return F.when(text.isNotNull(), F.lower(text).isin(K.TRUE_WORDS))


def parse_int(text: Column) -> Column:
    return strip(text).try_cast("int")


def age_min(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, K.AGE_MIN, 1), F.lit("")).try_cast("int")


def age_max(text: Column, ages_only: bool = False) -> Column:
    """The number after "below", "max" or "up to".

    Any such number counts, "up to 10 lakh" too; with ``ages_only`` one that
    carries a money unit does not.
    """
    pattern = K.AGE_MAX + (r"(?!\d|\.\d|\s*(?:lakh|lac|crore|cr\b|thousand|%))" if ages_only else "")
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def plain_float_sql(sql: str) -> str:
    """A double as text without an exponent: ``500000.0``, ``7.25``."""
    digits = f"cast(cast({sql} as decimal(38,10)) as string)"
    return f"regexp_replace(regexp_replace({digits}, '0+$', ''), '[.]$', '.0')"
