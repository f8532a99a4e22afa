"""Array columns: list extraction, synonym lookup, set tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligo import constants as K
from eligo.functions.text import has_any, lowered, strip

EMPTY = "array<string>"


def empty() -> Column:
    return F.array().cast(EMPTY)


def or_empty(c: Column) -> Column:
    return F.coalesce(c, empty())


def split_text(c: Column, pattern: str = "[,;/]") -> Column:
    """Parts of a text between separators, trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), pattern), strip)
    return F.filter(parts, lambda x: x != "")


def trim_items(c: Column) -> Column:
    """Trimmed items of a list; null and empty items are dropped first."""
    kept = F.filter(or_empty(c), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.transform(kept, strip)


def lower_all(c: Column) -> Column:
    return F.transform(or_empty(c), lambda x: F.lower(x))


def _mapped(items: Column, mapping: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    table = F.create_map(*pairs)
    return F.array_compact(F.transform(trim_items(items), lambda x: F.try_element_at(table, F.lower(x))))


def _scan(text: Column, mapping: dict[str, str], whole_words: bool, low: Column | None = None) -> Column:
    """Values of all keys that occur in the text."""
    low = lowered(text) if low is None else low

    def hit(k: str) -> Column:
        return low.rlike(rf"(?U)\b{k}\b") if whole_words else low.contains(k)

    return F.array_compact(F.array(*[F.when(hit(k), F.lit(v)) for k, v in mapping.items()]))


def _sorted_set(*lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*lists)))


def genders(items: Column, text: Column, low: Column | None = None) -> Column:
    """Genders named in a list or a text; none named means any. ``low``, here and below: the text lowered, where a column holds it."""
    female = has_any(text, K.FEMALE_WORDS, low)
    male = has_any(text, ["male"], low) & ~has_any(text, ["female"], low)
    scanned = F.array_compact(F.array(F.when(female, F.lit("Female")), F.when(male, F.lit("Male"))))
    found = _sorted_set(_mapped(items, K.GENDERS), scanned)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Any")))


def social_categories(items: Column, text: Column, whole_words: bool = False, low: Column | None = None) -> Column:
    """Categories named in a list, or by a key that occurs in a text.

    A key counts wherever its letters stand ("sc" in "scheme"); with
    ``whole_words`` only as a word of its own.
    """
    return _sorted_set(
        _mapped(items, K.SOCIAL_CATEGORIES), _scan(text, K.SOCIAL_CATEGORIES, whole_words, low)
    )


def business_types(items: Column, text: Column, whole_words: bool = False, low: Column | None = None) -> Column:
    return _sorted_set(_mapped(items, K.BUSINESS_TYPES), _scan(text, K.BUSINESS_TYPES, whole_words, low))
