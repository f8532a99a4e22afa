"""String columns. Everything stays a JVM expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligo import constants as K


SPACES = r"(?U)[\s\x1c-\x1f]+"
# fixed value: what counts as white space at the ends of a text
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def strip_sql(sql: str) -> str:
    return "btrim({}, '{}')".format(sql, "".join(f"\\u{ord(ch):04x}" for ch in BLANKS))


def text_or(*cols: Column) -> Column:
    """First value that is neither null nor empty, else null."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def filled(c: Column) -> Column:
    """True where a string is neither null nor empty; never null."""
    return F.coalesce(c != "", F.lit(False))


def clean(c: Column) -> Column:
    """Null becomes '', runs of white space one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))


def clean_sql(sql: str) -> str:
    """:func:`clean` as SQL, for wide projections."""
    return f"trim(regexp_replace(coalesce({sql}, ''), r'{SPACES}', ' '))"


def slug(name: Column) -> Column:
    kept = F.regexp_replace(F.lower(name), r"(?U)[^\w\s-]", "")
    dashed = F.regexp_replace(kept, r"(?U)[\s_-]+", "-")
    return F.left(F.btrim(dashed, F.lit("-")), F.lit(200))


def unique_slug(base: Column, suffix: Column) -> Column:
    return F.when(filled(base), F.concat(F.left(base, F.lit(180)), F.lit("-"), suffix)).otherwise(suffix)


def short_name(name: Column) -> Column:
    """An acronym in parentheses, else the first four words."""
    acronym = F.regexp_extract(name, K.ACRONYM, 1)
    words = F.split(clean(name), " ")
    shortened = F.concat(F.array_join(F.slice(words, 1, 4), " "), F.lit("..."))
    return F.when(acronym != "", acronym).when(F.size(words) > 4, shortened).otherwise(name)


def title_case(c: Column) -> Column:
    """Every run of letters capitalized, so ``new-delhi`` gives ``New-Delhi``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))),
        "",
    )


def map_contained(raw: Column, mapping: dict[str, str], default: str) -> Column:
    """Value of the first key, in the map's order, that occurs in the text."""
    low = strip(F.lower(F.coalesce(raw, F.lit(""))))
    return _first_match(((low.contains(k), v) for k, v in mapping.items()), default)


def map_exact(raw: Column, mapping: dict[str, str], default: str) -> Column:
    low = F.lower(F.coalesce(raw, F.lit("")))
    by_value: dict[str, list[str]] = {}
    for k, v in mapping.items():
        by_value.setdefault(v, []).append(k)
    return _first_match(((low.isin(keys), v) for v, keys in by_value.items()), default)


def _first_match(cases, default: str) -> Column:
    out = F
    for cond, value in cases:
        out = out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default))


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def has_any(text: Column, words: list[str], low: Column | None = None) -> Column:
    """True where any word occurs in the text, letter case aside.

    ``low`` is the text lowered, where a column holds it: else each word may lower the text again.
    """
    low = lowered(text) if low is None else low
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def status_of(raw: Column) -> Column:
    """A status word of a raw record, exact match, unknown words are active."""
    return map_exact(raw, K.STATUSES, "active")


def api_status(raw: Column) -> Column:
    return map_exact(raw, K.API_STATUSES, "active")


def api_level(raw: Column) -> Column:
    return map_contained(raw, K.API_LEVELS, "central")


def rural_urban(text: Column, low: Column | None = None) -> Column:
    rural, urban = has_any(text, ["rural"], low), has_any(text, ["urban"], low)
    return F.when(rural & ~urban, "rural").when(urban & ~rural, "urban").otherwise("both")


def valid_url(c: Column) -> Column:
    return c.rlike(K.URL)


def absolute_url(href: Column, page_url: Column) -> Column:
    """A root-relative link resolved against its page; other links as they are."""
    root = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.when(href.startswith("/"), F.concat(root, href)).otherwise(href)


def canonical_name(name: Column) -> Column:
    """A program name stripped to what identifies it."""
    out = strip(F.lower(F.coalesce(name, F.lit(""))))
    out = F.regexp_replace(out, r"(?U)\bpradhan\s+mantri\b", "pm")
    out = F.regexp_replace(out, r"(?U)\b(?:scheme|programme|yojana|mission)\b", "")
    out = F.regexp_replace(out, r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def dedup_key(code: Column, level: Column, name: Column, ministry: Column) -> Column:
    """``code:<code>:<level>`` where both are known, else ``name:<name>:<ministry>``."""
    code, level = strip(F.coalesce(code, F.lit(""))), strip(F.coalesce(level, F.lit("")))
    home = F.left(strip(F.lower(F.coalesce(ministry, F.lit("")))), F.lit(50))
    return F.when(
        (code != "") & (level != ""), F.concat(F.lit("code:"), code, F.lit(":"), level)
    ).otherwise(F.concat(F.lit("name:"), canonical_name(name), F.lit(":"), home))


def near_keys(key: Column) -> Column:
    """A text and all texts with one character dropped.

    Two texts that differ by one inserted, dropped or changed character share
    at least one of these, so near texts meet in an ordinary equi-join.
    """
    n = F.length(key)
    drops = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.concat(F.left(key, i - 1), F.substr(key, i + 1)),
    )
    return F.array_distinct(F.concat(F.array(key), F.when(n > 0, drops).otherwise(F.array())))
