"""Column functions on hand-worked values, the odd cases first."""

import pytest
from pyspark.sql import functions as F

from eligo.functions import lists as L
from eligo.functions import numbers as N
from eligo.functions import text as X
from eligo.sources import html_records as H


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


CASES = [
    # letters of a key count wherever they stand
    (lambda: L.social_categories(L.empty(), F.lit("any scheme for assistance")), ["SC", "ST"]),
    (lambda: L.social_categories(L.empty(), F.lit("any scheme for st applicants"), True), ["ST"]),
    (lambda: L.genders(L.empty(), F.lit("for women and male youth")), ["Female", "Male"]),
    (lambda: L.genders(L.empty(), F.lit("female and male")), ["Female"]),
    (lambda: L.genders(L.split_text(F.lit("trans; Other")), F.lit("")), ["Transgender"]),
    (lambda: L.genders(L.empty(), F.lit("")), ["Any"]),
    (lambda: L.split_text(F.lit(" a, b;;c/ ")), ["a", "b", "c"]),
    (lambda: X.map_contained(F.lit("Union Territory"), {"union": "central", "ut": "union_territory"}, "x"), "central"),
    (lambda: X.api_level(F.lit("UT plan")), "union_territory"),
    (lambda: X.api_level(F.lit(None).cast("string")), "central"),
    (lambda: X.status_of(F.lit("MERGED")), "merged"),
    (lambda: X.api_status(F.lit("merged")), "active"),
    (lambda: N.age_max(F.lit("loans up to 10 lakh")), 10),
    (lambda: N.age_max(F.lit("loans up to 10 lakh"), True), None),
    (lambda: N.age_max(F.lit("up to 45 years"), True), 45),
    (lambda: N.age_min(F.lit("Age 21 yrs and above")), 21),
    (lambda: N.age_min(F.lit("adults")), None),
    (lambda: N.parse_amount(F.lit("10,00,000")), 10.0),
    (lambda: N.parse_amount(F.lit("10,00,000"), True), 1000000.0),
    (lambda: N.parse_amount(F.lit("₹ 2.5 Crores")), 25000000.0),
    (lambda: N.parse_amount(F.lit("50k")), 50000.0),
    (lambda: N.parse_amount(F.lit("none")), None),
    (lambda: N.income_limit(F.lit("family income not exceeding Rs. 3 lakh")), 300000.0),
    (lambda: N.parse_float(F.lit(" 7.5 ")), 7.5),
    (lambda: N.parse_float(F.lit("7%")), None),
    (lambda: N.parse_bool(F.lit("Required")), True),
    (lambda: N.parse_bool(F.lit("maybe")), False),
    (lambda: N.parse_bool(F.lit(None).cast("string")), None),
    (lambda: F.expr(N.plain_float_sql("1e7")), "10000000.0"),
    (lambda: F.expr(N.plain_float_sql("7.25D")), "7.25"),
    (lambda: X.clean(F.lit(" a\t b\n ")), "a b"),
    (lambda: X.slug(F.lit("Énergie & Co. (X)_2 ")), "énergie-co-x-2"),
    (lambda: X.short_name(F.lit("Long Name Of Some Program (LNSP)")), "LNSP"),
    (lambda: X.short_name(F.lit("one two three four five")), "one two three four..."),
    (lambda: X.title_case(F.lit("new-delhi o'NEIL")), "New-Delhi O'Neil"),
    (lambda: X.canonical_name(F.lit("Pradhan  Mantri Mudra-Yojana Scheme")), "pm mudra"),
    (lambda: X.dedup_key(F.lit(" A1 "), F.lit("central"), F.lit("x"), F.lit("y")), "code:A1:central"),
    (lambda: X.dedup_key(F.lit(""), F.lit("central"), F.lit("X Scheme"), F.lit(" Min ")), "name:x:min"),
    (lambda: X.unique_slug(F.lit(""), F.lit("ab")), "ab"),
    (lambda: X.absolute_url(F.lit("/p?q"), F.lit("https://h.org:8080/a/b")), "https://h.org:8080/p?q"),
    (lambda: X.absolute_url(F.lit("p"), F.lit("https://h.org/a")), "p"),
    (lambda: X.rural_urban(F.lit("Urban and rural")), "both"),
    (lambda: X.valid_url(F.lit("https://a-b.example.org:80/x?y")), True),
    (lambda: X.valid_url(F.lit("http://localhost/")), False),
    (lambda: H.unescape(F.lit("a &amp; b &eacute;&#8377;&#x20b9; &bogus; &")), "a & b é₹₹ &bogus; &"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_function(spark, i):
    build, expected = CASES[i]
    assert value(spark, build()) == expected
