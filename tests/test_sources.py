"""Parsers on small payloads with known answers."""

from eligo.operators import normalize
from eligo.sources import dispatch, fetches, registry, seed

import pytest

PAYLOAD = "url string, source_id string, status int, content binary, content_type string, error string"


def payloads(spark, *rows):
    return spark.createDataFrame([(u, s, 200, bytearray(c, "utf-8"), None, None) for u, s, c in rows], PAYLOAD).coalesce(1)


def parsed(spark, *rows):
    return [r.asDict(True) for r in dispatch.parse(payloads(spark, *rows)).collect()]


def test_api_envelopes(spark):
    out = parsed(
        spark,
        ("a", "apisetu_myscheme", '{"schemes":[],"data":[{"schemeName":"X","minAge":18,"caste":["SC",null],"annualIncome":1e7,'
                                  '"pwd":"no","state":"A, B"},5,{"title":"T","id":7}]}'),
        ("b", "apisetu_myscheme", '[{"name":"bare"}]'),
        ("c", "apisetu_myscheme", '{"schemes":"abc","data":[{"name":"hidden"}]}'),
        ("d", "apisetu_myscheme", "not json"),
        ("e", "data_gov_in", '{"records":[{"SchemeName":"R"}]}'),
        ("f", "data_gov_in", '[{"SchemeName":"no bare lists"}]'),
        ("g", "elsewhere", '{"title":"G","loan_amount_max":2500000.0,"udyam_required":true}'),
    )
    by_name = {r["name"] or r["title"]: r for r in out}
    assert set(by_name) == {"X", "T", "bare", "R", "G"}
    x = by_name["X"]
    assert x["states"] == ["A", "B"] and x["disability_eligibility"] and float(x["income_limit"]) == 1e7
    assert x["ingest_ord"]["record"] == 0 and by_name["T"]["ingest_ord"]["record"] == 2
    assert by_name["T"]["scheme_code"] == "7"
    assert float(by_name["G"]["loan_amount_max"]) == 2500000.0 and by_name["G"]["udyam_required"]


def test_unreadable_payloads_are_kept_apart(spark):
    p = payloads(spark, ("a", "apisetu_myscheme", "{"), ("b", "data_gov_in", "[]"), ("c", "kvic", "<p>"))
    assert [r.url for r in dispatch.unreadable(p).collect()] == ["a"]


def test_html(spark):
    out = parsed(
        spark,
        ("http://h.x/p", "kvic", '<title>T &amp; t</title><body><nav>no</nav><div id="content"><div>a<p>b</p></div> c'
                                 '<script>var x="</div>";</script></div><p>after</p></body>'),
        ("http://h.x/q", "kvic", "<body>no heading<h1> </h1></body>"),
        ("http://h.x/r", "kvic", '<h1>A <b>B</b></h1><div class="x content"><div>in</div>more'),
        ("http://h.x:8/l", "india_gov_schemes",
         '<ul class="scheme-list"><li><a href="/one">First <b>link</b></a><li><a>Second</a><li><a href="x">abc</a></ul>'
         '<table><tr><td><a href="y">In table</a><td><a>No href here</a></table>'
         '<div class="field-content"><a href="/scheme/1">Field one</a><a href="z">Field two</a></div>'
         '<ul><li><a href="q">Elsewhere</a></ul>'),
        ("http://h.x/c", "myscheme_web",
         '<div class="my-scheme-card"><h3>Card &amp; one</h3><p>Desc <i>d</i></p><a href="/x">go</a></div>'
         '<article data-scheme><p>no name</p></article><section class="schemeCard"><span class="schemeName">Two</span></section>'),
    )
    got = {(r["_source_url"], r["name"]): r for r in out}
    assert got[("http://h.x/p", "T & t")]["description"] == "a b c"
    assert got[("http://h.x/r", "AB")]["description"] == "in more"
    links = {n: got[(u, n)]["application_url"] for u, n in got if u.endswith("/l")}
    assert links == {"Firstlink": "http://h.x:8/one", "Second": "", "In table": "y", "Field one": "http://h.x:8/scheme/1"}
    assert got[("http://h.x/c", "Card & one")]["application_url"] == "/x"
    assert got[("http://h.x/c", "Card & one")]["description"] == "Descd"
    assert ("http://h.x/c", "Two") in got and len(got) == 8


def test_nameless_and_bad_age(spark):
    raw = dispatch.parse(payloads(
        spark, ("a", "apisetu_myscheme", '[{"name":"Good one","minAge":"21"},{"name":"Bad age","maxAge":"old"},{"name":" "}]')))
    assert [r.name for r in normalize.normalize(raw).collect()] == ["Good one"]
    assert [r.name for r in normalize.quarantine(raw).collect()] == ["Bad age"]


def test_unknown_source_is_an_error(spark):
    with pytest.raises(ValueError, match="nowhere"):
        registry.pick(registry.sources(spark), ["kvic", "nowhere"])
    assert registry.pick(registry.sources(spark), None).count() == 8


def test_latest_hash_per_url(spark):
    seen = spark.createDataFrame([("u", "h1", 1), ("u", "h2", 2), ("v", "h3", 1)], "source_url string, content_hash string, checked_at int")
    assert {tuple(r) for r in fetches.latest_hashes(seen).collect()} == {("u", "h2"), ("v", "h3")}


def test_seed_file(spark, tmp_path):
    assert seed.read_seed(spark, str(tmp_path / "none.json")).count() == 0
    path = tmp_path / "seed.json"
    path.write_text('[{"id": "1", "name": "One", "social_categories": ["SC"], "gender_eligibility": ["Any", "Female"],\n'
                    ' "loan_amount_max": 0, "subsidy_percentage": 15.0}, {"id": "2", "name": "Two"}]')
    seeds = seed.read_seed(spark, str(path))
    one = seed.to_response(seeds).where("id = '1'").first()
    assert one.target_demographics == ["SC", "Female"] and one.max_funding_amount is None and one.min_age == 18
    assert seed.to_canonical(seeds).where("id = '1'").first().financial_benefit
