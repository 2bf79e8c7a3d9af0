from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vakanz.functions import parse, text, urls
from vakanz.operators import listing, pages


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    row = tuple(values.values()) or (None,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first().r


def evaluate(spark, fn, value):
    return one(spark, fn(F.col("v")), v=value)


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p>Direkte <b>Unterstuetzung</b> der Geschaeftsfuehrung</p>",
         "Direkte Unterstuetzung der Geschaeftsfuehrung"),
        ("<h2>Aufgaben</h2><ul><li>Eins</li><li>Zwei</li></ul>", "## Aufgaben\n- Eins\n- Zwei"),
        ("<p>a</p>\n<ul>\n<li>x</li></ul>", "a\n\n- x"),
        ("<script>var a='<p>';</script>Text<style>p{}</style><!-- no -->", "Text"),
        ("A &amp; B &#8364; &#x20AC; &uuml;&nbsp;&lt;b&gt;", "A & B € € ü <b>"),
        ("<p>&amp;lt;tag&amp;gt; &unknown; &</p>", "<tag> &unknown; &"),
        ("plain  text \r\n\r\n\r\n more", "plain text\n\nmore"),
        ("<div>unclosed <script>x", "unclosed"),
        (None, ""),
    ],
)
def test_visible_text(spark, html, expected):
    assert evaluate(spark, text.visible_text, html) == expected


def test_fold_and_keys(spark):
    assert evaluate(spark, text.fold, "Straße ẞ") == "strasse ss"
    assert evaluate(spark, text.key_part, "  Office-Manager (m/w/d) ") == "office manager m w d"
    assert evaluate(spark, text.normalize_text, " A  B\n") == "a b"


def test_excerpt(spark):
    assert evaluate(spark, text.excerpt, "short  text") == "short text"
    long = evaluate(spark, text.excerpt, "wort " * 100)
    assert long.endswith("wort…") and len(long) <= 280


def test_text_chunks_bounds_and_content(spark):
    source = "Eins zwei drei. " * 60 + "x" * 600 + " " + "lang " * 150 + ". Ende gut."
    chunks = evaluate(spark, text.text_chunks, source.strip())
    assert all(0 < len(c) <= 520 for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(source.split())


@pytest.mark.parametrize(
    "body, expected",
    [(" der die und ", "de"), (" the and ", "en"), ("nothing", None), (" der the ", "de"), ("xfürx", "de")],
)
def test_language_guess(spark, body, expected):
    assert evaluate(spark, lambda c: text.language_guess(F.lit(""), c), body) == expected


def test_redact(spark):
    values = F.array(F.lit("Jane Doe"), F.lit("jane@x.de"), F.lit("Doe"), F.lit(""))
    source = "JANE DOE | jane@x.de\nText von Jane Doe.\n  \nDoe"
    assert evaluate(spark, lambda c: text.redact(c, values), source) == "Text von ."


@pytest.mark.parametrize(
    "line, expected",
    [("Tel: +49 711 123456", ["+49 711 123456"]), ("geb. 01.02.1980 0711 123456", []), ("Nr 12", [])],
)
def test_phones(spark, line, expected):
    assert evaluate(spark, text.phones, line) == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://Example.COM/a/?b=2&a=1&utm_source=x&fbclid=1#top", "https://example.com/a?a=1&b=2"),
        ("https://x.de", "https://x.de/"),
        ("https://x.de/p?q=a%20b&r", "https://x.de/p?q=a+b&r="),
        ("ftp://x.de/", None),
        ("/relative", None),
    ],
)
def test_canonical_url(spark, url, expected):
    assert evaluate(spark, urls.canonical_url, url) == expected


@pytest.mark.parametrize(
    "url, expected",
    [("https://a.de/x", True), ("https://u:p@a.de/", False), ("javascript:alert(1)", False), ("https://a.de/\n", False)],
)
def test_safe_url(spark, url, expected):
    assert (evaluate(spark, urls.safe_url, url) is not None) is expected


@pytest.mark.parametrize(
    "url, weak, strong",
    [
        ("https://a.de/jobs/office-manager", True, False),
        ("https://a.de/jobs/office-manager-123", True, True),
        ("https://a.de/jobs/view/77", True, True),
        ("https://a.de/karriere/stelle-1/", True, True),
        ("https://a.de/about", False, False),
        ("https://a.de/x?gh_jid=5", True, True),
    ],
)
def test_job_like(spark, url, weak, strong):
    assert evaluate(spark, urls.job_like, url) is weak
    assert evaluate(spark, urls.strong_job_like, url) is strong


def test_page_links(spark):
    html = '<a href="/a">x</a><a class="b" href=\'b.html\'>y</a><a href="mailto:x@y">z</a><a href="/a">x</a>'
    links = evaluate(spark, lambda c: urls.page_links(F.lit("https://x.de/d/p.html"), c), html)
    assert links == ["https://x.de/a", "https://x.de/d/b.html"]


@pytest.mark.parametrize(
    "provider, url, expected",
    [
        ("personio", "https://Acme.jobs.personio.de/job/1", "acme"),
        ("greenhouse", "https://boards.greenhouse.io/embed/job_board?for=acme", "acme"),
        ("greenhouse", "https://boards.greenhouse.io/acme/jobs/1", "acme"),
        ("lever", "https://jobs.lever.co/acme", "acme"),
        ("join", "https://join.com/companies/acme/1", "acme"),
        ("recruitee", "https://acme.recruitee.com/", "acme"),
        ("lever", "https://evil.example/acme", None),
        ("workday", "https://acme.wd3.myworkdayjobs.com/site/", "https://acme.wd3.myworkdayjobs.com/site"),
    ],
)
def test_board_identifier(spark, provider, url, expected):
    assert evaluate(spark, lambda c: urls.board_identifier(c, F.lit(provider)), url) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("1767225600", datetime(2026, 1, 1)),
        ("1767225600000", datetime(2026, 1, 1)),
        ("2026-01-01T01:00:00+01:00", datetime(2026, 1, 1)),
        ("2026-01-01T00:00:00Z", datetime(2026, 1, 1)),
        ("2026-01-01", datetime(2026, 1, 1)),
        ("01.02.2026", datetime(2026, 2, 1)),
        ("Wed, 22 Jul 2026 10:00:00 +0200", datetime(2026, 7, 22, 8)),
        ("Wed, 22 Jul 2026 10:00:00 GMT", datetime(2026, 7, 22, 10)),
        ("soon", None),
        ("", None),
    ],
)
def test_parse_timestamp(spark, value, expected):
    assert evaluate(spark, parse.parse_timestamp, value) == expected


@pytest.mark.parametrize(
    "value, expected",
    [("Deutschland", "DE"), (None, "DE"), ("U.K.", "GB"), ("se", "SE"), ("Narnia", "ZZ")],
)
def test_country_code(spark, value, expected):
    assert evaluate(spark, parse.country_code, value) == expected


@pytest.mark.parametrize(
    "value, expected",
    [("Worldwide", True), ("USA", False), ("Anywhere, US only", False), (None, True), ("DE", True), ("Remote", True)],
)
def test_geo_eligible(spark, value, expected):
    assert evaluate(spark, parse.geo_eligible, value) is expected


@pytest.mark.parametrize(
    "value, expected",
    [('["a", {"name": "b"}, null, 3]', ["a", "b", "3"]), ("plain", ["plain"]), (None, []),
     ('{"x": true, "y": false}', ["x"]), ('"q"', ["q"])],
)
def test_coerce_list(spark, value, expected):
    assert evaluate(spark, parse.coerce_list, value) == expected


def test_remote_type(spark):
    places = F.array(F.lit("70173 Stuttgart, Baden-Wuerttemberg"))
    assert one(spark, parse.remote_type(F.lit(None).cast("string"), F.lit(True), places)) == "hybrid"
    assert one(spark, parse.remote_type(F.lit(None).cast("string"), F.lit(True), F.array(F.lit("Remote, Deutschland")))) == "remote"
    assert one(spark, parse.remote_type(F.lit("On-site"), F.lit(True), places)) == "onsite"


def test_location_parts(spark):
    code, city, state = parse.location_parts(F.array(F.lit("70173 Stuttgart, Baden-Wuerttemberg")))
    row = spark.range(1).select(code.alias("c"), city.alias("o"), state.alias("s")).first()
    assert tuple(row) == ("70173", "Stuttgart", "Baden-Württemberg")


def test_title_rules(spark):
    terms = ("Assistenz der Geschäftsführung",)
    assert evaluate(spark, lambda c: listing.title_token_subset(c, terms), "Geschäftsführung: Assistenz (m/w)") is True
    assert evaluate(spark, lambda c: listing.title_token_subset(c, terms), "Assistenz") is False
    assert evaluate(spark, lambda c: listing.title_matches(c, terms), "Neue ASSISTENZ  der Geschäftsführung") is True


def test_search_escapes_wildcards(spark):
    hit = lambda q, **kw: evaluate(spark, lambda c: listing.search_text([c], q, **kw), "100% Remote")
    assert hit("0% r") is True
    assert hit("1%Rem") is False
    assert hit("1%Rem", wildcards=True) is True


def test_titles(spark):
    assert evaluate(spark, pages.generic_title, " Careers - ") is True
    assert evaluate(spark, pages.heading_title, "x\n# Office  Manager \n") == "Office Manager"
    assert evaluate(spark, pages.title_from_url, "https://a.de/jobs/office-manager_x") == "Office Manager X"


def pack(source, maximum=520):
    """Plain packing of sentences, written for comparison only."""
    import re

    chunks, current = [], ""
    for sentence in re.split(r"(?<=[.!?])\s+(?=[A-ZÄÖÜ0-9])", source):
        words, pieces, line = sentence.split(" "), [], ""
        if len(sentence) <= maximum:
            pieces = [sentence]
        else:
            for word in words:
                while len(word) > maximum and not line:
                    pieces, word = [*pieces, word[:maximum]], word[maximum:]
                if line and len(line) + 1 + len(word) > maximum:
                    pieces, line = [*pieces, line], word
                else:
                    line = f"{line} {word}".strip()
            pieces = [*pieces, line] if line else pieces
        for i, piece in enumerate(pieces):
            cut = len(pieces) > 1
            joined = f"{current} {piece}".strip()
            if current and (cut or len(joined) > maximum):
                chunks.append(current)
                current = piece
            else:
                current = joined
    return [*chunks, current] if current else chunks


def test_text_chunks_equal_plain_packing(spark):
    import random

    rng = random.Random(3)
    texts = []
    for _ in range(40):
        words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 400))]
        texts.append(" ".join(w.capitalize() + "." if rng.random() < rng.choice((0.02, 0.2)) else w for w in words))
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r.c for r in df.select(text.text_chunks(F.col("v")).alias("c")).collect()]
    assert got == [pack(t) for t in texts]
