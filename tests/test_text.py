from pyspark.sql import functions as F
import pytest

from docmarket.functions import text as T
from docmarket.sources import feeds



@pytest.mark.parametrize(
    "raw,want",
    [
        (None, ""), ("", ""), ("<p>a&amp;b</p>", "a&b"), ("&lt;b&gt;x", "x"), ("&amp;lt;b", "&lt;b"), ("caf&#233; &#x41;&nbsp;z", "café A z"),
        ("<SCRIPT>var x = '<b>';</SCRIPT>y<style>p{}</style> z", "y z"), ("AT&T & co", "AT&T & co"),
    ],
)
def test_strip_html(one, raw, want):
    assert one(T.strip_html(F.col("t")), raw) == want


def test_clip(one):
    text = "First sentence is here and long enough. Second part goes on and on without an end"
    assert one(T.clip(F.col("t"), 60), text) == "First sentence is here and long enough...."
    assert one(T.clip(F.col("t"), 200), text) == text
    assert one(T.clip(F.col("t"), 40), "word " * 20) == "word word word word word word word..."


@pytest.mark.parametrize("raw,want", [("camelCaseABCDef", "camel case abc def"), ("C++ Dev/Ops", "c++ dev ops"), (None, "")])
def test_clean_label(one, raw, want):
    assert one(T.clean_label(F.col("t")), raw) == want


@pytest.mark.parametrize("raw,want", [("A.I. and node.js", "ai and node js"), ("U.S.A.", "usa"), ("R&D", "r and d"), ("C# / C++", "c# c++"), ("a.b", "a b")])
def test_fold_term(one, raw, want):
    assert one(T.fold_term(F.col("t")), raw) == want


@pytest.mark.parametrize(
    "hay,needle,want",
    [
        ("senior data analyst", "data analyst", True), ("dataanalyst", "data analyst", True), ("led enabled", "led", True), ("enabled", "led", False),
        ("myfrontendjob", "frontend", True), ("c++ developer", "c++", False), ("x", "", False), ("c++x", "c++", True),
    ],
)
def test_contains_phrase(one, hay, needle, want):
    # one word with a plus sign needs a word character after it, as a word boundary does
    assert one(T.contains_phrase(F.col("t"), F.lit(needle)), hay) is want


def test_dates(one):
    as_of = F.lit("2024-05-17").cast("date")
    parse = lambda s: one(T.parse_partial_date(F.col("t"), as_of).cast("string"), s)
    assert [parse(s) for s in ("Sept 2020", "13/2020", "02/2021", "1999", "Present", "soon")] == ["2020-09-01", None, "2021-02-01", "1999-01-01", "2024-05-01", None]


def test_links(one):
    text = "see https://x.io https://github.com/a https://x.io http://SCIFIIT.example"
    assert one(T.audit_urls(F.col("t")), text) == 3
    assert one(F.size(T.contact_links(T.urls(F.col("t")))), text) == 1
    contact = one(T.extract_contact(F.col("t"), F.array(F.lit("mailto:a@b.co"), F.lit(" https://x.io "))), "me a.b@c.org +1 5551234567")
    assert contact["email"] == "a.b@c.org" and contact["phone"].strip() and contact["links"] == ["https://x.io"]


def test_timestamps(one):
    sec = lambda s: one(F.unix_timestamp(feeds.parse_timestamp_any(F.col("t"))), s)
    assert [sec(s) for s in ("1970-01-01T00:00:10Z", "10", "10000000001000", "later", None)] == [10, 10, 10000000001, None, None]


def test_dedupe_adjacent(one):
    assert one(T.dedupe_adjacent_words(F.col("t")), "a a b a a") == "a b a"
    assert one(T.dedupe_adjacent_words(F.col("t")), "") == ""


def test_character_references_are_the_platforms(spark):
    import html
    import random
    from html.entities import html5

    rng = random.Random(3)
    texts = [f"a&{n}" for n in html5] + [f"&{n.rstrip(';')}xy;b" for n in html5] + [f"&{n.rstrip(';')} b &{n}&" for n in html5]
    texts += [f"&#{n}; &#x{n:x} &#{n}z" for n in [*range(0, 0x120), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFD, 0x10FFFF, 0x110000, 10**12]]
    texts += ["&#000000000000065;", "&#x00000000000041;", "&#;", "&#x;", "&#xg", "&", "&&amp;amp;", "", "&notit; &notin; &notin"]
    texts += ["".join(rng.choice(["&", "am", "amp", "lt", "no", "t", "in", ";", "#", "x4", "12", " ", "é"]) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.unescape_html(F.col("t")).alias("u")).collect()
    wrong = [(texts[r["i"]], r["u"]) for r in got if r["u"] != html.unescape(texts[r["i"]])]
    assert len(got) == len(texts) and not wrong
