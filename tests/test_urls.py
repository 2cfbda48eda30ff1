import random

import pytest
from pyspark.sql import functions as F

from sitelens.functions import urls as U
from sitelens.functions.hosts import ascii_host

PARSED = [
    ("HTTP://Ex.COM:80", "http://ex.com/"),
    ("https://a.b:443/x?", "https://a.b/x?"),
    ("https://u:p@a.b:8443/", "https://u:p@a.b:8443/"),
    ("https://a.b/a/../b/./c", "https://a.b/b/c"),
    ("https://a.b/a/..", "https://a.b/"),
    ("  https://a.b/x y ", "https://a.b/x%20y"),
    ("https://a.b/ü", "https://a.b/%C3%BC"),
    ("mailto:a@b", "mailto:a@b"),
    ("JavaScript:void(0)", "javascript:void(0)"),
    ("http://[bad", None),
    ("http://[::1]/x", "http://[::1]/x"),
    ("http://h:99999/", None),
    ("http://Bücher.example/ä", "http://xn--bcher-kva.example/%C3%A4"),
    ("http://STRAßE.example:80", "http://xn--strae-oqa.example/"),
    ("http://例え\u3002テスト/", "http://xn--r8jz45g.xn--zckzah/"),
    ("http://😀.example/", "http://xn--e28h.example/"),
    ("http://b%C3%BCcher.example/", "http://xn--bcher-kva.example/"),
    ("http://%65x.com/", "http://ex.com/"),
    ("http://a%2Fb/", None),
    ("http://0x7f.1/x", "http://127.0.0.1/x"),
    ("http://0X7F000001/", "http://127.0.0.1/"),
    ("http://2130706433:8080/", "http://127.0.0.1:8080/"),
    ("http://0177.0.0.01./", "http://127.0.0.1/"),
    ("http://192.168.257/", "http://192.168.1.1/"),
    ("http://1.2.3.4/", "http://1.2.3.4/"),
    ("http://0x/", "http://0.0.0.0/"),
    ("http://256.1.1.1/", None),
    ("http://1.2.3.4.5/", None),
    ("http://4294967296/", None),
    ("http://09.1/", None),
    ("http://a.b.1/", None),
    ("http://1.a/", "http://1.a/"),
    ("http://", None),
    ("/relative", None),
    ("", None),
]

RESOLVED = [
    ("/x", "https://a.b/x"),
    ("x", "https://a.b/c/x"),
    ("../x", "https://a.b/x"),
    ("?q", "https://a.b/c/d?q"),
    ("#f", "https://a.b/c/d?k=1#f"),
    ("", "https://a.b/c/d?k=1"),
    ("//cdn.x/y", "https://cdn.x/y"),
    ("http://O.x:80", "http://o.x/"),
    ("tel:1", "tel:1"),
    ("http://[bad", None),
    ("/a/../b", "https://a.b/b"),
    ("/a b", "https://a.b/a%20b"),
    ("\\win", "https://a.b/win"),
]


def test_parse_and_resolve(spark):
    rows = spark.createDataFrame(PARSED, "u string, want string")
    got = rows.select("u", "want", U.parse_url(F.col("u"))["href"].alias("got")).collect()
    assert [(r.u, r.got) for r in got] == [(r.u, r.want) for r in got]
    base = U.parse_url(F.lit("https://a.b/c/d?k=1#z"))
    rows = spark.createDataFrame(RESOLVED, "h string, want string")
    got = rows.select("h", "want", U.resolve_url(F.col("h"), base)["href"].alias("got")).collect()
    assert [(r.h, r.got) for r in got] == [(r.h, r.want) for r in got]


@pytest.mark.parametrize(
    "fn,url,want",
    [
        (U.comparable_url, "https://a.b/x#f", "https://a.b/x"),
        (U.comparable_url, "ftp://a.b/x", None),
        (U.grouping_url, "https://a.b/x/?q#f", "https://a.b/x?q"),
        (U.grouping_url, "nonsense", "nonsense"),
        (U.sitemap_url, " https://A.b#f ", "https://a.b/#f"),
    ],
)
def test_normal_forms(spark, fn, url, want):
    got = spark.createDataFrame([(url,)], "u string").select(fn(F.col("u")).alias("g")).first().g
    assert got == want


def test_variants_keep_the_first_kind_and_skip_www_for_addresses(spark):
    from sitelens.operators.compare import variant_targets

    rows = spark.createDataFrame([("http://127.0.0.1/A/index.html",), ("https://www.e.x/",)], "url string")
    got = {}
    for r in variant_targets(rows).collect():
        got.setdefault(r.base_url, []).append((r.kind, r.url))
    assert {k for k, _ in got["http://127.0.0.1/A/index.html"]} == {"base", "scheme", "trailing-slash", "case"}
    root = dict(got["https://www.e.x/"])
    assert root["www"] == "https://e.x/" and "trailing-slash" not in root
    assert [u for _, u in got["https://www.e.x/"]] == sorted(u for _, u in got["https://www.e.x/"])
    capped = variant_targets(rows, 2).collect()
    assert len(capped) == 4 and all(r.cap_hit for r in capped)


def test_eligibility_and_probe(spark):
    rows = spark.createDataFrame([("about:blank",), ("ftp://x.y/",), ("https://x.y/p",), (None,)], "u string")
    got = rows.select(U.url_eligibility(F.col("u")).alias("e")).collect()
    assert [r.e.eligible for r in got] == [False, False, True, False]
    bad = spark.createDataFrame([("https://a.b/", "https://c.d/"), ("https://a.b/", "x")], "a string, p string")
    assert [r.c for r in bad.select(U.probe_check(F.col("a"), F.col("p")).alias("c")).collect()] == ["cross-origin", "invalid-url"]


def test_labels_are_punycode(spark):
    draw = random.Random(7)
    letters = "abz019-äéßłжяλ中文字한😀𝒳"
    labels = ["".join(draw.choice(letters) for _ in range(draw.choice([1, 2, 5, 20, 60]))) for _ in range(150)]
    labels = [x for x in labels if not x.isascii()] + ["ü" * 300, "a" * 300 + "😀"]
    rows = spark.createDataFrame([(x, "xn--" + x.encode("punycode").decode()) for x in labels], "label string, want string")
    got = rows.select("label", "want", ascii_host(F.col("label")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
