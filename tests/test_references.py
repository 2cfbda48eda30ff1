"""Character references against the standard library's own resolver."""

import html
from html.entities import html5

from pyspark.sql import functions as F

from sitelens.functions import references as R

# The library's resolver drops these controls; pages keep them.
CONTROLS = {*range(1, 9), 11, *range(14, 32), 127}
CASES = [
    "plain", "", None, "a & b", "&", "&;", "&eacute;t&eacute;", "&#x27;q&#39;", "&notin;&notit;&not", "&amp;lt;", "&amp;amp;",
    "&AMPx &LT;", "&copy 2020&copy2", "&#0;&#x110000;&#xD800;&#128;&#x9f;&#129;", "&#99999999999999999999;&#0000000000065;",
    "&&num;39;", "&fjlig;&nvlt;&bne;", "&foo;&#;&#x;&#xg", "&Tab;&NewLine;&#32;x&nbsp;y", "&#x1F600;&#128512", "&quotx",
]


def test_texts_resolve_as_the_standard_library_does(spark):
    cases = CASES + [f"x&{n}y" for n in html5] + [f"&#{n};" for n in range(300) if n not in CONTROLS]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    for r in df.select("t", R.text_of(R.canonical_references(F.col("t"))).alias("got")).collect():
        assert r["got"] == (None if r["t"] is None else html.unescape(r["t"])), r["t"]


def test_attributes_leave_names_that_go_on(spark):
    cases = {"?a=1&copy=2": "?a=1&copy=2", "&copyx": "&copyx", "&copy;x": "©x", "&copy": "©", "&copy/": "©/", "&notit;": "&notit;", "&amp;copy=1": "&copy=1"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select("t", R.resolved(R.canonical_references(F.col("t"))).alias("got")).collect()
    assert {r["t"]: r["got"] for r in got} == cases
