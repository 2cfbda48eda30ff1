import pytest
from pyspark.sql import functions as F

from parity.registry import Inputs
from sitelens.limits import RobotsLimits, SitemapLimits
from sitelens.operators import robots as R
from sitelens.operators import sitemaps as M

SITE = "https://s.test"


def verdict(spark, body, path, compat=False, limits=RobotsLimits()):
    files = spark.createDataFrame(
        [(SITE, 200, "text/plain", False, None, body)],
        "origin string, status int, content_type string, truncated boolean, fetch_error string, body string",
    )
    pages = spark.createDataFrame([(1, SITE + path)], "page_id long, url string")
    rows = R.evaluate(pages, files, limits, compat).collect()
    return {r.profile: (r.crawlable, r.reason) for r in rows}


ROBOTS = [
    ("", "/x", True, "no-matching-group"),
    ("User-agent: *\nDisallow: /a", "/b", True, "no-matching-rules"),
    ("User-agent: *\nDisallow: /a", "/abc", False, "disallow-rule"),
    ("User-agent: *\nDisallow: /a\nAllow: /ab", "/abc", True, "allow-rule"),
    ("User-agent: *\nAllow: /a\nDisallow: /a", "/a", True, "allow-rule"),
    ("User-agent: *\nDisallow: /*.pdf$", "/x/y.pdf", False, "disallow-rule"),
    ("User-agent: *\nDisallow: /*.pdf$", "/x/y.pdf2", True, "no-matching-rules"),
    ("User-agent: *\nDisallow: /a+b", "/a+b", False, "disallow-rule"),
    ("User-agent: *\nDisallow:", "/x", True, "no-matching-rules"),
    ("Disallow: /x", "/x", False, "disallow-rule"),
    ("user-agent: a\nUSER-AGENT: *\ndisallow: /x # note", "/x", False, "disallow-rule"),
    ("User-agent: *\nDisallow: /q", "/p?x=/q", True, "no-matching-rules"),
]


@pytest.mark.parametrize("body,path,crawlable,reason", ROBOTS)
def test_robots_generic(spark, body, path, crawlable, reason):
    assert verdict(spark, body, path)["*"] == (crawlable, reason)


def test_robots_profiles_and_first_group_on_tie(spark):
    body = "User-agent: *\nDisallow: /\n\nUser-agent: Google\nAllow: /\n\nUser-agent: Googlebot\nDisallow: /x\n\nUser-agent: googlebot\nDisallow: /y"
    assert verdict(spark, body, "/y")["Googlebot"] == (True, "no-matching-rules")
    assert verdict(spark, body, "/x")["Googlebot"] == (False, "disallow-rule")
    assert verdict(spark, body, "/y")["*"] == (False, "disallow-rule")


def test_empty_pattern_blocks_only_in_compat(spark):
    body = "User-agent: *\nDisallow:"
    assert verdict(spark, body, "/x", compat=True)["*"] == (False, "disallow-rule")


def test_line_limit(spark):
    body = "\n" * 5 + "User-agent: *\nDisallow: /"
    assert verdict(spark, body, "/x", limits=RobotsLimits(lines=5))["*"] == (True, "no-matching-group")


def test_many_rules_are_found_by_their_heads(spark):
    """50 000 rules past any byte or line limit: the right one wins and few are met."""
    lines = [f"Disallow: /p{k}/" for k in range(50_000)] + ["Allow: /p77/x", "Disallow: /*.pdf$", "Disallow: /p", "Allow: /p49999/*/ok"]
    body = "User-agent: *\n" + "# " + "c" * 600_000 + "\n" + "\n".join(lines)
    files = spark.createDataFrame(
        [(SITE, 200, "text/plain", False, None, body)],
        "origin string, status int, content_type string, truncated boolean, fetch_error string, body string",
    )
    paths = ["/p77/x", "/p77/y", "/q", "/q.pdf", "/p123456", "/p49999/a/ok", "/p4999/a/ok", "/p7.pdf"]
    pages = spark.createDataFrame([(k, SITE + p) for k, p in enumerate(paths)], "page_id long, url string")
    got = {r.page_id: (r.reason, r.pattern) for r in R.evaluate(pages, files).filter("profile = '*'").collect()}
    assert [got[k] for k in range(len(paths))] == [
        ("allow-rule", "/p77/x"), ("disallow-rule", "/p77/"), ("no-matching-rules", None), ("disallow-rule", "/*.pdf$"), ("disallow-rule", "/p"),
        ("allow-rule", "/p49999/*/ok"), ("disallow-rule", "/p4999/"), ("disallow-rule", "/*.pdf$"),
    ]
    origins, index = R.rule_index(files)
    located = pages.selectExpr("page_id", f"'{SITE}' AS origin", f"substring(url, {len(SITE) + 1}) AS path")
    met = R.rule_candidates(located, origins, index)
    assert index.count() == 2 * len(lines) and met.filter("rule IS NOT NULL").groupBy("page_id").count().agg(F.max("count")).first()[0] <= 2 * 4


def sitemap(spark, rows):
    return spark.createDataFrame(
        [(SITE + "/sitemap.xml", u, 200, False, None, b) for u, b in rows],
        "root_url string, file_url string, status int, truncated boolean, fetch_error string, body string",
    )


def test_sitemap_prefixes_cdata_and_alternates(spark):
    xml = (
        '<?xml version="1.0"?><s:urlset xmlns:s="x" xmlns:h="y"><s:url><s:loc><![CDATA[https://s.test/a?b=1&c=2]]></s:loc>'
        '<h:link rel="Alternate" hreflang="EN-gb" href="https://s.test/en"/><h:link hreflang="" href="z"/></s:url>'
        "<s:url><s:loc>https://s.test/a?b=1&amp;c=2</s:loc></s:url></s:urlset>"
    )
    p = M.parse_files(sitemap(spark, [(SITE + "/sitemap.xml", xml)]))
    rows = M.file_entries(p).orderBy("pos").collect()
    assert [(r.loc, r.copy) for r in rows] == [("https://s.test/a?b=1&c=2", 0), ("https://s.test/a?b=1&c=2", 1)]
    assert [(a.hreflang, a.href) for a in rows[0].alternates] == [("en-gb", "https://s.test/en")]


@pytest.mark.parametrize(
    "xml,code",
    [
        ("<urlset><url><loc>x</loc></url>", "sitemap-parse-failed"),
        ("<!DOCTYPE urlset><urlset></urlset>", "sitemap-parse-failed"),
        ("<urlset>&bad;</urlset>", "sitemap-parse-failed"),
        ("<html></html>", "sitemap-parse-failed"),
        ("   ", "sitemap-fetch-empty"),
        ("<urlset></urlset>", None),
    ],
)
def test_sitemap_admission(spark, xml, code):
    assert M.parse_files(sitemap(spark, [(SITE + "/sitemap.xml", xml)])).first().error_code == code


def test_index_expansion_visits_each_file_once_and_marks_the_limit(spark):
    index = "<sitemapindex>{}</sitemapindex>"
    ref = "<sitemap><loc>" + SITE + "/{}.xml</loc></sitemap>"
    leaf = "<urlset><url><loc>" + SITE + "/{}</loc><lastmod>{}</lastmod></url></urlset>"
    files = sitemap(
        spark,
        [
            (SITE + "/sitemap.xml", index.format(ref.format("a") + ref.format("b") + ref.format("sitemap"))),
            (SITE + "/a.xml", leaf.format("p", 1)),
            (SITE + "/b.xml", index.format(ref.format("a") + ref.format("c"))),
            (SITE + "/c.xml", leaf.format("p", 2)),
        ],
    )
    p = M.parse_files(files)
    got = {r.file_url.rsplit("/", 1)[1]: r.depth for r in M.expand_indexes(p).collect()}
    assert got == {"sitemap.xml": 0, "a.xml": 1, "b.xml": 1, "c.xml": 2}
    assert M.merged_entries(p).first().lastmod == "1"
    over = M.expand_indexes(p, SitemapLimits(files=2)).filter("over_limit").count()
    assert over == 2
    assert {r.file_url.rsplit("/", 1)[1]: r.over_limit for r in M.expand_indexes(p, SitemapLimits(depth=1)).collect()} == {
        "sitemap.xml": False, "a.xml": False, "b.xml": False, "c.xml": True
    }


def test_indexes_are_followed_to_any_depth_and_round_cycles(spark):
    index = "<sitemapindex>{}</sitemapindex>"
    ref = "<sitemap><loc>" + SITE + "/{}.xml</loc></sitemap>"
    names = ["sitemap", *(f"l{k}" for k in range(1, 26))]
    bodies = [(SITE + f"/{a}.xml", index.format(ref.format(b) + ref.format("l3"))) for a, b in zip(names, names[1:])]
    p = M.parse_files(sitemap(spark, [*bodies, (SITE + "/l25.xml", "<urlset><url><loc>x</loc></url></urlset>")]))
    got = {r.file_url.rsplit("/", 1)[1]: r.depth for r in M.expand_indexes(p).collect()}
    want = {"sitemap.xml": 0, "l1.xml": 1, "l2.xml": 2, "l3.xml": 1}
    assert got == want | {f"l{k}.xml": k - 2 for k in range(4, 26)}
    assert M.merged_entries(p).count() == 1


def test_large_files_are_cut_and_keep_their_order(spark):
    n = 5 * M.CHUNK + 7
    entry = "<h:url><h:loc>https://s.test/{}</h:loc><!-- <url> --><h:lastmod><![CDATA[</url>]]></h:lastmod>" + "<x>{}</x></h:url>" 
    entries = [entry.format(k, "y" * 450) for k in range(n)]
    xml = "<h:urlset>" + "\n".join(entries) + "</h:urlset>"
    bad = xml.replace(f"<h:loc>https://s.test/{n - 5}<", "<h:loc>a & b<")
    assert len(xml) > 5_000_000
    p = M.parse_files(sitemap(spark, [(SITE + "/sitemap.xml", xml), (SITE + "/bad.xml", bad)]))
    assert p.where("error_code IS NULL").count() == 6
    rows = M.file_entries(p).orderBy("pos").collect()
    assert [(r.pos, r.loc, r.lastmod) for r in rows] == [(k, f"https://s.test/{k}", "</url>") for k in range(n)]
    assert {r.error for r in p.where("file_url LIKE '%bad%'").collect()} == {"The XML is not well-formed"}
    small = M.parse_files(sitemap(spark, [(SITE + "/sitemap.xml", xml)]), SitemapLimits(body_bytes=1_000_000))
    assert {r.error_code for r in small.collect()} == {"sitemap-fetch-oversized"}


def test_files_in_parts_are_those_of_whole_bodies(spark):
    """Parts are cut anywhere: in marks, names, comments, CDATA and entities."""
    head = '\ufeff<?xml version="1.0"?>\n<!-- a <url> --><s:urlset xmlns:s="x" xmlns:h="y">'
    body = (
        "<s:url><s:loc><![CDATA[https://s.test/a?b=1&c=2</url><!-- ]]></s:loc><lastmod>1</lastmod></s:url>\n"
        "<!-- <url><loc>no</loc></url> <![CDATA[ --><s:url><s:loc>https://s.test/a?b=1&amp;c=2</s:loc>"
        '<h:link rel="alternate" hreflang="en" href="https://s.test/en"/></s:url >\n\n<s:url/><url><loc>\u00fc> \u00e9</loc></url>'
        "<s:url><loc><![CDATA[ <!-- x --> <![CDATA[ ]]></loc></s:url><url><loc>https://s.test/a?b=1&amp;c=2</loc></url>"
    )
    index = "<sitemapindex><sitemap><loc>" + SITE + "/a.xml</loc></sitemap> <!-- b --><sitemap><loc>" + SITE + "/c.xml</loc></sitemap></sitemapindex>"
    bodies = [
        head + body + "</s:urlset>", head + body, head + body + "</s:urlset><!-- open", head + body.replace("a?b=1&amp;", "a & ") + "</s:urlset>",
        head + body + "&bad;&worse;</s:urlset>", "<!DOCTYPE urlset>" + body + "&bad;", index, "abc", "  \n ", "<html>" + body + "</html>",
        "<urlset></urlset>", "<urlset><sitemap></url></sitemap></urlset>", "<urlset><url><loc>x</loc></urlset>",
    ]
    files = sitemap(spark, [(SITE + f"/f{k}.xml", b) for k, b in enumerate(bodies)])
    show = lambda df: sorted(map(str, df.collect()))
    whole = M.parse_files(files)
    told = show(whole.where("chunk = 0").drop("doc"))
    rows = show(M.file_entries(whole)), show(M.child_refs(whole))
    assert len(rows[0]) > 5 and len(rows[1]) == 2
    for size in (1, 7, 100):
        cuts = F.transform(F.sequence(F.lit(0), F.length("body"), F.lit(size)), lambda at: F.substr("body", at + 1, F.lit(size)))
        parts = files.select("*", F.posexplode(cuts).alias("part", "piece")).drop("body").withColumnRenamed("piece", "body")
        cut = M.parse_files(parts)
        assert show(cut.where("chunk = 0").drop("doc")) == told
        assert (show(M.file_entries(cut)), show(M.child_refs(cut))) == rows
        assert cut.groupBy("file_url", "chunk").count().where("count > 1").isEmpty()


def test_the_parts_of_the_large_sitemaps_are_their_bodies(spark):
    inputs = Inputs(spark, "/root/testdata/sf0.001")
    held = F.array_sort(F.collect_list(F.struct("section", "part", "body")))
    joined = inputs.table("sitemap_parts_large").groupBy("root_url", "file_url").agg(F.array_join(F.transform(held, lambda h: h["body"]), "").alias("body"))
    whole = inputs.table("sitemap_files_large").select("root_url", "file_url", "body")
    assert sorted(joined.collect()) == sorted(whole.collect())


def test_membership_prefers_the_exact_location(spark):
    xml = "<urlset><url><loc>https://s.test/a/</loc></url><url><loc>https://s.test/a</loc></url><url><loc>https://s.test/b/</loc></url></urlset>"
    p = M.parse_files(sitemap(spark, [(SITE + "/sitemap.xml", xml)]))
    pages = spark.createDataFrame(
        [(1, SITE + "/a"), (2, SITE + "/b"), (3, SITE + "/c"), (4, "https://other.test/")], "page_id long, url string"
    )
    got = {r.page_id: (r.sitemap_present, r.matched_loc) for r in M.membership(pages, M.merged_entries(p), p).collect()}
    assert got == {1: (True, SITE + "/a"), 2: (True, SITE + "/b/"), 3: (False, None)}
