"""The indexability matrix and other rule cases as rows."""

import pytest
from pyspark.sql import functions as F

from sitelens.operators import checks as C
from sitelens.operators import hreflang as HL
from sitelens.operators import jsonld as J
from sitelens.operators.facts import page_facts
from sitelens.operators.signals import page_evidence
from sitelens.operators.summary import page_summary

URL = "https://s.test/p"
NAV = "page_id long, requested_url string, final_url string, status_code int, content_type string, x_robots_tag string"
HOPS = "page_id long, pos int, from_url string, to_url string, status int"
META = '<meta name="robots" content="{}">'

# html, x-robots-tag, final url, content type, hops, robots blocked, in sitemap -> expected, unexpected
MATRIX = [
    (META.format("noindex"), None, URL, "text/html", 0, None, None, {"indexability-noindex-signal"}, {"indexability-robots-conflict"}),
    ("", "none", URL, "text/html", 0, None, None, {"indexability-noindex-signal"}, {"indexability-robots-conflict"}),
    (META.format("index"), "noindex", URL, "text/html", 0, None, None, {"indexability-noindex-signal", "indexability-robots-conflict"}, set()),
    (META.format("noindexed"), "index", URL, "text/html", 0, None, None, set(), {"indexability-noindex-signal", "indexability-robots-conflict"}),
    ("", None, URL, "text/html", 0, True, None, {"indexability-robots-blocked"}, {"indexability-sitemap-robots-blocked"}),
    ("", None, URL, "text/html", 0, True, True, {"indexability-robots-blocked", "indexability-sitemap-robots-blocked"}, set()),
    ("", None, URL, "text/html", 0, False, True, set(), {"indexability-sitemap-robots-blocked"}),
    ('<link rel="canonical" href="/other">', None, URL, "text/html", 0, None, None, {"indexability-canonical-mismatch"}, set()),
    ('<link rel="canonical" href="/p#x">', None, URL, "text/html", 0, None, None, set(), {"indexability-canonical-mismatch"}),
    ("", None, "https://s.test/h3", "text/html", 3, None, None, set(), {"indexability-redirect-loop", "indexability-redirect-excessive"}),
    ("", None, "https://s.test/h6", "text/html", 6, None, None, {"indexability-redirect-excessive"}, {"indexability-redirect-loop"}),
    ("", None, "https://s.test/h1", "text/html", 3, None, None, {"indexability-redirect-loop"}, set()),
    ("", None, URL, "application/pdf", 0, None, None, {"indexability-non-html-content"}, set()),
    ("", None, URL, "text/html; charset=x", 0, None, None, set(), {"indexability-non-html-content"}),
    ("", None, URL, None, 0, None, None, set(), {"indexability-non-html-content"}),
]


def test_indexability_matrix(spark):
    pages = spark.createDataFrame([(i, URL, m[0]) for i, m in enumerate(MATRIX)], "page_id long, url string, html string")
    nav = spark.createDataFrame([(i, URL, m[2], 200, m[3], m[1]) for i, m in enumerate(MATRIX)], NAV)
    hops = spark.createDataFrame(
        [(i, k, f"https://s.test/h{k}", f"https://s.test/h{k + 1}", 301) for i, m in enumerate(MATRIX) for k in range(m[4])], HOPS
    )
    robots = spark.createDataFrame(
        [(i, "/p", m[5], "*") for i, m in enumerate(MATRIX) if m[5] is not None],
        "page_id long, robots_path string, robots_blocked boolean, robots_blocked_by string",
    )
    site = spark.createDataFrame(
        [(i, m[6], URL, "f", None) for i, m in enumerate(MATRIX) if m[6] is not None],
        "page_id long, sitemap_present boolean, matched_loc string, sitemap_file string, sitemap_alternates array<struct<hreflang:string,href:string>>",
    )
    ev = page_evidence(page_facts(pages), nav, hops, robots, site)
    found = {}
    for r in C.findings(ev).collect():
        found.setdefault(r.page_id, set()).add(r.rule_id)
    for i, m in enumerate(MATRIX):
        assert m[7] <= found.get(i, set()), (i, found.get(i))
        assert not (m[8] & found.get(i, set())), (i, found.get(i))


def test_missing_evidence_is_skipped_never_a_verdict(spark):
    pages = spark.createDataFrame([(1, URL, "<title>A reasonable title</title>"), (2, URL, None)], "page_id long, url string, html string")
    ev = page_evidence(page_facts(pages))
    found = C.findings(ev)
    assert found.filter("page_id = 2").count() == 0
    rows = {(r.page_id, r.check_id): r for r in C.selection(ev).collect()}
    assert not rows[(1, "indexability-redirect-anomaly")].selected
    assert "browser-navigation" in rows[(1, "indexability-redirect-anomaly")].reason
    assert rows[(1, "title-length-advisory")].selected and not rows[(2, "title-length-advisory")].selected
    assert {r.status for r in C.availability(ev, access_granted=False).filter("page_id = 2").collect()} == {"needs-access"}
    s = {r.page_id: r for r in page_summary(ev, found).collect()}
    assert s[2].total == 0 and s[2].indexability.status == "unknown" and len(s[2].capture_notes) == 3


def test_redirect_loop_compat_flags_every_chain(spark):
    from sitelens.operators.signals import redirect_loop, redirect_summary

    hops = spark.createDataFrame([(1, 0, "https://s/a", "https://s/b", 301), (1, 1, "https://s/b", "https://s/c", 301)], HOPS)
    plain = redirect_summary(hops).withColumn("nav_final_url", F.lit("https://s/c")).select(redirect_loop().alias("l")).first().l
    compat = redirect_summary(hops, True).withColumn("nav_final_url", F.lit("https://s/c")).select(redirect_loop(True).alias("l")).first().l
    assert (plain, compat) == (False, True)


def inventory(spark, raw, **limits):
    from sitelens.limits import CaptureLimits

    df = spark.createDataFrame([(1, 0, "ok", raw)], "page_id long, entry_index int, parse_status string, raw string")
    return J.inventory(df, CaptureLimits(**limits)).first()


def test_json_ld_limits_and_contexts(spark):
    deep = '{"@context":"x","@type":"T","a":' * 4 + '{"@type":"T"}' + "}" * 4
    r = inventory(spark, deep, jsonld_depth=2)
    assert r.status == "limited" and r.node_count == 3
    r = inventory(spark, '[{"@type":"A"},{"@type":"B"},{"@type":"C"}]', jsonld_nodes=2)
    assert (r.status, r.node_count, r.context) == ("limited", 2, "missing")
    assert inventory(spark, '{"@context":["x",{}],"@type":1}').context == "valid"
    assert inventory(spark, '{"@context":[]}').context == "malformed"
    assert inventory(spark, '{"@context":5}').context == "malformed"
    r = inventory(spark, '{"@context":"x","@graph":[{"@id":"a","n":1},{"@id":"a"},{"@id":"a","m":{"@id":"b","k":1}},{"@id":1}]}')
    assert r.duplicate_ids == ["a"] and r.status == "complete"
    assert inventory(spark, '"text"').top_level == "scalar"


@pytest.mark.parametrize(
    "tag,valid,typo",
    [("x-default", True, None), ("EN", True, None), ("en-GB", True, None), ("zh-hans", True, None), ("en-uk", False, "en-gb"), ("xx", False, None), ("de-zq", False, None), ("", False, None), ("en-latn-us", True, None), ("br", False, "pt-br")],
)
def test_hreflang_tags(spark, tag, valid, typo):
    from sitelens.functions.codes import hreflang_verdict

    v = spark.createDataFrame([(tag,)], "t string").select(hreflang_verdict(F.col("t")).alias("v")).first().v
    assert (v.valid, v.typo) == (valid, typo)


def test_cluster_reciprocity_against_brute_force(spark):
    members = [(1, i, f"l{i}", f"https://s/{i}", f"https://s/{i}/") for i in range(6)]
    edges = [(1, i, f"L{j}", f"https://s/{j}") for i in range(6) for j in range(6) if (i * 7 + j * 3) % 5]
    m = spark.createDataFrame(members, "cluster_id int, member_id int, hreflang string, requested_url string, final_url string")
    e = spark.createDataFrame(edges, "cluster_id int, member_id int, hreflang string, href string")
    declared = {(i, int(h[1:])) for _, i, h, _ in edges}
    want_self = {i for i in range(6) if (i, i) not in declared}
    want_return = {(i, j) for i in range(6) for j in range(6) if i != j and (i, j) not in declared}
    found, membership, lacking = HL.cluster_findings(m, e)
    rows = found.collect()
    assert {r.member_id for r in rows if r.rule_id.endswith("self-ref")} == want_self
    counts = {r.member_id: int(r.detail.split()[0]) for r in rows if r.rule_id.endswith("missing-return")}
    assert counts == {i: n for i in range(6) if (n := sum(i == a for a, _ in want_return))}
    assert {(r.member_id, r.other_id) for r in HL.missing_pairs(membership, lacking).collect()} == want_return


MEMBERS = "cluster_id int, member_id int, hreflang string, requested_url string, final_url string"


def test_large_clusters_name_their_missing_returns(spark):
    n = 1_010
    m = spark.createDataFrame([(1, i, f"l{i}", f"https://s/{i}", f"https://s/{i}/") for i in range(n)], MEMBERS)
    e = m.crossJoin(m.selectExpr("member_id AS other", "hreflang AS l", "requested_url AS href")).filter("NOT (member_id = 3 AND other IN (7, 1009))")
    _, membership, lacking = HL.cluster_findings(m, e.select("cluster_id", "member_id", F.col("l").alias("hreflang"), "href"))
    rows = HL.missing_pairs(membership, lacking).collect()
    assert {(r.member_id, r.other_lang, r.other_final) for r in rows} == {(3, "l7", "https://s/7/"), (3, "l1009", "https://s/1009/")}
    assert {r.other_id for r in lacking.collect()} == {3, 7, 1009}  # its own page is no pair


def test_a_bad_template_needs_no_square_of_rows(spark):
    """Each of 5 000 members declares itself and the same three others."""
    n = 5_000
    m = spark.range(n).selectExpr("1 AS cluster_id", "CAST(id AS INT) AS member_id", "concat('l', id) AS hreflang", "concat('https://s/', id) AS requested_url", "concat('https://s/', id, '/') AS final_url")
    links = m.selectExpr("cluster_id", "member_id", "explode(array(member_id, 10, 20, 30)) AS other").distinct()
    e = links.selectExpr("cluster_id", "member_id", "concat('l', other) AS hreflang", "concat('https://s/', other) AS href")
    found, membership, lacking = HL.cluster_findings(m, e)
    assert found.filter("rule_id LIKE '%missing-return'").count() == membership.count() == n
    # The three are short of each other's company only: four groups in all.
    assert lacking.count() == (n - 3) + 3 * (n - 2)
    missing = HL.missing_pairs(membership, lacking).groupBy("member_id").count().collect()
    assert {r["member_id"]: r["count"] for r in missing} == {i: n - 3 if i in (10, 20, 30) else n - 4 for i in range(n)}
