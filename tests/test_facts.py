import pytest

from sitelens.limits import CaptureLimits
from sitelens.operators.facts import page_facts

URL = "https://site.test/dir/page"


@pytest.fixture(scope="module")
def facts(spark):
    def run(html, limits=CaptureLimits()):
        df = spark.createDataFrame([(1, URL, html)], "page_id long, url string, html string")
        return page_facts(df, limits).first()

    return run


def test_titles_ignore_svg_comments_and_scripts(facts):
    html = "<!doctype html><html LANG=en><head><!-- <title>x</title> --><title> A &amp; B </title><script>'<title>no</title>'</script></head><body><svg><title>icon</title></svg></body>"
    f = facts(html)
    assert (f.title.state, f.title.value) == ("present", "A & B")
    assert f.language.value == "en"
    assert f.html5.value.doctype == "<!DOCTYPE html>"


def test_missing_head_gives_absent_not_failures(facts):
    f = facts("<p>hi")
    assert f.title.state == "absent" and f.meta_description.state == "absent"
    assert f.language.state == "empty"
    assert f.headings.state == f.links.state == f.images.state == "present"
    assert f.json_ld.state == "absent"


def test_page_without_html_is_no_evidence(facts):
    f = facts(None)
    assert f.title is None and f.links is None


def test_canonical_states(facts):
    link = '<link rel="CANONICAL" href="{}">'
    assert facts(link.format("")).canonical.state == "empty"
    assert facts(link.format("http://[bad")).canonical.state == "malformed"
    f = facts('<base href="/b/">' + link.format("c?x=1&amp;y=2")).canonical
    assert (f.state, f.value.absolute) == ("present", "https://site.test/b/c?x=1&y=2")
    f = facts(link.format("/a") + link.format("/b")).canonical
    assert (f.state, f["count"], [v.href for v in f["values"]]) == ("duplicate", 2, ["/a", "/b"])


def test_attribute_lookup_is_not_fooled_by_quoted_text(facts):
    f = facts("""<img title="alt=x" src=/a.png><img alt="" src='b'><img alt='  '><img data-alt="y" alt="ok">""").images.value
    assert (f.total, f.missing_alt, f.empty_alt, f.with_alt) == (4, 1, 2, 1)
    links = facts("""<a title="a > b href='/no'" href="/yes">t <b>u</b></a><a name=x>n</a>""").links.value
    assert (links.total, links.internal, links.inventory[0].href, links.inventory[0].text) == (1, 1, "/yes", "t u")


def test_link_classes(facts):
    html = "".join(f'<a href="{h}">x</a>' for h in ("#a", "mailto:x@y", "javascript:0", "/in", "https://site.test/", "https://o.test/", "tel:1", "http://[bad"))
    v = facts(html).links.value
    assert (v.total, v.internal, v.external, v.other) == (8, 2, 1, 5)


def test_limits_are_reported_and_counts_stay_whole(facts):
    html = "<title>" + "t" * 50 + "</title>" + '<a href="/x">y</a>' * 7 + '<meta property="og:a" content="1">' * 4
    f = facts(html, CaptureLimits(string_chars=10, link_inventory=3, meta_items=2))
    assert f.title.value == "t" * 10 and f.title.limits.truncated
    assert f.links.value.total == 7 and len(f.links.value.inventory) == 3 and f.links.limits.omitted_count == 4
    assert f.open_graph["count"] == 4 and f.open_graph.limits.omitted_count == 2


def test_json_ld_budget_runs_over_scripts_in_order(facts):
    s = '<script type="application/ld+json">{}</script>'
    html = s.format('{"a":1}') + s.format('{"b": ' + '"' + "x" * 40 + '"}') + s.format("{}")
    f = facts(html, CaptureLimits(jsonld_chars=20)).json_ld
    assert [e.parse_status for e in f.value] == ["ok", "truncated", "truncated"]
    assert [len(e.raw) for e in f.value] == [7, 13, 0]
    f = facts(s.format("{'a':1}") + s.format("{} x") + s.format("1,2") + s.format(" ") + s.format('{"a":1,"a":2}')).json_ld
    assert [e.parse_status for e in f.value] == ["invalid-json", "invalid-json", "invalid-json", "empty", "ok"]


def test_facts_need_no_shuffle_and_lex_once(spark):
    df = spark.createDataFrame([(1, URL, "<title>x</title>")], "page_id long, url string, html string")
    plan = page_facts(df).filter("canonical.state = 'absent'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Exchange" not in plan and plan.count("<!--.*?(?:-->|\\z)|<script") <= 2


def test_checks_see_what_is_past_the_old_limits(facts, spark):
    from sitelens.operators.hreflang import html_alternates
    from sitelens.operators.jsonld import inventory, scripts_of

    late = "noindex"
    html = (
        "".join(f'<link rel="alternate" hreflang="en" href="/{k}">' for k in range(60))
        + '<meta name="robots" content="all">' * 44
        + f'<meta name="robots" content="{"x" * 3000}, {late}">'
        + '<script type="application/ld+json">{}</script>'.format('{"@type":"T"}') * 30
        + '<script type="application/ld+json">{}</script>'.format("[" + ",".join(['{"@type":"T"}'] * 5000) + "]")
    )
    df = spark.createDataFrame([(1, URL, html)], "page_id long, url string, html string")
    page = page_facts(df)
    assert html_alternates(page).count() == 60
    robots = page.first().meta_robots
    assert len(robots["values"]) == 45 and robots["values"][-1].content.endswith(late)
    nodes = inventory(scripts_of(page)).collect()
    assert len(nodes) == 31 and max(r.node_count for r in nodes) == 5000
    assert {r.status for r in nodes} == {"complete"}
