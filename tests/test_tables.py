"""From stored tables to findings: the schemas hold what the operators read."""

from sitelens import schemas
from sitelens.operators import fetchlog
from sitelens.plans.audit import audit, crawl_evidence
from sitelens.sources import tables

SITE = "https://s.test"
ROWS = {
    "pages": [
        {"page_id": 1, "url": SITE + "/a", "html": "<html lang=en><title>Caf&eacute; &amp; bar</title><link rel=canonical href='/b'><body><img src=x></body></html>"},
        {"page_id": 2, "url": SITE + "/private/b", "html": "<html><title></title></html>"},
    ],
    "fetches": [
        {"fetch_id": 1, "page_id": 1, "requested_url": SITE + "/a", "final_url": SITE + "/a", "status": 200, "content_type": "text/html", "expect_mime": "text/html", "hop_count": 0},
        {"fetch_id": 2, "page_id": 2, "requested_url": SITE + "/b", "final_url": SITE + "/b", "status": 301, "hop_count": 0},
    ],
    "robots_files": [{"origin": SITE, "status": 200, "content_type": "text/plain", "body": "User-agent: *\nDisallow: /private"}],
    "sitemap_files": [
        {"root_url": SITE + "/sitemap.xml", "file_url": SITE + "/sitemap.xml", "status": 200, "body": f"<urlset><url><loc>{SITE}/private/b</loc></url></urlset>"}
    ],
    "navigations": [
        {"page_id": 1, "tab_id": 1, "requested_url": SITE + "/a", "final_url": SITE + "/a", "status_code": 200, "content_type": "text/html", "x_robots_tag": "noindex"}
    ],
    "hops": [{"page_id": 1, "pos": 0, "from_url": SITE + "/a", "to_url": SITE + "/a", "status": 302}],
}


def test_stored_tables_reach_the_findings(spark, tmp_path):
    read = {}
    for name, rows in ROWS.items():
        schema = getattr(schemas, name.upper())
        full = [{f.name: row.get(f.name) for f in schema} for row in rows]
        spark.createDataFrame(full, schema).write.parquet(str(tmp_path / name))
        read[name] = getattr(tables, name)(spark, str(tmp_path / name))
    codes = {r.fetch_id: r.error_code for r in fetchlog.classify(read["fetches"]).collect()}
    assert codes == {1: None, 2: "network-error"}
    evidence = crawl_evidence(read["pages"], read["navigations"], read["hops"], read["robots_files"], read["sitemap_files"])
    found = {(r.page_id, r.rule_id) for r in audit(evidence).findings.collect()}
    assert {
        (1, "indexability-noindex-signal"), (1, "indexability-canonical-mismatch"), (1, "indexability-redirect-loop"), (1, "images-missing-alt"),
        (2, "title-missing"), (2, "indexability-robots-blocked"), (2, "indexability-sitemap-robots-blocked"),
    } <= found
    assert evidence.filter("page_id = 1").first().title.value == "Café & bar"
