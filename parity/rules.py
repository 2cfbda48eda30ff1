"""Queries over checks, findings and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity import duck as D
from parity.duck import comparable, grouping, http, q, slug, url_chain
from parity.registry import CTES, query
from sitelens.functions.codes import LANGUAGES, TYPOS, iso_regions
from sitelens.operators import checks as C
from sitelens.operators import hreflang as HL
from sitelens.operators import robots as R
from sitelens.operators import signals as S
from sitelens.operators import sitemaps as M
from sitelens.operators import summary as Y
from sitelens.plans.audit import audit, crawl_evidence


def evidence(c):
    """Facts with navigation, robots and sitemap evidence, materialised once."""
    from sitelens.session import cut_lineage

    return c.once(
        "evidence",
        lambda: cut_lineage(
            crawl_evidence(
                c.table("audit_pages").select("page_id", "url"),
                c.table("navigations"),
                c.table("fetch_hops"),
                c.table("robots_files"),
                c.table("sitemap_files"),
                facts=c.facts,
            )
        ),
    )


# -- signals ----------------------------------------------------------------
TOK = "list_filter(string_split_regex(lower({}), '[,;\\s]+'), lambda t: t <> '')"
CTES["msig"] = f"""SELECT page_id, list_contains(t,'none') OR list_contains(t,'noindex') AS noindex, list_contains(t,'none') OR list_contains(t,'nofollow') AS nofollow, list_contains(t,'none') AS has_none FROM
 (SELECT page_id, flatten(list({TOK.format('text')})) AS t FROM (SELECT page_id, content AS text FROM meta WHERE name IN ('robots','googlebot')) m GROUP BY page_id) x WHERE len(t) > 0"""
CTES["hsig"] = f"""SELECT page_id, list_contains(t,'none') OR list_contains(t,'noindex') AS noindex, list_contains(t,'none') OR list_contains(t,'nofollow') AS nofollow FROM
 (SELECT page_id, {TOK.format("coalesce(x_robots_tag,'')")} AS t FROM navigations) x WHERE len(t) > 0"""
url_chain("n", "navigations", "final_url")
url_chain("c", "f_canonical", "absolute")
url_chain("f", "fetch_hops", "from_url")
CTES["navn"] = f"SELECT *, {comparable('n')} AS final_norm FROM n__navigations"
CTES["canonn"] = f"SELECT *, {comparable('c')} AS canon_norm FROM c__f_canonical"
CTES["hopn"] = f"SELECT *, {comparable('f')} AS src FROM f__fetch_hops"
CTES["redir"] = """SELECT page_id, count(*) AS hop_count, count(DISTINCT src) < count(src) AS loop_in, list(src) AS srcs FROM hopn GROUP BY page_id"""
CTES["redirect_anom"] = "SELECT n.page_id, coalesce(r.loop_in OR list_contains(r.srcs, n.final_norm), false) AS looped, coalesce(r.hop_count, 0) AS hop_count FROM navn n LEFT JOIN redir r USING (page_id)"


@query(
    "C2_signal_reconciliation",
    """SELECT p.page_id, m.noindex AS meta_noindex, m.nofollow AS meta_nofollow, h.noindex AS header_noindex, h.nofollow AS header_nofollow, n.final_url AS nav_final_url, b.robots_blocked, s.sitemap_present
 FROM page p LEFT JOIN msig m USING (page_id) LEFT JOIN hsig h USING (page_id) LEFT JOIN navigations n USING (page_id) LEFT JOIN rblock b USING (page_id) LEFT JOIN member s USING (page_id)""",
)
def reconciliation(c):
    return evidence(c).select(
        "page_id",
        F.col("meta_signal.noindex").alias("meta_noindex"),
        F.col("meta_signal.nofollow").alias("meta_nofollow"),
        F.col("header_signal.noindex").alias("header_noindex"),
        F.col("header_signal.nofollow").alias("header_nofollow"),
        "nav_final_url",
        "robots_blocked",
        "sitemap_present",
    )


@query(
    "E6_redirect_visited",
    "SELECT page_id, pos, from_url, earlier FROM (SELECT page_id, pos, from_url, count(*) OVER (PARTITION BY page_id, src ORDER BY pos) - 1 AS earlier FROM hopn) x WHERE earlier > 0",
)
def redirect_visited(c):
    return S.repeated_sources(c.table("fetch_hops"))


# -- hreflang ---------------------------------------------------------------
def in_list(values) -> str:
    return "(" + ",".join(q(v) for v in values) + ")"


TYPO = "CASE t " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in TYPOS.items()) + " END"


def verdict(src: str, cols: str) -> str:
    reason = f"""CASE WHEN t = 'x-default' THEN NULL WHEN t = '' THEN 'hreflang value is empty' WHEN {TYPO} IS NOT NULL THEN '"' || t || '" looks like a typo — did you mean "' || {TYPO} || '"?'
  WHEN split_part(t,'-',1) NOT IN {in_list(LANGUAGES)} THEN '"' || split_part(t,'-',1) || '" is not a valid ISO 639-1 language code'
  WHEN length(regexp_extract(t,'^[^-]*-(.*)$',1)) = 2 AND upper(regexp_extract(t,'^[^-]*-(.*)$',1)) NOT IN {in_list(iso_regions())} THEN '"' || upper(regexp_extract(t,'^[^-]*-(.*)$',1)) || '" is not a valid ISO 3166-1 region code' END"""
    return f"SELECT {cols}, hreflang, {reason} AS reason, CASE WHEN t NOT IN ('x-default','') THEN {TYPO} END AS typo FROM (SELECT *, lower(trim(hreflang)) AS t FROM {src}) v"


CTES["hl"] = """SELECT page_id, 'HTML' AS source, i AS pos, lower(hreflang) AS hreflang, href, abs_href AS absolute FROM rel WHERE rel = 'alternate'
 UNION ALL SELECT m.page_id, 'sitemap', a.k, a.hreflang, a.href, NULL FROM member m JOIN smalt a ON a.root_url = m.root_url AND a.loc = m.matched_loc"""
CTES["hlv"] = verdict("hl", "page_id, source, pos, href, absolute")
CTES["hldup"] = "SELECT page_id, source, hreflang, count(*) AS n FROM hl GROUP BY ALL HAVING count(*) > 1"
CTES["hlpair"] = """SELECT h.page_id, h.pos, h.hreflang, coalesce(h.absolute, h.href) AS html_href, s.href AS sitemap_href FROM hl h JOIN (SELECT *, row_number() OVER (PARTITION BY page_id, hreflang ORDER BY pos) AS rn FROM hl WHERE source = 'sitemap') s
 ON s.page_id = h.page_id AND s.hreflang = h.hreflang AND s.rn = 1 WHERE h.source = 'HTML'"""
url_chain("a", "hlpair", "html_href")
url_chain("b", "a__hlpair", "sitemap_href")
CTES["hlmis"] = f"SELECT page_id, pos, hreflang, html_href, sitemap_href FROM b__a__hlpair WHERE {grouping('a', 'html_href')} <> {grouping('b', 'sitemap_href')}"
CTES["hlfind"] = f"""SELECT page_id, CASE WHEN typo IS NOT NULL THEN 'hreflang-likely-typo' ELSE 'hreflang-invalid-language' END AS rule_id, source, hreflang FROM hlv WHERE reason IS NOT NULL
 UNION ALL SELECT page_id, 'hreflang-empty-href', source, hreflang FROM hl WHERE trim(href) = ''
 UNION ALL SELECT page_id, 'hreflang-relative-url', source, hreflang FROM hl WHERE source = 'HTML' AND trim(href) <> '' AND NOT regexp_matches(trim(href), '(?i)^[a-z][a-z0-9+.-]*:') AND trim(href) NOT LIKE '//%'
 UNION ALL SELECT page_id, 'hreflang-duplicate-alternate', source, hreflang FROM hldup
 UNION ALL SELECT page_id, 'hreflang-html-sitemap-mismatch', 'HTML', hreflang FROM hlmis"""
CTES["hlid"] = f"""SELECT page_id, rule_id, regexp_replace(rule_id, '-alternate$', '') || CASE WHEN rule_id IN ('hreflang-relative-url','hreflang-html-sitemap-mismatch') THEN '' ELSE '-' || source END || '-' || {slug('hreflang')} || CASE source WHEN 'HTML' THEN '-alternates-0' ELSE '-sitemap-hreflang-0' END AS finding_id,
  CASE WHEN rule_id = 'hreflang-html-sitemap-mismatch' THEN 'alternates-0|sitemap-hreflang-0' WHEN source = 'HTML' THEN 'alternates-0' ELSE 'sitemap-hreflang-0' END AS ev FROM hlfind"""


def alternates(c):
    return HL.html_alternates(evidence(c)), HL.sitemap_alternates(evidence(c))


@query("D9_duplicate_hreflang", "SELECT * FROM hldup")
def duplicate_hreflang(c):
    html, site = alternates(c)
    return HL.duplicates(html.unionByName(site)).drop("url")


@query("H19_hreflang_tag", "SELECT page_id, source, pos, hreflang, reason IS NULL AS valid, reason, typo FROM hlv")
def hreflang_tag(c):
    html, site = alternates(c)
    v = C_verdict(F.col("hreflang"))
    return html.unionByName(site).select("page_id", "source", "pos", "hreflang", v.alias("v")).select(
        "page_id", "source", "pos", "hreflang", "v.*"
    )


from sitelens.functions.codes import hreflang_verdict as C_verdict  # noqa: E402


@query("C6_hreflang_source_mismatch", "SELECT page_id, pos, hreflang, html_href, sitemap_href FROM hlmis")
def source_mismatch(c):
    html, site = alternates(c)
    return HL.source_mismatches(html, site).drop("url")


# -- findings -----------------------------------------------------------------
CTES["fnd"] = f"""SELECT page_id, 'title-missing' AS rule_id, 'title-missing-title-0' AS finding_id, 'title-0' AS ev FROM f_title WHERE state IN ('absent','empty')
 UNION ALL SELECT page_id, 'title-duplicate', 'title-duplicate-title-0', 'title-0' FROM f_title WHERE state = 'duplicate'
 UNION ALL SELECT page_id, 'title-length', 'title-length-title-0', 'title-0' FROM f_title WHERE state = 'present' AND length(text) NOT BETWEEN 10 AND 60
 UNION ALL SELECT page_id, 'description-missing', 'description-missing-meta-description-0', 'meta-description-0' FROM f_description WHERE state IN ('absent','empty')
 UNION ALL SELECT page_id, 'description-duplicate', 'description-duplicate-meta-description-0', 'meta-description-0' FROM f_description WHERE state = 'duplicate'
 UNION ALL SELECT page_id, 'canonical-missing', 'canonical-missing-canonical-0', 'canonical-0' FROM f_canonical WHERE state IN ('absent','empty')
 UNION ALL SELECT page_id, 'canonical-multiple', 'canonical-multiple-canonical-0', 'canonical-0' FROM f_canonical WHERE state = 'duplicate'
 UNION ALL SELECT page_id, 'canonical-malformed', 'canonical-malformed-canonical-0', 'canonical-0' FROM f_canonical WHERE state = 'malformed'
 UNION ALL SELECT page_id, 'canonical-non-http', 'canonical-non-http-canonical-0', 'canonical-0' FROM c__f_canonical WHERE state = 'present' AND NOT ({http('c')})
 UNION ALL SELECT c.page_id, 'canonical-off-page', 'canonical-off-page-canonical-0', 'canonical-0' FROM c__f_canonical c JOIN page p USING (page_id) WHERE state = 'present' AND {http('c')} AND c.c_origin <> p.doc_origin
 UNION ALL SELECT page_id, 'robots-nofollow', 'robots-nofollow-meta-robots-0', 'meta-robots-0' FROM msig WHERE nofollow
 UNION ALL SELECT page_id, CASE WHEN abs_href IS NULL THEN 'hreflang-invalid-url' ELSE 'hreflang-non-http' END, CASE WHEN abs_href IS NULL THEN 'hreflang-invalid-' ELSE 'hreflang-non-http-' END || coalesce(nullif(hreflang,''),'unknown') || '-alternates-0', 'alternates-0' FROM rel WHERE rel = 'alternate' AND coalesce(NOT ({http('abs')}), true)
 UNION ALL SELECT page_id, rule_id, finding_id, ev FROM hlid
 UNION ALL SELECT page_id, 'jsonld-malformed', 'jsonld-malformed-' || pos || '-jsonld-0', 'jsonld-0' FROM jsonld WHERE status = 'invalid-json'
 UNION ALL SELECT page_id, rule_id, rule_id || '-' || sub || '-jsonld-0', 'jsonld-0' FROM jfind
 UNION ALL SELECT page_id, 'language-missing', 'language-missing-lang-0', 'lang-0' FROM f_lang WHERE text = ''
 UNION ALL SELECT page_id, 'images-missing-alt', 'images-missing-alt-images-0', 'images-0' FROM f_images WHERE missing_alt > 0
 UNION ALL SELECT page_id, 'images-empty-alt-advisory', 'images-empty-alt-advisory-images-0', 'images-0' FROM f_images WHERE empty_alt > 0
 UNION ALL SELECT p.page_id, 'indexability-noindex-signal', 'indexability-noindex-signal-meta-robots-0', 'meta-robots-0' || CASE WHEN n.page_id IS NOT NULL THEN '|browser-navigation-0' ELSE '' END FROM page p LEFT JOIN msig m USING (page_id) LEFT JOIN hsig h USING (page_id) LEFT JOIN navigations n ON n.page_id = p.page_id WHERE coalesce(m.noindex, false) OR coalesce(h.noindex, false)
 UNION ALL SELECT m.page_id, 'indexability-robots-conflict', 'indexability-robots-conflict-meta-robots-0', 'meta-robots-0|browser-navigation-0' FROM msig m JOIN hsig h USING (page_id) WHERE m.noindex <> h.noindex OR m.nofollow <> h.nofollow
 UNION ALL SELECT page_id, 'indexability-robots-blocked', 'indexability-robots-blocked-robots-evaluation-0', 'robots-evaluation-0' FROM rblock WHERE robots_blocked
 UNION ALL SELECT n.page_id, 'indexability-canonical-mismatch', 'indexability-canonical-mismatch-canonical-0', 'canonical-0|browser-navigation-0' FROM navn n JOIN canonn c USING (page_id) WHERE c.canon_norm <> n.final_norm
 UNION ALL SELECT page_id, 'indexability-redirect-loop', 'indexability-redirect-loop-browser-navigation-0', 'browser-navigation-0' FROM redirect_anom WHERE looped
 UNION ALL SELECT page_id, 'indexability-redirect-excessive', 'indexability-redirect-excessive-browser-navigation-0', 'browser-navigation-0' FROM redirect_anom WHERE hop_count > 5
 UNION ALL SELECT page_id, 'indexability-non-html-content', 'indexability-non-html-content-browser-navigation-0', 'browser-navigation-0' FROM navigations WHERE lower(trim(split_part(content_type,';',1))) NOT IN ('', 'text/html') AND lower(content_type) NOT LIKE 'text/html+%'
 UNION ALL SELECT page_id, 'indexability-sitemap-robots-blocked', 'indexability-sitemap-robots-blocked-sitemap-membership-0', 'sitemap-membership-0|robots-evaluation-0' FROM member JOIN rblock USING (page_id) WHERE sitemap_present AND robots_blocked"""
CTES["rulebook"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({q(r)}, {q(v[0])}, {q(v[1])})" for r, v in C.RULES.items()
) + ") r(rule_id, severity, category)"
CTES["finding"] = "SELECT f.page_id, f.rule_id, f.finding_id, f.ev, r.severity, r.category FROM fnd f JOIN rulebook r USING (rule_id)"

NETWORK = ("indexability-", "hreflang-directive")
OUT = "page_id, rule_id, finding_id, ev AS evidence_ids, severity, category"


def _findings(c, checks):
    src = evidence(c) if any(x.startswith(NETWORK) for x in checks) else _dom_evidence(c)
    return C.findings(src, checks).select(
        "page_id", "rule_id", "finding_id", F.array_join("evidence_ids", "|").alias("evidence_ids"), "severity", "category"
    )


def _dom_evidence(c):
    return c.once("dom_evidence", lambda: S.page_evidence(c.facts))


def _rule_query(key: str, checks: tuple[str, ...], rules: tuple[str, ...]) -> None:
    query(key, f"SELECT {OUT} FROM finding WHERE rule_id IN {in_list(rules)}")(
        lambda c: _findings(c, checks)
    )


for _key, _check, _rules in (
    ("J1_title_presence", "title-missing-or-duplicate", ("title-missing", "title-duplicate")),
    ("J2_title_length", "title-length-advisory", ("title-length",)),
    ("J3_description", "description-missing-or-duplicate", ("description-missing", "description-duplicate")),
    ("J4_canonical", "canonical-rules", ("canonical-missing", "canonical-multiple", "canonical-malformed", "canonical-non-http", "canonical-off-page")),
    ("J5_robots_meta", "robots-meta-directives", ("robots-nofollow",)),
    ("J6_hreflang_url", "hreflang-invalid-url", ("hreflang-invalid-url", "hreflang-non-http")),
    ("J7_hreflang_directives", "hreflang-directive-validation", ("hreflang-duplicate-alternate", "hreflang-likely-typo", "hreflang-invalid-language", "hreflang-empty-href", "hreflang-relative-url", "hreflang-html-sitemap-mismatch")),
    ("J8_jsonld_malformed", "jsonld-malformed", ("jsonld-malformed",)),
    ("J9_jsonld_findings", "jsonld-structural-validation", tuple(r for r in C.RULES if r.startswith("jsonld-") and r != "jsonld-malformed")),
    ("J10_language", "language-missing", ("language-missing",)),
    ("J11_images_missing_alt", "images-missing-alt", ("images-missing-alt",)),
    ("J12_images_empty_alt", "images-empty-alt-advisory", ("images-empty-alt-advisory",)),
    ("J13_noindex_signal", "indexability-noindex-signal", ("indexability-noindex-signal",)),
    ("J14_robots_conflict", "indexability-robots-conflict", ("indexability-robots-conflict",)),
    ("J15_robots_blocked", "indexability-robots-blocked", ("indexability-robots-blocked",)),
    ("J16_canonical_mismatch", "indexability-canonical-mismatch", ("indexability-canonical-mismatch",)),
    ("J17_redirect_anomaly", "indexability-redirect-anomaly", ("indexability-redirect-loop", "indexability-redirect-excessive")),
    ("J18_non_html", "indexability-non-html-content", ("indexability-non-html-content",)),
    ("J19_sitemap_robots_blocked", "indexability-sitemap-robots-blocked", ("indexability-sitemap-robots-blocked",)),
):
    _rule_query(_key, (_check,), _rules)


def full(c):
    return c.once("full_audit", lambda: audit(evidence(c), stored=True))


@query("J25_full_audit", f"SELECT {OUT} FROM finding")
def full_audit(c):
    return full(c).findings.select(
        "page_id", "rule_id", "finding_id", F.array_join("evidence_ids", "|").alias("evidence_ids"), "severity", "category"
    )


@query("G1_union_of_findings", "SELECT rule_id, count(*) AS n, count(DISTINCT page_id) AS pages FROM finding GROUP BY rule_id")
def union_of_findings(c):
    return full(c).findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


CTES["blk"] = f"SELECT page_id, array_to_string(list_sort(list_distinct(list(rule_id))), ', ') AS blocking FROM finding WHERE rule_id IN {in_list(Y.BLOCKING_RULES)} GROUP BY page_id"
CTES["base"] = "SELECT p.page_id, n.page_id IS NOT NULL AS h, r.page_id IS NOT NULL AS r, m.page_id IS NOT NULL AS m FROM page p LEFT JOIN navigations n USING (page_id) LEFT JOIN rblock r USING (page_id) LEFT JOIN member m USING (page_id)"
CTES["cnt"] = "SELECT page_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in Y.SEVERITIES) + " FROM finding GROUP BY page_id"
CTES["cats"] = "SELECT page_id, string_agg(category || '=' || n, '|' ORDER BY category) AS categories FROM (SELECT page_id, category, count(*) AS n FROM finding GROUP BY ALL) x GROUP BY page_id"


@query("D1_page_summary", "SELECT b.page_id, coalesce(c.total,0) AS total, " + ", ".join(f"coalesce(c.{s},0) AS {s}" for s in Y.SEVERITIES) + ", coalesce(k.categories, '') AS categories FROM base b LEFT JOIN cnt c USING (page_id) LEFT JOIN cats k USING (page_id)")
def page_summary(c):
    entries = F.transform(F.map_entries("by_category"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return full(c).summary.select("page_id", "total", *Y.SEVERITIES, F.coalesce(F.array_join(entries, "|"), F.lit("")).alias("categories"))


@query(
    "D2_indexability_status",
    """SELECT b.page_id, CASE WHEN NOT h AND NOT r THEN 'unknown' ELSE 'signals-partial' END AS status, CASE WHEN NOT h AND NOT r THEN 'Neither response headers nor robots.txt are at hand, so nothing can be compared.'
 WHEN k.blocking IS NOT NULL THEN 'These stand against crawling or indexing (' || k.blocking || ').' WHEN h OR r OR m THEN 'All captured sources agree that nothing blocks.' ELSE 'Some evidence was captured, too little to compare.' END AS reason FROM base b LEFT JOIN blk k USING (page_id)""",
)
def indexability_status(c):
    return full(c).summary.select("page_id", "indexability.status", "indexability.reason")


@query(
    "D3_capture_notes",
    """SELECT page_id, concat_ws('|', CASE WHEN NOT h THEN 'Without response headers their signals are not compared.' END, CASE WHEN NOT r THEN 'Without robots.txt its rules are not compared.' END,
 CASE WHEN NOT m THEN 'sitemap-membership was not captured, so listed but blocked pages were left out.' END) AS notes FROM base""",
)
def capture_notes(c):
    return full(c).summary.select("page_id", F.array_join("capture_notes", "|").alias("notes"))


HOST = "regexp_extract(url, '^https?://([^/?#:]+)', 1)"


@query(
    "D13_site_rollup",
    f"SELECT lower({HOST}) AS host, category, severity, count(*) AS findings FROM finding JOIN (SELECT page_id, url FROM pages) p USING (page_id) GROUP BY ROLLUP (lower({HOST}), category, severity)",
)
def site_rollup(c):
    from sitelens.functions.urls import parse_url

    return Y.site_rollup(full(c).findings, parse_url(F.col("affected_url"))["host"]).drop("level")


@query(
    "D14_findings_by_category",
    "SELECT page_id, category, string_agg(rule_id, '|' ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, rule_id) AS rules, count(*) AS n FROM finding GROUP BY ALL",
)
def findings_by_category(c):
    return Y.by_category(full(c).findings).withColumn("rules", F.array_join("rules", "|"))


@query(
    "F1_findings_order",
    "SELECT page_id, finding_id, row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, category, rule_id, page_id, finding_id) AS n FROM (SELECT DISTINCT page_id, finding_id, severity, category, rule_id FROM finding) f",
)
def findings_order(c):
    return Y.report_positions(full(c).findings.dropDuplicates(["page_id", "finding_id"])).select("page_id", "finding_id", "n")


@query(
    "F2_findings_by_id",
    "SELECT page_id, finding_id, row_number() OVER (PARTITION BY page_id ORDER BY finding_id) AS n FROM (SELECT DISTINCT page_id, finding_id FROM hlid) f",
)
def findings_by_id(c):
    from pyspark.sql import Window

    rows = _findings(c, ("hreflang-directive-validation",)).select("page_id", "finding_id").distinct()
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("finding_id")))


# -- availability and selection -------------------------------------------------
CTES["have"] = """SELECT p.page_id, n.page_id IS NOT NULL AS nav, r.page_id IS NOT NULL AS rob, m.page_id IS NOT NULL AS sm, coalesce(len(m.alts), 0) > 0 AS smh, a.page_id IS NOT NULL AS alt FROM page p LEFT JOIN navigations n USING (page_id) LEFT JOIN rblock r USING (page_id)
 LEFT JOIN (SELECT x.page_id, list(a.href) FILTER (a.href IS NOT NULL) AS alts FROM member x LEFT JOIN smalt a ON a.root_url = x.root_url AND a.loc = x.matched_loc GROUP BY x.page_id) m USING (page_id) LEFT JOIN (SELECT DISTINCT page_id FROM rel WHERE rel = 'alternate') a USING (page_id)"""
_NEED = {"browser-navigation": "nav", "robots-evaluation": "rob", "sitemap-membership": "sm", "sitemap-hreflang": "smh"}


def _available(check) -> str:
    if check.needs == "any":
        return "true"
    if check.needs == "hreflang":
        return "(alt OR smh)"
    return " AND ".join([_NEED[s] for s in check.sources if s in _NEED] or ["true"])


CTES["avail"] = " UNION ALL ".join(f"SELECT page_id, {q(c.id)} AS check_id, {_available(c)} AS ok FROM have" for c in C.CATALOGUE)


@query("C15_check_availability", "SELECT page_id, check_id, CASE WHEN ok THEN 'available' ELSE 'unavailable' END AS status FROM avail")
def check_availability(c):
    return C.availability(evidence(c)).select("page_id", "check_id", "status")


SOME = ("title-length-advisory", "indexability-robots-blocked", "indexability-redirect-anomaly", "not-a-check")


@query(
    "G3_skipped_checks",
    f"""SELECT page_id, check_id, CASE WHEN check_id = 'not-a-check' THEN 'No check of this name.' ELSE 'Left out by choice.' END AS reason FROM (SELECT page_id, check_id FROM avail UNION ALL SELECT page_id, 'not-a-check' FROM have) a WHERE check_id NOT IN {in_list(SOME[:3])}
 UNION ALL SELECT page_id, 'indexability-robots-blocked', 'Not captured: robots-evaluation.' FROM have WHERE NOT rob
 UNION ALL SELECT page_id, 'indexability-redirect-anomaly', 'Not captured: browser-navigation.' FROM have WHERE NOT nav""",
)
def skipped_checks(c):
    return C.selection(evidence(c), SOME).filter("NOT selected").select("page_id", "check_id", "reason")


@query("J24_check_selection", "SELECT page_id, check_id, ok AS selected FROM avail")
def check_selection(c):
    return full(c).selection.select("page_id", "check_id", "selected")


@query("L2_check_catalogue", "SELECT check_id, count(*) FILTER (ok) AS runs, count(*) FILTER (NOT ok) AS skips FROM avail GROUP BY check_id")
def check_catalogue(c):
    return C.availability(evidence(c)).groupBy("check_id").agg(
        F.count_if(F.col("status") == "available").alias("runs"), F.count_if(F.col("status") != "available").alias("skips")
    )


@query("L1_user_check", "SELECT page_id, 'few-internal-links-links-0' AS finding_id, 'few-internal-links' AS rule_id FROM f_links WHERE internal < 6")
def user_check(c):
    """A check added by a user: pages with few internal links."""
    mine = C.Check("few-internal-links", "Few internal links", "metadata", ("a[href]",), "title", findings=lambda: C._when((F.col("links.value.internal") < 6, C._finding("few-internal-links", "Few internal links.", "a[href]"))))
    return C.findings(_dom_evidence(c), ["few-internal-links"], (*C.CATALOGUE, mine)).select("page_id", "finding_id", "rule_id")
