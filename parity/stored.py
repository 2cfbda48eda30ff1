"""Queries over evidence rows, sessions, reports, clusters and navigation events."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity.duck import grouping, q, squeeze, url_chain
from parity.registry import CTES, query
from parity.rules import evidence, full, verdict
from sitelens.functions.expr import compact, csv_cell, table_cell
from sitelens.limits import CaptureLimits
from sitelens.operators import evidence as E
from sitelens.operators import facts as P
from sitelens.operators import hreflang as HL
from sitelens.operators import summary as Y
from sitelens.session import cut_lineage, new_folder
from sitelens.sources import sessions as SS
from sitelens.sources import sinks as K
from sitelens.sources.session_table import SessionTable
from sitelens.streaming import navigation as NV

# -- bounds -------------------------------------------------------------------------
TIGHT = CaptureLimits(string_chars=20, url_chars=30, meta_items=1, alternate_items=1, link_inventory=3, image_inventory=1, heading_samples=1, jsonld_scripts=1)


def tight(c):
    return c.once("tight", lambda: P.page_facts(c.table("audit_pages"), TIGHT))


@query(
    "B13_bounding",
    """SELECT t.page_id, t.state, left(t.text, 20) AS title, CASE WHEN length(t.text) > 20 THEN 'String clipped to 20 characters' END AS title_limit, left(p.doc_href, 30) AS document_url, CASE WHEN length(p.doc_href) > 30 THEN length(p.doc_href) END AS original_length
 FROM f_title t JOIN page p USING (page_id) WHERE t.state = 'present'""",
)
def bounding(c):
    return tight(c).filter("title.state = 'present'").select(
        "page_id", "title.state", F.col("title.value").alias("title"), F.col("title.limits.reason").alias("title_limit"), "document_url",
        F.col("url_bounds.document_url.original_length").alias("original_length"),
    )


@query(
    "B17_capture_limits",
    """SELECT page_id, source, omitted FROM (SELECT page_id, 'a[href]' AS source, total - 3 AS omitted FROM f_links WHERE total > 3 UNION ALL SELECT page_id, 'img', total - 1 FROM f_images WHERE total > 1
 UNION ALL SELECT page_id, 'meta[name=description]', n - 1 FROM f_description WHERE n > 1 UNION ALL SELECT page_id, 'link[rel=canonical]', n - 1 FROM f_canonical WHERE n > 1
 UNION ALL SELECT page_id, 'meta[name=robots|googlebot]', n - 1 FROM f_robots WHERE n > 1 UNION ALL SELECT page_id, 'link[rel=alternate][hreflang]', count(*) - 1 FROM rel WHERE rel = 'alternate' GROUP BY page_id HAVING count(*) > 1
 UNION ALL SELECT page_id, 'script[type=application/ld+json]', count(*) - 1 FROM script GROUP BY page_id HAVING count(*) > 1
 UNION ALL SELECT page_id, 'title', n - 1 FROM f_title WHERE n > 1 UNION ALL SELECT page_id, 'meta[name=viewport]', n - 1 FROM f_viewport WHERE n > 1
 UNION ALL SELECT page_id, 'meta[property^=og:]', count(*) - 1 FROM meta WHERE lower(prop) LIKE 'og:%' GROUP BY page_id HAVING count(*) > 1
 UNION ALL SELECT page_id, 'meta[name^=twitter:]', count(*) - 1 FROM meta WHERE name LIKE 'twitter:%' GROUP BY page_id HAVING count(*) > 1) x""",
)
def capture_limits(c):
    return E.capture_limits(tight(c)).filter("omitted_count > 0").select(
        "page_id", "source", F.col("omitted_count").alias("omitted")
    )


@query(
    "E1_first_n",
    """SELECT page_id, 'link' AS what, pos, href AS item FROM anchor WHERE pos < 3 UNION ALL SELECT page_id, 'heading', row_number() OVER (PARTITION BY page_id ORDER BY level) - 1, text FROM (SELECT *, row_number() OVER (PARTITION BY page_id, level ORDER BY pos) AS rn FROM heading) z WHERE rn <= 1""",
)
def first_n(c):
    lim = CaptureLimits(link_inventory=3, heading_samples=1)
    f = c.once("first_n", lambda: P.page_facts(c.table("audit_pages"), lim))
    one = f.select("page_id", F.lit("link").alias("what"), F.posexplode("links.value.inventory").alias("pos", "x")).select("page_id", "what", "pos", F.col("x.href").alias("item"))
    two = f.select("page_id", F.lit("heading").alias("what"), F.posexplode("headings.value.samples").alias("pos", "x")).select("page_id", "what", "pos", F.col("x.text").alias("item"))
    return one.unionByName(two)


@query(
    "E2_running_budget",
    "SELECT a.page_id, a.pos, coalesce(sum(length(b.raw)), 0) AS chars_before FROM script a LEFT JOIN script b ON b.page_id = a.page_id AND b.pos < a.pos GROUP BY a.page_id, a.pos",
)
def running_budget(c):
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return P.page_scripts(c.table("audit_pages")).select(
        "page_id", "pos", F.coalesce(F.sum(F.length("raw")).over(w), F.lit(0)).alias("chars_before")
    )


@query(
    "B15_validation",
    """SELECT DISTINCT page_id, source, issue FROM (SELECT page_id, 'title' AS source, 'raw: too long' AS issue FROM f_title WHERE state = 'present' AND length(text) > 40 UNION ALL SELECT page_id, 'title', 'values: too long' FROM ttl WHERE length(text) > 40 AND page_id IN (SELECT page_id FROM f_title WHERE state = 'duplicate')
 UNION ALL SELECT page_id, 'meta[name=description]', 'values: too many' FROM f_description WHERE n > 1 UNION ALL SELECT page_id, 'a[href]', 'inventory: too many' FROM f_links WHERE total > 8) x""",
)
def validation(c):
    loose = P.page_facts(c.table("audit_pages"), CaptureLimits(string_chars=100_000, meta_items=1_000, link_inventory=100_000))
    lim = CaptureLimits(string_chars=40, meta_items=1, link_inventory=8)
    wanted = F.col("source").isin("title", "meta[name=description]", "a[href]") & (F.col("issue") != "inventory: too long") & ~((F.col("source") == "title") & (F.col("issue") == "values: too many"))
    return E.validate(loose, lim).filter(wanted).drop("url")


SRC = {s: i for s, i, _ in E.DOM_SOURCES}
CTES["evrow"] = "SELECT page_id, 'doc-0' AS evidence_id, 'document.URL' AS source, CAST(NULL AS VARCHAR) AS state FROM page" + "".join(
    f" UNION ALL SELECT page_id, {q(SRC[s])}, {q(s)}, state FROM {t}"
    for s, t in (("title", "f_title"), ("meta[name=description]", "f_description"), ("meta[name=robots|googlebot]", "f_robots"), ("link[rel=canonical]", "f_canonical"), ("meta[name=viewport]", "f_viewport"))
) + "".join(f" UNION ALL SELECT page_id, {q(SRC[s])}, {q(s)}, 'present' FROM page" for s in ("h1-h6", "a[href]", "img", "html5-landmarks")) + f"""
 UNION ALL SELECT page_id, 'lang-0', 'html[lang]', CASE WHEN text = '' THEN 'empty' ELSE 'present' END FROM f_lang
 UNION ALL SELECT page_id, 'alternates-0', 'link[rel=alternate][hreflang]', CASE WHEN page_id IN (SELECT page_id FROM rel WHERE rel = 'alternate') THEN 'present' ELSE 'absent' END FROM page
 UNION ALL SELECT page_id, 'og-0', 'meta[property^=og:]', CASE WHEN page_id IN (SELECT page_id FROM meta WHERE lower(prop) LIKE 'og:%') THEN 'present' ELSE 'absent' END FROM page
 UNION ALL SELECT page_id, 'twitter-0', 'meta[name^=twitter:]', CASE WHEN page_id IN (SELECT page_id FROM meta WHERE name LIKE 'twitter:%') THEN 'present' ELSE 'absent' END FROM page
 UNION ALL SELECT page_id, 'jsonld-0', 'script[type=application/ld+json]', CASE WHEN page_id IN (SELECT page_id FROM script) THEN 'present' ELSE 'absent' END FROM page"""


@query("B16_evidence_rows", "SELECT page_id, evidence_id, source, state FROM evrow")
def evidence_rows(c):
    return E.evidence_rows(c.facts).select("page_id", "evidence_id", "source", "state")


@query("C1_evidence_pivot", "SELECT page_id, " + ", ".join(f"max(state) FILTER (source = {q(s)}) AS {q(s)[1:-1].join(['\"', '\"'])}" for s in SRC) + " FROM evrow WHERE source <> 'document.URL' GROUP BY page_id")
def evidence_pivot(c):
    rows = E.evidence_rows(c.facts).filter("source <> 'document.URL'").select("page_id", "source", "state", F.lit(0).alias("pos"))
    return E.pivot_evidence(rows)


@query(
    "B18_snapshot_budget",
    "SELECT s.page_id, s.pos, 'truncated' AS status, true AS over_budget FROM script s",
)
def snapshot_budget(c):
    """With a budget every page exceeds: all scripts end up marked truncated."""
    out = E.enforce_budget(c.facts, CaptureLimits(snapshot_chars=100))
    return out.select("page_id", "over_budget", F.explode("json_ld.value").alias("e")).select(
        "page_id", F.col("e.index").alias("pos"), F.col("e.parse_status").alias("status"), "over_budget"
    )


_lab = "CASE {0}.state WHEN 'absent' THEN '(absent)' WHEN 'empty' THEN '(empty)' WHEN 'duplicate' THEN '(' || {0}.n || ' values)' WHEN 'malformed' THEN '(malformed: Invalid URL)' ELSE {1} END"
CTES["robtext"] = "SELECT page_id, string_agg(content, ' | ' ORDER BY pos) FILTER (content <> '') AS t FROM meta WHERE name IN ('robots','googlebot') GROUP BY page_id"


@query(
    "B20_glance",
    f"""SELECT p.page_id, {_lab.format('t', 't.text')} AS title, {_lab.format('d', 'd.text')} AS description, {_lab.format('c', 'c.absolute')} AS canonical, CASE WHEN r.state IN ('absent','empty') THEN '(' || r.state || ')' ELSE x.t END AS meta_robots,
  CASE WHEN n.page_id IS NULL THEN 'unavailable' ELSE coalesce(n.x_robots_tag, '(absent)') END AS x_robots_tag, CASE WHEN b.page_id IS NULL THEN 'not fetched' WHEN b.robots_blocked THEN 'blocked' ELSE 'allowed' END AS robots_txt,
  CASE WHEN n.page_id IS NOT NULL THEN coalesce(h.hop_count, 0) END AS hops, l.total AS links, i.total AS images, hd.h1, hd.h2, CASE WHEN n.page_id IS NULL AND b.page_id IS NULL THEN 'unknown' ELSE 'signals-partial' END AS indexability
 FROM page p JOIN f_title t USING (page_id) JOIN f_description d USING (page_id) JOIN f_canonical c USING (page_id) JOIN f_robots r USING (page_id) LEFT JOIN robtext x USING (page_id) LEFT JOIN navigations n USING (page_id) LEFT JOIN rblock b USING (page_id) LEFT JOIN redir h USING (page_id)
 JOIN f_links l USING (page_id) JOIN f_images i USING (page_id) JOIN f_headings hd USING (page_id)""",
)
def glance(c):
    return E.glance(evidence(c)).select("page_id", "title", "description", "canonical", "meta_robots", "x_robots_tag", "robots_txt", "hops", "links", "images", "h1", "h2", "indexability")


def _compact(expr: str) -> str:
    t = squeeze(expr)
    return f"CASE WHEN length({t}) > 480 THEN left({t}, 479) || '…' ELSE coalesce(nullif({t}, ''), '(empty)') END"


_sum = "CASE state WHEN 'absent' THEN '(absent)' WHEN 'empty' THEN '(empty)' WHEN 'malformed' THEN 'Malformed: Invalid URL' WHEN 'duplicate' THEN n || ' values' ELSE {0} END"


@query(
    "B21_report_facts",
    f"""SELECT page_id, 'Title' AS label, {_sum.format(_compact('text'))} AS value FROM f_title UNION ALL SELECT page_id, 'Meta description', {_sum.format(_compact('text'))} FROM f_description UNION ALL SELECT page_id, 'Canonical', {_sum.format('absolute')} FROM f_canonical
 UNION ALL SELECT page_id, 'Meta robots', {_sum.format('text')} FROM f_robots UNION ALL SELECT page_id, 'Headings', coalesce(nullif(concat_ws(' · ', {', '.join(f"CASE WHEN h{i} > 0 THEN 'H{i}: ' || h{i} END" for i in range(1, 7))}), ''), 'No headings') FROM f_headings
 UNION ALL SELECT page_id, 'Links', 'total ' || total || '; internal ' || internal || '; external ' || external || '; other ' || other FROM f_links UNION ALL SELECT page_id, 'Images', 'total ' || total || '; alt present ' || with_alt || '; empty ' || empty_alt || '; missing ' || missing_alt FROM f_images""",
)
def report_facts(c):
    return E.report_facts(c.facts).select("page_id", "label", "value")


@query(
    "H22_cells",
    f"""SELECT page_id, pos, CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS csv, trim(regexp_replace(text, '[|\\r\\n]+', ' ', 'g')) AS cell, {_compact('text')} AS one_line FROM anchor""",
)
def cells(c):
    t = F.col("text")
    return P.page_links(c.table("audit_pages")).select("page_id", "pos", csv_cell(t).alias("csv"), table_cell(t).alias("cell"), compact(t).alias("one_line"))


@query("H24_finding_id", "SELECT page_id, rule_id, finding_id FROM finding WHERE rule_id NOT LIKE 'hreflang-%' AND rule_id NOT LIKE 'jsonld-%'")
def finding_id(c):
    return full(c).findings.filter("NOT rule_id LIKE 'hreflang-%' AND NOT rule_id LIKE 'jsonld-%'").select("page_id", "rule_id", "finding_id")


@query(
    "C8_finding_evidence",
    """SELECT f.page_id, f.finding_id, f.pos, coalesce(e.source, f.ev1) AS source, CASE WHEN e.source IS NULL THEN 'The evidence it names is not in this session.' ELSE e.state END AS summary FROM
 (SELECT page_id, finding_id, unnest(range(len(l))) AS pos, unnest(l) AS ev1 FROM (SELECT page_id, finding_id, string_split(ev, '|') AS l FROM finding) a) f LEFT JOIN evrow e ON e.page_id = f.page_id AND e.evidence_id = f.ev1""",
)
def finding_evidence(c):
    return E.finding_evidence(full(c).findings, E.evidence_rows(c.facts))


@query("D4_report_counts", "SELECT page_id, 'severity' AS grp, severity AS k, count(*) AS n FROM finding GROUP BY ALL UNION ALL SELECT page_id, 'category', category, count(*) FROM finding GROUP BY ALL")
def report_counts(c):
    f = full(c).findings
    one = f.groupBy("page_id", F.lit("severity").alias("grp"), F.col("severity").alias("k")).agg(F.count("*").alias("n"))
    return one.unionByName(f.groupBy("page_id", F.lit("category").alias("grp"), F.col("category").alias("k")).agg(F.count("*").alias("n")))


@query("D15_display_truncation", "SELECT page_id, least(total, 5) AS shown, total, total > 5 AS truncated FROM f_links")
def display_truncation(c):
    return c.facts.select("page_id", Y.truncate_list(F.col("links.value.inventory"), 5).alias("t")).select("page_id", F.size("t.shown").alias("shown"), "t.total", "t.truncated")


# -- csv ------------------------------------------------------------------------------
def _cell(e: str) -> str:
    return f"CASE WHEN regexp_matches({e}, '[\",\\r\\n]') THEN '\"' || replace({e}, '\"', '\"\"') || '\"' ELSE {e} END"


def _kind(e: str) -> str:
    return f"CASE WHEN trim({e}) LIKE '//%' OR regexp_matches(trim({e}), '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'absolute' ELSE 'relative' END"


@query("A12_links_csv", f"SELECT page_id, pos, {_cell('coalesce(abs_href, href)')} || ',' || {_cell('text')} || ',' || {_kind('href')} || ',' || {_cell('url')} AS line FROM anchor")
def links_csv(c):
    rows = P.page_links(c.table("audit_pages"))
    cols = K.link_rows(rows)
    line = K.csv_lines(cols)
    return rows.select("page_id", "pos", F.coalesce("absolute", "href").alias("link"), F.col("text").alias("anchor"), K.href_kind(F.col("href")).alias("type"), F.col("url").alias("source")).select("page_id", "pos", line.alias("line"))


@query("A13_images_csv", f"SELECT page_id, pos, {_cell('src')} || ',' || {_cell('''CASE alt_state WHEN 'missing' THEN '(missing)' WHEN 'empty' THEN '(empty)' ELSE alt END''')} || ',' || {_kind('src')} || ',' || {_cell('url')} AS line FROM img")
def images_csv(c):
    rows = P.page_images(c.table("audit_pages"))
    line = K.csv_lines(K.image_rows(rows))
    alt = F.when(F.col("alt_state") == "missing", "(missing)").when(F.col("alt_state") == "empty", "(empty)").otherwise(F.col("alt"))
    return rows.select("page_id", "pos", F.col("src").alias("image"), alt.alias("alt-attrib"), K.href_kind(F.col("src")).alias("type"), F.col("url").alias("source")).select("page_id", "pos", line.alias("line"))


# -- sessions ---------------------------------------------------------------------------
# What is wrong with a document follows from the number it was made with.
CTES["ses_issue"] = """SELECT session_id, unnest(list_filter([
  CASE WHEN v IS NULL THEN '(root): is no JSON value' END,
  CASE WHEN v > 4 THEN 'schemaVersion: is none of the known values' END,
  CASE WHEN page_id % 17 = 0 THEN 'tabUrl: is missing' END,
  CASE WHEN v > 0 AND page_id % 31 = 7 THEN 'findings.0.severity: is none of the known values' END,
  CASE WHEN v > 0 AND page_id % 31 = 9 THEN 'captureErrors.0.message: is empty' END] ||
  -- these are looked at only if the header holds
  CASE WHEN v IS NULL OR v > 4 OR page_id % 17 = 0 OR page_id % 31 IN (7, 9) THEN [] ELSE [
  CASE WHEN page_id % 31 = 11 THEN 'snapshots.1.evidence.0.id: is missing' END,
  CASE WHEN page_id % 31 = 13 AND page_id % 5 < 4 THEN 'snapshots.1.captureLimits.applied.maxMetaItems: is below 1' END,
  CASE WHEN page_id % 31 = 3 AND page_id % 5 < 3 THEN 'snapshots.1.evidence.0.value.value: is no text' END,
  CASE WHEN page_id % 31 = 5 AND page_id % 5 < 3 THEN 'snapshots.1.evidence.0.source: is no known source' END,
  CASE WHEN page_id % 31 = 15 AND v >= 3 AND page_id % 6 <> 2 THEN 'checkSelection.skippedChecks.0.reason: is missing' END] END, lambda x: x IS NOT NULL)) AS issue
 FROM (SELECT *, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON)->>'schemaVersion' END::INT AS v FROM stored_sessions) x"""
CTES["ses"] = """SELECT session_id, page_id, raw, v, session_id NOT IN (SELECT session_id FROM ses_issue) AS ok, j->>'tabUrl' AS tab_url, j->>'finalUrl' AS final_url, j->>'captureTime' AS capture_time, j->>'updatedAt' AS updated_at, j->>'extensionVersion' AS extension_version,
  CASE WHEN v <= 2 THEN 'Made before checks were recorded.' WHEN json_type(j, '$.checkSelection') IS NULL THEN 'There is no record of the checks.' END AS note, coalesce(j->>'reportMarkdown', '') AS report, CAST(j->>'$.snapshots[1].captureLimits.domEvidenceSchemaVersion' AS INT) AS dv
  FROM (SELECT *, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON)->>'schemaVersion' END::INT AS v FROM stored_sessions) x"""


@query("A6_session_issues", "SELECT session_id, issue FROM ses_issue")
def session_issues(c):
    return SS.parse(c.table("stored_sessions")).select("session_id", F.explode("issues").alias("issue"))


def sessions(c):
    return c.once("sessions", lambda: SS.load(c.table("stored_sessions"))[0])


@query("A6_session_load", "SELECT session_id, v AS stored_version, note AS recording_note, report AS report_markdown, CASE WHEN v = 1 THEN coalesce(dv, 1) ELSE dv END AS evidence_version FROM ses WHERE ok")
def session_load(c):
    return sessions(c).select("session_id", "stored_version", "recording_note", "report_markdown", F.element_at("snapshots", 2)["captureLimits"]["domEvidenceSchemaVersion"].alias("evidence_version"))


@query("A11_quarantine", "SELECT session_id, v AS original_version, md5(raw) AS payload FROM ses WHERE NOT coalesce(ok, false)")
def quarantine(c):
    return SS.load(c.table("stored_sessions"))[1].select("session_id", "original_version", F.md5("payload").alias("payload"))


@query("A7_session_list", "SELECT session_id, tab_url, final_url, capture_time, updated_at, extension_version FROM ses WHERE ok")
def session_list(c):
    return SS.listing(sessions(c))


url_chain("st", "ses", "tab_url")
url_chain("sf", "st__ses", "final_url")


@query("A8_latest_session_per_url", "SELECT url, session_id FROM (SELECT url, session_id, row_number() OVER (PARTITION BY url ORDER BY updated_at DESC, session_id DESC) AS rn FROM (SELECT DISTINCT session_id, updated_at, unnest([st_href, sf_href]) AS url FROM sf__st__ses WHERE ok) a) b WHERE rn = 1")
def latest_session(c):
    return SS.latest_by_url(sessions(c))


CTES["ses_saved"] = """SELECT session_id, page_id, CASE WHEN page_id % 2 = 1 AND dv IS NOT DISTINCT FROM 2 THEN '2026-02-01T00:00:00.000Z' ELSE updated_at END AS updated_at,
 page_id % 2 = 1 AND dv IS NOT DISTINCT FROM 2 AS saved, page_id % 3 > 0 AS held, tab_url, report
 FROM (SELECT session_id, page_id, updated_at, tab_url, report, CASE WHEN v = 1 THEN coalesce(dv, 1) ELSE dv END AS dv FROM ses WHERE ok) x"""


def _filled(c, name: str) -> tuple:
    """A new table that holds two thirds of the sessions, after the odd ones were saved, some refused."""
    s = c.once("sessions_stored", lambda: cut_lineage(sessions(c)))
    number = F.regexp_extract("session_id", "([0-9]+)", 1).cast("bigint")
    table = SessionTable(c.spark, new_folder(c.spark, name), s.schema, buckets=16)
    table.load(s.filter(number % 3 > 0))
    refused = table.save(s.filter(number % 2 == 1), "2026-02-01T00:00:00.000Z")
    return table, refused


@query(
    "A5_session_save",
    """SELECT session_id, updated_at, tab_url, report AS report_markdown, false AS refused FROM ses_saved WHERE held OR saved
 UNION ALL SELECT session_id, NULL, tab_url, report, true FROM ses_saved WHERE page_id % 2 = 1 AND NOT saved""",
)
def session_save(c):
    """What is read back from the table, and what was refused."""
    table, refused = _filled(c, "saved")
    columns = ["session_id", "updated_at", "tab_url", "report_markdown"]
    kept = table.read().select(*columns).withColumn("refused", F.lit(False))
    return kept.unionByName(refused.withColumn("updated_at", F.lit(None).cast("string")).select(*columns).withColumn("refused", F.lit(True)))


@query(
    "A9_session_delete",
    """SELECT session_id, updated_at FROM ses_saved WHERE (held OR saved) AND page_id % 5 > 0
 UNION ALL SELECT session_id, '2026-05-01T00:00:00.000Z' FROM ses_saved WHERE page_id % 10 = 0""",
)
def session_delete(c):
    """Every fifth session is deleted; of these some are saved later, others by a save that is older."""
    table, _ = _filled(c, "deleted")
    s = c.once("sessions_stored", lambda: cut_lineage(sessions(c)))
    ids = c.table("pages").filter("page_id % 5 = 0").select(F.concat(F.lit("s"), "page_id").alias("session_id"))
    # Not all of them are held: those leave no tombstone.
    table.delete(ids, "2026-03-01T00:00:00.000Z")
    number = F.regexp_extract("session_id", "([0-9]+)", 1).cast("bigint")
    table.load(s.filter((number % 10 == 5) & (number % 3 > 0)))
    table.load(s.filter(number % 10 == 0).withColumn("updated_at", F.lit("2026-05-01T00:00:00.000Z")))
    return table.read().select("session_id", "updated_at")


@query("A10_attach_runs", "SELECT s.session_id, r.run_kind = 'variantTestRun' AND page_id % 5 NOT IN (1,2) AS has_variant, r.run_kind = 'soft404ProbeRun' AND page_id % 5 NOT IN (1,2) AS has_soft404 FROM ses s JOIN run_payloads r USING (session_id) WHERE ok")
def attach_runs(c):
    out, _ = SS.attach(sessions(c), c.table("run_payloads"))
    return out.join(c.table("run_payloads").select("session_id"), "session_id").select(
        "session_id", F.col("variant_run").isNotNull().alias("has_variant"), F.col("soft404_run").isNotNull().alias("has_soft404")
    )


@query("E3_latest_snapshot", "SELECT session_id, 'new' AS snapshot_id, 1 AS evidence_rows FROM ses WHERE ok")
def latest_snapshot(c):
    return SS.latest_snapshot(sessions(c)).select("session_id", F.col("snapshot.id").alias("snapshot_id"), F.size("snapshot.evidence").alias("evidence_rows"))


_f = lambda rule, sev, cat, desc, ev: f"'### {rule}' || chr(10) || chr(10) || '**Severity:** {sev}  ' || chr(10) || '**Category:** {cat}  ' || chr(10) || '**URL:** ' || tab_url || chr(10) || chr(10) || '{desc}' || chr(10) || chr(10) || '**Evidence**' || chr(10) || {ev} || chr(10) || chr(10) || '**Advice:** r' || chr(10) || chr(10) || '[Background](x)' || chr(10) || chr(10)"
_nl = " || chr(10) || "
_facts = _nl.join([f"'| {label} | ' || {'''concat('T', page_id)''' if s == 'title' else q('Not part of this audit.')} || ' | {s.replace('|', ' ')} |'" for s, label in (*E.REPORT_FACTS, ("capture.limits", "Capture limits"))])
MARKDOWN = _nl.join(
    [q(x) for x in ("# Page audit", "", "## Session", "", "| Field | Value | Source |", "| --- | --- | --- |")]
    + ["'| Tab URL | ' || tab_url || ' | tab |'", "'| Final URL | ' || final_url || ' | document |'", "'| Captured | ' || capture_time || ' | session |'", "'| Version | ' || extension_version || ' | build |'"]
    + [q(x) for x in ("", "## What was captured", "", "- **Dom Collector: captured**", "- **Header Capture: not captured, so nothing follows from it**", "- **Robots Fetch: not captured, so nothing follows from it**", "", "## Findings by severity", "", "- critical: 0", "- error: 1", "- warning: 0", "- info: 1", "", "| Category | Findings |", "| --- | ---: |", "| indexability | 1 |", "| metadata | 1 |", "", "## Facts", "", "| Fact | Value | Source |", "| --- | --- | --- |")]
    + [_facts]
    + [q(x) for x in ("", "## Problems while capturing", "", "- **headerCapture:** c1: none", "", "## Findings", "")]
) + _nl + _f("canonical-multiple", "error", "indexability", "d | e", "'- **canonical-0:** The evidence it names is not in this session.'") + " || " + _f("title-length", "info", "metadata", "d", "'- **title:** {\"selector\":\"title\",\"state\":\"present\",\"value\":\"T' || page_id || '\"}'") + " || '## Notes' || chr(10) || chr(10) || CASE WHEN trim(report) = '' THEN 'No notes.' ELSE trim(report) END"


@query("A14_markdown_report", f"SELECT session_id, {MARKDOWN} AS document FROM ses WHERE ok")
def markdown_report(c):
    return K.markdown(sessions(c))


# -- hreflang edges and clusters ------------------------------------------------------------
@query("I4_hreflang_edges", "SELECT page_id, i AS pos, lower(trim(hreflang)) AS hreflang, coalesce(abs_href, trim(href)) AS href FROM rel WHERE rel = 'alternate' AND trim(hreflang) <> '' AND trim(href) <> ''")
def hreflang_edges(c):
    return HL.page_edges(P.page_structure(c.table("audit_pages"))).select("page_id", "pos", "hreflang", "href")


url_chain("m", "cluster_members", "final_url")
url_chain("e", "cluster_edges", "href")
CTES["cm"] = f"SELECT cluster_id, member_id, lower(hreflang) AS hreflang, requested_url, final_url, {grouping('m', 'final_url')} AS norm FROM m__cluster_members"
CTES["ceraw"] = f"SELECT cluster_id, member_id, lower(hreflang) AS hreflang, {grouping('e', 'href')} AS norm FROM e__cluster_edges"
CTES["ce"] = "SELECT * FROM ceraw WHERE member_id IN (SELECT member_id FROM cm)"
CTES["cv"] = verdict("ce", "cluster_id, member_id")
CTES["cfind"] = """SELECT cluster_id, member_id, 'hreflang-cluster-duplicate-alternate' AS rule_id, hreflang AS detail FROM ce GROUP BY ALL HAVING count(*) > 1
 UNION ALL SELECT cluster_id, member_id, CASE WHEN typo IS NOT NULL THEN 'hreflang-cluster-likely-typo' ELSE 'hreflang-cluster-invalid-language' END, hreflang FROM cv WHERE reason IS NOT NULL
 UNION ALL SELECT cluster_id, member_id, 'hreflang-cluster-missing-self-ref', hreflang FROM cm m WHERE NOT EXISTS (SELECT 1 FROM ce e WHERE e.member_id = m.member_id AND e.hreflang = m.hreflang AND e.norm = m.norm)
 UNION ALL SELECT m.cluster_id, m.member_id, 'hreflang-cluster-missing-return', o.hreflang || ' ' || o.final_url FROM cm m JOIN cm o ON o.cluster_id = m.cluster_id AND o.requested_url <> m.requested_url WHERE NOT EXISTS (SELECT 1 FROM ce e WHERE e.member_id = m.member_id AND e.hreflang = o.hreflang AND e.norm = o.norm)"""


CTES["cgiven"] = """SELECT DISTINCT m.cluster_id, m.member_id, o.member_id AS other_id FROM cm m JOIN cm o ON o.cluster_id = m.cluster_id AND o.requested_url <> m.requested_url
 JOIN ce e ON e.member_id = m.member_id AND e.hreflang = o.hreflang AND e.norm = o.norm"""
CTES["cowed"] = "SELECT m.cluster_id, m.member_id, count(*) AS owed FROM cm m JOIN cm o ON o.cluster_id = m.cluster_id AND o.requested_url <> m.requested_url GROUP BY ALL"
CTES["cgroup"] = """SELECT *, min(member_id) OVER (PARTITION BY cluster_id, has) AS group_id FROM (
 SELECT w.cluster_id, w.member_id, w.owed, w.owed - count(g.other_id) AS lacking, coalesce(list(g.other_id ORDER BY g.other_id) FILTER (g.other_id IS NOT NULL), []) AS has
 FROM cowed w LEFT JOIN cgiven g USING (cluster_id, member_id) GROUP BY w.cluster_id, w.member_id, w.owed) t WHERE lacking > 0"""


def _cluster(c):
    def make():
        members = c.table("cluster_members")
        edges = c.table("cluster_edges").join(members.select("member_id"), "member_id", "left_semi")
        return HL.cluster_findings(members, edges)

    return c.once("cluster", make)


@query("C7_cluster_reciprocity", "SELECT cluster_id, member_id, rule_id, detail FROM cfind WHERE rule_id LIKE '%missing%'")
def reciprocity(c):
    """Every missing return written out as a pair."""
    found, membership, lacking = _cluster(c)
    pairs = HL.missing_pairs(membership, lacking).select(
        "cluster_id", "member_id", F.lit("hreflang-cluster-missing-return").alias("rule_id"), F.concat("other_lang", F.lit(" "), "other_final").alias("detail")
    )
    own = found.filter("rule_id LIKE '%missing-self-ref'").select("cluster_id", "member_id", "rule_id", "detail")
    return own.unionByName(pairs)


@query(
    "C7_deficit_groups",
    """SELECT 'member' AS what, cluster_id, group_id, member_id AS id, lacking AS n FROM cgroup
 UNION ALL SELECT 'target', g.cluster_id, g.group_id, o.member_id, NULL FROM (SELECT cluster_id, group_id, any_value(has) AS has FROM cgroup GROUP BY ALL) g
  JOIN cm o ON o.cluster_id = g.cluster_id AND NOT list_contains(g.has, o.member_id)""",
)
def deficits(c):
    _, membership, lacking = _cluster(c)
    members = membership.select(F.lit("member").alias("what"), "cluster_id", "group_id", F.col("member_id").alias("id"), F.col("lacking").alias("n"))
    targets = lacking.select(F.lit("target").alias("what"), "cluster_id", "group_id", F.col("other_id").alias("id"), F.lit(None).cast("bigint").alias("n"))
    return members.unionByName(targets)


@query(
    "J20_cluster_findings",
    """SELECT cluster_id, member_id, rule_id, detail, CASE WHEN rule_id = 'hreflang-cluster-likely-typo' THEN 'warning' ELSE 'error' END AS severity FROM (
 SELECT * FROM cfind WHERE rule_id NOT LIKE '%missing-return'
 UNION ALL SELECT cluster_id, member_id, 'hreflang-cluster-missing-return', lacking || ' of ' || owed || ' members, as ' || group_id FROM cgroup) t""",
)
def cluster_findings(c):
    return _cluster(c)[0].select("cluster_id", "member_id", "rule_id", "detail", "severity")


# -- navigation events ---------------------------------------------------------------------
CTES["ctl"] = "SELECT tab_id, ts, kind FROM nav_events WHERE kind IN ('watch','unwatch')"
CTES["gated"] = """SELECT e.*, w.ts AS since FROM (SELECT * FROM nav_events WHERE frame = 'main_frame' AND kind NOT IN ('watch','unwatch')) e ASOF JOIN ctl w ON w.tab_id = e.tab_id AND w.ts <= e.ts WHERE w.kind = 'watch'"""
CTES["hdrs"] = """SELECT tab_id, request_id, string_agg(name || '=' || v, '|' ORDER BY name) AS headers FROM (SELECT tab_id, request_id, name, arg_max(v, seq) AS v FROM (SELECT tab_id, request_id, seq, lower(h.name) AS name, string_agg(h.value, ', ' ORDER BY k) AS v FROM
  (SELECT tab_id, request_id, seq, unnest(headers) AS h, unnest(range(len(headers))) AS k FROM gated WHERE kind = 'headers') a WHERE lower(h.name) IN ('cache-control','content-type','link','location','refresh','vary','x-robots-tag') GROUP BY ALL) b GROUP BY ALL) c GROUP BY ALL"""
CTES["navs"] = """SELECT g.tab_id, g.request_id, arg_min(g.url, g.seq) AS requested_url, arg_max(g.url, g.seq) FILTER (kind = 'completed') AS final_url, max(g.status_code) FILTER (kind = 'completed') AS status_code,
  coalesce(string_agg(g.url || '>' || g.redirect_url || '>' || g.status_code, '|' ORDER BY g.seq) FILTER (kind = 'redirect'), '') AS hops, max(g.ts) FILTER (kind = 'completed') AS observed_at FROM gated g GROUP BY g.tab_id, g.request_id HAVING count(*) FILTER (kind = 'completed') > 0"""
NAVS = "SELECT n.tab_id, n.request_id, requested_url, final_url, status_code, hops, coalesce(h.headers, '') AS headers FROM navs n LEFT JOIN hdrs h ON h.tab_id = n.tab_id AND h.request_id = n.request_id"
NAV_COLUMNS = ("tab_id", "request_id", "requested_url", "final_url", "status_code", "hops", "headers")


def _observed(c):
    def run():
        c.spark.conf.set("spark.sql.streaming.stateStore.providerClass", NV.ROCKSDB)
        home = new_folder(c.spark, "navigation")
        c.table("nav_events").write.parquet(f"{home}/events")
        from sitelens.sources.tables import nav_event_stream

        stream = NV.navigation_stream(nav_event_stream(c.spark, f"{home}/events"))
        NV.write_observations(stream, f"{home}/out", f"{home}/state").awaitTermination()
        return c.spark.read.parquet(f"{home}/out")

    return c.once("observed", run)


@query("K1_navigation_stream", NAVS)
def navigation_stream(c):
    return _observed(c).select(*NAV_COLUMNS)


@query("K1_navigation_batch", NAVS)
def navigation_batch(c):
    return NV.assemble(c.table("nav_events")).select(*NAV_COLUMNS)


@query("K2_watch_gate", "SELECT tab_id, request_id, seq, kind FROM gated")
def watch_gate(c):
    return NV.gate(c.table("nav_events")).select("tab_id", "request_id", "seq", "kind")


@query("K3_latest_per_tab", "SELECT tab_id, request_id, final_url FROM (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY observed_at DESC, request_id DESC) AS rn FROM navs) x WHERE rn = 1")
def latest_per_tab(c):
    return NV.latest_per_tab(_observed(c)).select("tab_id", "request_id", "final_url")


LATEST = "SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY observed_at DESC, request_id DESC) AS rn FROM navs"
SERVED = f"""SELECT tab_id, request_id, requested_url, final_url, status_code, hops FROM ({LATEST}) x
 WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM ctl w WHERE w.tab_id = x.tab_id AND w.kind = 'unwatch' AND w.ts >= x.observed_at)"""
SERVED_COLUMNS = ("tab_id", "request_id", "requested_url", "final_url", "status_code", "hops")


@query("K3_serving_table", SERVED)
def serving(c):
    """The stream runs twice, over the earlier and then the later half of the events."""
    from sitelens.sources.tables import nav_event_stream

    c.spark.conf.set("spark.sql.streaming.stateStore.providerClass", NV.ROCKSDB)
    home, events = new_folder(c.spark, "serving"), c.table("nav_events")
    middle = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    table = NV.serving_table(c.spark, f"{home}/latest")
    for half in (F.col("ts") <= F.lit(middle), F.col("ts") > F.lit(middle)):
        events.filter(half).write.mode("append").parquet(f"{home}/events")
        changes = NV.change_stream(nav_event_stream(c.spark, f"{home}/events"))
        NV.write_latest(changes, table, f"{home}/state").awaitTermination()
    return NV.read_latest(table).select(*SERVED_COLUMNS)


@query("K3_latest_watched", SERVED)
def latest_watched(c):
    events = c.table("nav_events")
    return NV.latest_watched(NV.assemble(events), events).select(*SERVED_COLUMNS)


@query("K4_robots_first_fetch", "SELECT session_id, origin, min(page_id) AS page_id FROM robots_fetch_log GROUP BY ALL")
def robots_first_fetch(c):
    return NV.first_robots_fetch(c.table("robots_fetch_log")).select("session_id", "origin", "page_id")


@query("K4_robots_once", "SELECT DISTINCT session_id, origin FROM robots_fetch_log")
def robots_once(c):
    """Stream form; which row of a key arrives first is up to the files, so only keys are compared."""
    home = new_folder(c.spark, "robots")
    log = c.table("robots_fetch_log")
    log.write.parquet(f"{home}/log")
    stream = NV.robots_once(c.spark.readStream.schema(log.schema).parquet(f"{home}/log"))
    run = (
        stream.writeStream.format("parquet")
        .option("path", f"{home}/out")
        .option("checkpointLocation", f"{home}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return c.spark.read.parquet(f"{home}/out").select("session_id", "origin")
