"""Queries over robots.txt and sitemaps."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from parity.duck import grouping, http, q, trim, url_chain
from parity.registry import CTES, query
from sitelens.operators import robots as R
from sitelens.operators import sitemaps as S
from sitelens.session import cut_lineage

HTML_BODY = "regexp_matches(body, '(?i)^\\s*(?:<!doctype html|<html)')"
CTES["robots_ok"] = f"""SELECT *, CASE WHEN fetch_error IS NOT NULL THEN 'robots-fetch-failed' WHEN status <> 200 THEN 'robots-fetch-non-200'
 WHEN truncated THEN 'robots-fetch-oversized' WHEN lower(trim(split_part(content_type, ';', 1))) = 'text/html' OR {HTML_BODY} THEN 'robots-fetch-html' END AS error_code FROM robots_files"""
CTES["rline"] = f"""SELECT origin, n AS line_number, t, CASE WHEN regexp_matches(t, '^[^:]*[^:\\s][^:]*:') THEN trim(split_part(t, ':', 1)) END AS name,
 {trim("substring(t, position(':' IN t) + 1)")} AS value FROM (SELECT origin, n, {trim("regexp_replace(line, '(?s)#.*$', '')")} AS t FROM
 (SELECT origin, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM (SELECT origin, string_split_regex(body, '\\r?\\n') AS l FROM robots_ok WHERE error_code IS NULL) a) b) c WHERE t <> ''"""
CTES["rdir"] = """SELECT *, sum(opens) OVER (PARTITION BY origin ORDER BY line_number) - 1 AS group_no FROM (
 SELECT origin, line_number, name, value, lower(name) AS kind, CASE WHEN prev IS NULL OR (lower(name) = 'user-agent' AND prev <> 'user-agent') THEN 1 ELSE 0 END AS opens, prev IS NULL AND lower(name) <> 'user-agent' AS implicit
 FROM (SELECT *, lag(lower(name)) OVER (PARTITION BY origin ORDER BY line_number) AS prev FROM rline WHERE lower(name) IN ('allow','disallow') OR (lower(name) = 'user-agent' AND value <> '')) a) b"""
CTES["ragent"] = "SELECT origin, group_no, value AS ua FROM rdir WHERE kind = 'user-agent' UNION ALL SELECT origin, group_no, '*' FROM rdir WHERE implicit"
CTES["rchosen"] = """SELECT origin, profile, group_no FROM (SELECT a.origin, p.profile, a.group_no, row_number() OVER (PARTITION BY a.origin, p.profile ORDER BY CASE WHEN ua = '*' THEN 0 ELSE length(ua) END DESC, group_no) AS rn
 FROM ragent a JOIN (VALUES ('Googlebot'), ('*')) p(profile) ON a.ua = '*' OR starts_with(lower(p.profile), lower(a.ua))) x WHERE rn = 1"""
url_chain("u", "pages", "url")
CTES["rpage"] = "SELECT p.page_id, p.u_origin AS origin, p.u_path AS path FROM u__pages p JOIN robots_ok r ON p.u_origin = r.origin AND r.error_code IS NULL"
ESC = "regexp_replace(regexp_replace(value, '\\$$', ''), '([|\\\\{}()\\[\\]^$+?.])', '\\\\\\1', 'g')"
CTES["reval"] = f"""SELECT page_id, origin, path, profile, kind IS DISTINCT FROM 'disallow' AS crawlable, CASE WHEN group_no IS NULL THEN 'no-matching-group' WHEN kind IS NULL THEN 'no-matching-rules' ELSE kind || '-rule' END AS reason, kind AS rule_kind, value AS pattern, line_number
 FROM (SELECT p.page_id, p.origin, p.path, f.profile, c.group_no, r.kind, r.value, r.line_number, row_number() OVER (PARTITION BY p.page_id, f.profile ORDER BY length(r.value) DESC NULLS LAST, CASE WHEN r.kind = 'allow' THEN 0 ELSE 1 END, r.line_number) AS rn
  FROM rpage p JOIN (VALUES ('Googlebot'), ('*')) f(profile) ON true LEFT JOIN rchosen c ON c.origin = p.origin AND c.profile = f.profile
  LEFT JOIN (SELECT *, '^' || replace({ESC}, '*', '.*') || CASE WHEN value LIKE '%$' THEN '$' ELSE '' END AS rx FROM rdir WHERE kind <> 'user-agent' AND value <> '') r
   ON r.origin = c.origin AND r.group_no = c.group_no AND regexp_matches(p.path, r.rx)) z WHERE rn = 1"""
CTES["rblock"] = "SELECT page_id, any_value(path) AS robots_path, bool_or(NOT crawlable) AS robots_blocked, coalesce(string_agg(CASE WHEN NOT crawlable THEN profile || ': disallowed (' || rule_kind || ' ' || pattern || ')' END, '; ' ORDER BY CASE profile WHEN '*' THEN 1 ELSE 0 END), '') AS robots_blocked_by FROM reval GROUP BY page_id"


def robots(c):
    return c.table("robots_files")


@query("A3_robots_admission", "SELECT origin, error_code FROM robots_ok")
def robots_admission(c):
    return R.admit(robots(c)).select("origin", "error_code")


@query("I1_robots_rules", "SELECT origin, group_no, kind, value AS pattern, line_number FROM rdir WHERE kind <> 'user-agent'")
def robots_rules(c):
    return R.robots_rules(R.robots_groups(robots(c)))


@query("I1_robots_sitemaps", "SELECT origin, line_number, value AS sitemap FROM rline WHERE lower(name) = 'sitemap' AND value <> ''")
def robots_sitemaps(c):
    return R.robots_sitemaps(R.robots_lines(robots(c)))


@query(
    "I1_robots_diagnostics",
    """SELECT * FROM (SELECT origin, line_number, CASE WHEN name IS NULL THEN t WHEN lower(name) = 'sitemap' THEN 'Sitemap' WHEN lower(name) = 'user-agent' THEN 'User-agent' ELSE name END AS directive,
 CASE WHEN name IS NULL THEN 'Not of the form "name: value".' WHEN lower(name) NOT IN ('user-agent','allow','disallow','sitemap') THEN 'Passed over the unknown name "' || name || '".'
  WHEN lower(name) = 'sitemap' AND value = '' THEN 'A sitemap line without a URL.' WHEN lower(name) = 'user-agent' AND value = '' THEN 'A user-agent line without a name.' END AS message FROM rline) d WHERE message IS NOT NULL
 UNION ALL SELECT origin, line_number, name, 'A rule before the first user-agent line; it counts for every agent.' FROM rdir WHERE implicit""",
)
def robots_diagnostics(c):
    return R.robots_diagnostics(robots(c))


@query("E7_robots_groups", "SELECT origin, group_no, string_agg(ua, '|' ORDER BY ua) AS agents FROM ragent GROUP BY ALL")
def robots_group_agents(c):
    agents = R.robots_agents(R.robots_groups(robots(c)))
    return agents.groupBy("origin", "group_no").agg(
        F.array_join(F.array_sort(F.collect_list("user_agent")), "|").alias("agents")
    )


@query("E4_robots_group_choice", "SELECT * FROM rchosen")
def robots_group_choice(c):
    return R.select_groups(R.robots_agents(R.robots_groups(robots(c))))


@query("C3_robots_evaluation", "SELECT page_id, origin, path, profile, crawlable, reason, rule_kind, pattern, line_number FROM reval")
def robots_evaluation(c):
    return R.evaluate(c.table("pages"), robots(c))


@query(
    "E5_longest_match",
    "SELECT page_id, profile, rule_kind, pattern, length(pattern) AS pattern_length FROM reval WHERE pattern IS NOT NULL",
)
def longest_match(c):
    return R.evaluate(c.table("pages"), robots(c)).filter("pattern IS NOT NULL").select(
        "page_id", "profile", "rule_kind", "pattern", F.length("pattern").alias("pattern_length")
    )


@query(
    "H9_robots_path_pattern",
    f"SELECT DISTINCT value AS pattern, '^' || replace({ESC}, '*', '.*') || CASE WHEN value LIKE '%$' THEN '$' ELSE '' END AS regex FROM rdir WHERE kind <> 'user-agent'",
)
def path_pattern(c):
    rules = R.robots_rules(R.robots_groups(robots(c))).select("pattern").distinct()
    regex = F.regexp_replace(F.substr(R.path_regex(F.col("pattern")), F.lit(5)), r"\\z$", r"\$")
    return rules.select("pattern", regex.alias("regex"))


@query(
    "H10_user_agent_prefix",
    "SELECT origin, ua AS user_agent, p.profile, ua = '*' OR starts_with(lower(p.profile), lower(ua)) AS matches FROM ragent JOIN (VALUES ('Googlebot'), ('*')) p(profile) ON true",
)
def user_agent_prefix(c):
    agents = R.robots_agents(R.robots_groups(robots(c)))
    return agents.select(
        "origin", "user_agent", F.explode(F.array(*[F.lit(p) for p in R.PROFILES])).alias("profile")
    ).withColumn("matches", R.agent_matches(F.col("user_agent"), F.col("profile")))


# -- sitemaps ---------------------------------------------------------------
CTES["smx"] = """SELECT *, regexp_extract_all(body, '&(#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);', 1) AS ents FROM sitemap_files"""
CTES["smp"] = """SELECT root_url, file_url, body, CASE WHEN fetch_error IS NOT NULL THEN 'sitemap-fetch-failed' WHEN status <> 200 THEN 'sitemap-fetch-non-200' WHEN truncated THEN 'sitemap-fetch-oversized'
  WHEN trim(body) = '' THEN 'sitemap-fetch-empty' WHEN regexp_matches(body, '(?i)<!DOCTYPE') OR len(list_filter(ents, lambda e: e[1] <> '#' AND e NOT IN ('amp','lt','gt','quot','apos'))) > 0
  OR NOT regexp_matches(body, '</(urlset|sitemapindex)>\\s*$') THEN 'sitemap-parse-failed' END AS error_code,
  CASE WHEN regexp_matches(body, '(?i)<!DOCTYPE') THEN 'A sitemap must not declare a DOCTYPE.' WHEN len(list_filter(ents, lambda e: e[1] <> '#' AND e NOT IN ('amp','lt','gt','quot','apos'))) > 0
   THEN 'The entity "&' || list_filter(ents, lambda e: e[1] <> '#' AND e NOT IN ('amp','lt','gt','quot','apos'))[1] || ';" is none of the five that need no declaration.' ELSE 'The XML is not well-formed' END AS why,
  CASE WHEN body LIKE '%<urlset%' THEN 'urlset' ELSE 'sitemapindex' END AS root FROM smx"""
UNX = "replace(replace(replace(regexp_extract(item, '(?s)<loc>(.*?)</loc>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
CTES["smentry"] = f"""SELECT *, row_number() OVER (PARTITION BY root_url, file_url, loc ORDER BY pos) - 1 AS copy FROM (SELECT root_url, file_url, pos, item, {trim(UNX)} AS loc,
  nullif(regexp_extract(item, '<lastmod>(.*?)</lastmod>', 1), '') AS lastmod FROM (SELECT root_url, file_url, unnest(range(len(l))) AS pos, unnest(l) AS item
  FROM (SELECT root_url, file_url, regexp_extract_all(body, '(?s)<url>.*?</url>') AS l FROM smp WHERE error_code IS NULL AND root = 'urlset') a) b) c WHERE loc <> ''"""
CTES["smchild"] = f"""SELECT root_url, file_url, pos, {trim(UNX)} AS child_url FROM (SELECT root_url, file_url, unnest(range(len(l))) AS pos, unnest(l) AS item
  FROM (SELECT root_url, file_url, regexp_extract_all(body, '(?s)<sitemap>.*?</sitemap>') AS l FROM smp WHERE error_code IS NULL AND root = 'sitemapindex') a) b WHERE item LIKE '%<loc>%'"""
CTES["smwalk"] = """SELECT root_url, root_url AS file_url, 0 AS depth, [0] AS visit_key, [root_url] AS way FROM (SELECT DISTINCT root_url FROM sitemap_files) r
 UNION ALL /*recursive*/ SELECT w.root_url, c.child_url, w.depth + 1, list_append(w.visit_key, c.pos), list_append(w.way, c.child_url)
 FROM smwalk w JOIN smchild c ON c.root_url = w.root_url AND c.file_url = w.file_url WHERE NOT list_contains(w.way, c.child_url)"""
CTES["smfile"] = "SELECT root_url, file_url, min(depth) AS depth, arg_min(visit_key, {'d': depth, 'k': visit_key}) AS visit_key FROM smwalk GROUP BY ALL"
_LARGE = "sitemap_files|smx|smp|smentry|smchild|smwalk|smfile"
for _name in _LARGE.split("|")[1:]:
    CTES[f"{_name}_large"] = re.sub(rf"\b({_LARGE})\b", r"\1_large", CTES[_name])
CTES["smmerged"] = """SELECT * EXCLUDE (rn) FROM (SELECT e.*, f.depth, f.visit_key, row_number() OVER (PARTITION BY e.root_url, e.loc ORDER BY f.depth, f.visit_key, e.pos) AS rn FROM smentry e JOIN smfile f USING (root_url, file_url)) z WHERE rn = 1"""
CTES["smalt"] = """SELECT root_url, file_url, loc, pos, k, lower(regexp_extract(a, 'hreflang="([^"]*)"', 1)) AS hreflang, regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM
 (SELECT root_url, file_url, loc, pos, unnest(range(len(l))) AS k, unnest(l) AS a FROM (SELECT *, list_filter(regexp_extract_all(item, '<xhtml:link[^>]*/>'), lambda x: NOT contains(x, 'rel="stylesheet"')) AS l FROM smmerged) m) n"""


def slashed(p: str) -> str:
    head = f"regexp_extract({p}_href, '^([^:]+://[^/?#]*)', 1)"
    other = f"CASE WHEN {p}_path LIKE '%/' THEN CASE WHEN length({p}_path) > 1 THEN concat({head}, regexp_replace({p}_path, '/+$', ''), {p}_query, {p}_frag) END ELSE concat({head}, {p}_path, '/', {p}_query, {p}_frag) END"
    return f"CASE WHEN {http(p)} THEN list_distinct_keep([{p}_href, {other}]) END".replace("list_distinct_keep", "list_filter").replace(f"{other}])", f"{other}], lambda v: v IS NOT NULL)")


url_chain("l", "smmerged", "loc")
CTES["pagevar"] = f"SELECT page_id, url, u_origin AS origin, {slashed('u')} AS vs FROM u__pages"
CTES["locvar"] = f"SELECT root_url, loc, file_url, depth, visit_key, pos, regexp_extract(root_url, '^(https?://[^/]+)', 1) AS origin, unnest({slashed('l')}) AS key FROM l__smmerged"
CTES["smusable"] = "SELECT DISTINCT regexp_extract(root_url, '^(https?://[^/]+)', 1) AS origin FROM smp WHERE error_code IS NULL"
CTES["member"] = """SELECT p.page_id, m.loc IS NOT NULL AS sitemap_present, m.loc AS matched_loc, m.file_url AS sitemap_file, m.root_url FROM (SELECT * FROM pagevar WHERE origin IN (SELECT origin FROM smusable)) p LEFT JOIN
 (SELECT * FROM (SELECT p.page_id, l.loc, l.file_url, l.root_url, row_number() OVER (PARTITION BY p.page_id ORDER BY CASE WHEN l.loc = p.vs[1] THEN 0 WHEN list_contains(p.vs, l.loc) THEN 1 ELSE 2 END, l.depth, l.visit_key, l.pos, l.loc) AS rn
  FROM (SELECT page_id, origin, vs, unnest(vs) AS key FROM pagevar) p JOIN locvar l ON l.origin = p.origin AND l.key = p.key) z WHERE rn = 1) m USING (page_id)"""


def parsed(c):
    """Parsed once, read several times: keep it in the checkpoint folder."""
    return c.once("parsed_sitemaps", lambda: cut_lineage(S.parse_files(c.table("sitemap_files"))))


@query(
    "A4_sitemap_admission",
    "SELECT root_url, file_url, error_code, CASE WHEN error_code = 'sitemap-parse-failed' THEN why END AS error, CASE WHEN error_code IS NULL THEN root END AS kind FROM smp",
)
def sitemap_admission(c):
    return parsed(c).where("chunk = 0").drop("doc", "chunk", "first")


@query("I2_sitemap_entries", "SELECT root_url, file_url, pos, loc, lastmod FROM smentry WHERE copy = 0")
def sitemap_entries(c):
    return S.file_entries(parsed(c)).filter("copy = 0").select("root_url", "file_url", "pos", "loc", "lastmod")


@query("I2_sitemap_children", "SELECT root_url, file_url, pos, child_url FROM smchild")
def sitemap_children(c):
    return S.child_refs(parsed(c))


@query(
    "I2_sitemap_diagnostics",
    """SELECT file_url, message, count(*) AS n FROM (SELECT file_url, 'Listed again: ' || loc || ' (the first counts)' AS message FROM smentry WHERE copy > 0
 UNION ALL SELECT file_url, CASE WHEN root = 'urlset' THEN 'A page without a location.' ELSE 'A sitemap without a location.' END FROM (SELECT file_url, root, unnest(regexp_extract_all(body, '(?s)<(?:url|sitemap)>.*?</(?:url|sitemap)>')) AS item FROM smp WHERE error_code IS NULL) u WHERE item NOT LIKE '%<loc>%') d GROUP BY ALL""",
)
def sitemap_diagnostics(c):
    return S.file_diagnostics(parsed(c))


@query(
    "I2_sitemap_alternates",
    "SELECT root_url, loc, k AS pos, hreflang, href FROM smalt",
)
def sitemap_alternates(c):
    return S.merged_entries(parsed(c)).select(
        "root_url", "loc", F.posexplode("alternates").alias("pos", "a")
    ).select("root_url", "loc", "pos", "a.hreflang", "a.href")


@query(
    "H25_sitemap_xml_safety",
    """SELECT file_url, CASE WHEN regexp_matches(body, '(?i)<!DOCTYPE') THEN 'A sitemap must not declare a DOCTYPE.'
  WHEN len(bad) > 0 THEN 'The entity "&' || bad[1] || ';" is none of the five that need no declaration.' END AS error
 FROM (SELECT file_url, body, list_filter(ents, lambda e: e[1] <> '#' AND e NOT IN ('amp','lt','gt','quot','apos')) AS bad FROM smx) t""",
)
def xml_safety(c):
    return c.table("sitemap_files").select("file_url", S.xml_safety_error(F.col("body")).alias("error"))


@query(
    "C12_sitemap_index_expansion",
    "SELECT w.root_url, w.file_url, w.depth, array_to_string(w.visit_key, '.') AS visit_key, s.file_url IS NOT NULL AS captured FROM smfile w LEFT JOIN sitemap_files s USING (root_url, file_url)",
)
def index_expansion(c):
    return S.expand_indexes(parsed(c)).drop("over_limit").withColumn("visit_key", F.array_join(F.col("visit_key").cast("array<string>"), "."))


def parsed_large(c):
    """The files come in parts: the body of the largest grows with the pages, beyond what a row can hold."""
    parts = c.table("sitemap_parts_large").withColumn("part", F.struct("section", "part")).drop("section")
    return c.once("parsed_large", lambda: cut_lineage(S.parse_files(parts)))


@query(
    "C12_deep_indexes",
    "SELECT w.root_url, w.file_url, w.depth, array_to_string(w.visit_key, '.') AS visit_key, s.file_url IS NOT NULL AS captured FROM smfile_large w LEFT JOIN sitemap_files_large s USING (root_url, file_url)",
)
def deep_indexes(c):
    return S.expand_indexes(parsed_large(c)).drop("over_limit").withColumn("visit_key", F.array_join(F.col("visit_key").cast("array<string>"), "."))


@query("I2_large_files", "SELECT root_url, file_url, pos, loc, lastmod, copy FROM smentry_large")
def large_files(c):
    return S.file_entries(parsed_large(c)).select("root_url", "file_url", "pos", "loc", "lastmod", "copy")


@query("C12_merged_entries", "SELECT root_url, loc, file_url, lastmod FROM smmerged")
def merged(c):
    return S.merged_entries(parsed(c)).select("root_url", "loc", "file_url", "lastmod")


@query("C4_sitemap_membership", "SELECT page_id, sitemap_present, matched_loc, sitemap_file FROM member")
def membership(c):
    p = parsed(c)
    return S.membership(c.table("pages"), S.merged_entries(p), p).drop("sitemap_alternates")


@query(
    "C5_sitemap_hreflang",
    "SELECT m.page_id, a.k AS pos, a.hreflang, a.href FROM member m JOIN smalt a ON a.root_url = m.root_url AND a.loc = m.matched_loc",
)
def sitemap_hreflang(c):
    p = parsed(c)
    return S.membership(c.table("pages"), S.merged_entries(p), p).select(
        "page_id", F.posexplode("sitemap_alternates").alias("pos", "a")
    ).select("page_id", "pos", "a.hreflang", "a.href")


@query(
    "C11_sitemap_lists_robots_blocks",
    "SELECT page_id, matched_loc, robots_blocked_by FROM member JOIN rblock USING (page_id) WHERE sitemap_present AND robots_blocked",
)
def listed_but_blocked(c):
    p = parsed(c)
    listed = S.membership(c.table("pages"), S.merged_entries(p), p).filter("sitemap_present")
    blocked = R.page_blocks(R.page_verdicts(c.table("pages"), robots(c))).filter("robots_blocked")
    return listed.join(blocked, "page_id").select("page_id", "matched_loc", "robots_blocked_by")


@query(
    "F4_sitemap_entry_cap",
    "SELECT root_url, count(*) AS total, least(count(*), 50000) AS kept, count(*) > 50000 AS truncated FROM smmerged GROUP BY root_url",
)
def entry_cap(c):
    return S.cap_entries(S.merged_entries(parsed(c)), 50_000)


url_chain("s", "rline", "value")
CTES["smcand"] = """SELECT origin, url, source, ord FROM (SELECT *, row_number() OVER (PARTITION BY origin, url ORDER BY ord) AS rn FROM (
 SELECT origin, s_href AS url, 'robots' AS source, line_number AS ord FROM s__rline WHERE lower(name) = 'sitemap' AND value <> '' AND s_scheme IN ('http','https')
 UNION ALL SELECT origin, origin || '/sitemap.xml', 'common-path', 1000000 FROM origins UNION ALL SELECT origin, origin || '/sitemap_index.xml', 'common-path', 1000001 FROM origins) a) b WHERE rn = 1"""


@query("G4_sitemap_candidates", "SELECT origin, url, source FROM smcand")
def sitemap_candidates(c):
    return S.candidates(c.table("origins"), R.robots_sitemaps(R.robots_lines(robots(c)))).drop("at")


@query(
    "D12_first_wins",
    "SELECT 'candidate' AS what, origin AS owner, url AS item, source AS kept FROM smcand UNION ALL SELECT 'location', root_url, loc, file_url FROM smmerged",
)
def first_wins(c):
    cand = S.candidates(c.table("origins"), R.robots_sitemaps(R.robots_lines(robots(c))))
    one = cand.select(F.lit("candidate").alias("what"), F.col("origin").alias("owner"), F.col("url").alias("item"), F.col("source").alias("kept"))
    two = S.merged_entries(parsed(c)).select(F.lit("location").alias("what"), F.col("root_url").alias("owner"), F.col("loc").alias("item"), F.col("file_url").alias("kept"))
    return one.unionByName(two)
