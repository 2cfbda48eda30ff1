"""Queries over fetch logs, URL functions and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity import duck as D
from parity.duck import SPACE, comparable, grouping, http, q, slug, squeeze, trim, url_chain
from parity.registry import CTES, query
from sitelens.functions import headers as HD
from sitelens.functions import html as H
from sitelens.functions import urls as U
from sitelens.functions.expr import slug as slug_column
from sitelens.operators import compare as X
from sitelens.operators import fetchlog as N
from sitelens.operators import hreflang as HL

# -- fetch log ----------------------------------------------------------------
url_chain("rq", "fetches", "requested_url")
url_chain("lo", "rq__fetches", "location", "final_url")
MEDIA = "lower(trim(split_part(coalesce(content_type,''), ';', 1)))"
CTES["fclass"] = f"""SELECT page_id, truncated AS body_truncated, CASE WHEN rq_href IS NULL THEN 'invalid-url' WHEN NOT ({http('rq')}) THEN 'unsupported-scheme' WHEN logged_error IS NOT NULL THEN logged_error
  WHEN status IN (301,302,303,307,308) AND hop_count >= 10 THEN 'redirect-limit' WHEN status IN (301,302,303,307,308) AND location IS NULL THEN 'network-error' WHEN status IN (301,302,303,307,308) AND lo_href IS NULL THEN 'invalid-url'
  WHEN expect_mime IS NOT NULL AND NOT ({MEDIA} = expect_mime OR starts_with({MEDIA}, expect_mime || '+')) THEN 'mime-mismatch' END AS error_code FROM lo__rq__fetches"""


@query("A2_fetch_classification", "SELECT page_id, error_code, body_truncated FROM fclass")
def fetch_classification(c):
    return N.classify(c.table("fetches")).select("page_id", "error_code", "body_truncated")


CTES["edge"] = """SELECT from_url, to_url, observed_at AS since, lead(observed_at) OVER (PARTITION BY from_url ORDER BY observed_at) AS until
 FROM (SELECT from_url, observed_at, min(to_url) AS to_url FROM hop_log GROUP BY ALL) t"""
CTES["timed_chain"] = """SELECT request_id, requested_at AS asked, requested_url AS cur, 0 AS n, [requested_url] AS seen, false AS looped FROM hop_requests
 UNION ALL /*recursive*/ SELECT c.request_id, c.asked, e.to_url, c.n + 1, list_append(c.seen, e.to_url), list_contains(c.seen, e.to_url) FROM timed_chain c JOIN edge e
 ON e.from_url = c.cur AND (c.asked IS NULL OR e.since <= c.asked) AND (e.until IS NULL OR e.until > c.asked) WHERE NOT c.looped"""
CTES["only_edge"] = "SELECT from_url, min(to_url) AS to_url FROM fetch_hops GROUP BY from_url"
CTES["chain"] = """SELECT page_id AS request_id, url AS cur, 0 AS n, [url] AS seen, false AS looped FROM pages
 UNION ALL /*recursive*/ SELECT c.request_id, e.to_url, c.n + 1, list_append(c.seen, e.to_url), list_contains(c.seen, e.to_url)
 FROM chain c JOIN only_edge e ON e.from_url = c.cur WHERE NOT c.looped"""
CHAINS = "SELECT request_id, cur AS final_url, n AS hop_count, array_to_string(seen[2:], '|') AS hops, looped FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n DESC) AS rn FROM {}) x WHERE rn = 1"


def _chains(requests, hops):
    out = N.resolve_chains(requests, hops)
    return out.select("request_id", "final_url", "hop_count", F.array_join("hop_urls", "|").alias("hops"), "looped")


@query("C13_redirect_chains", CHAINS.format("chain"))
def redirect_chains(c):
    return _chains(c.table("pages").select(F.col("page_id").alias("request_id"), F.col("url").alias("requested_url")), c.table("fetch_hops"))


@query("C13_chains_as_of", CHAINS.format("timed_chain"))
def chains_as_of(c):
    return _chains(c.table("hop_requests"), c.table("hop_log"))


AT = 1700000000
CTES["navlog"] = f"SELECT page_id % 50 AS tab_id, requested_url, final_url, status_code, make_timestamp(({AT} + page_id * 10) * 1000000) AS observed_at FROM navigations WHERE page_id % 50 < 40"


@query(
    "C14_latest_navigation",
    f"""SELECT p.page_id AS request_id, p.page_id % 50 AS tab_id, CASE WHEN n.tab_id IS NULL THEN CASE WHEN p.page_id % 50 < 45 THEN 'navigation-completed-before-attach' ELSE 'listener-not-attached' END
   WHEN n.requested_url <> p.url AND n.final_url <> p.url THEN 'navigation-completed-before-attach' END AS reason, CASE WHEN n.requested_url = p.url OR n.final_url = p.url THEN n.final_url END AS final_url
  FROM pages p ASOF LEFT JOIN navlog n ON n.tab_id = p.page_id % 50 AND n.observed_at <= make_timestamp(({AT} + p.page_id * 10 + 5) * 1000000)""",
)
def latest_navigation(c):
    tab = F.col("page_id") % 50
    requests = c.table("pages").select(
        F.col("page_id").alias("request_id"),
        tab.alias("tab_id"),
        F.col("url").alias("requested_url"),
        F.timestamp_seconds(F.lit(AT) + F.col("page_id") * 10 + 5).alias("audit_time"),
    )
    nav = c.table("navigations").filter(tab < 40).select(
        tab.alias("tab_id"), "requested_url", "final_url", "status_code",
        F.timestamp_seconds(F.lit(AT) + F.col("page_id") * 10).alias("observed_at"),
    )
    watched = c.table("pages").select(tab.alias("tab_id")).distinct().filter("tab_id < 45")
    return N.latest_navigation(requests, nav, watched).select("request_id", "tab_id", "reason", "final_url")


@query(
    "B19_header_merge",
    "SELECT page_id, string_agg(name || '=' || v, '|' ORDER BY name) AS headers FROM (SELECT page_id, lower(name) AS name, string_agg(left(value, 2000), ', ' ORDER BY pos) AS v FROM response_headers WHERE lower(name) IN ('cache-control','content-type','link','location','refresh','vary','x-robots-tag') GROUP BY ALL) x GROUP BY page_id",
)
def header_merge(c):
    lists = c.table("response_headers").groupBy("page_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "value"))), lambda h: F.struct(h["name"], h["value"])).alias("h")
    )
    merged = HD.merge_headers(F.transform("h", lambda h: F.struct(h["name"].alias("name"), h["value"].alias("value"))), 2000)
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return lists.select("page_id", merged.alias("m")).select("page_id", F.array_join(entries, "|").alias("headers"))


# -- URL functions ----------------------------------------------------------------
@query("H1_url_parse", "SELECT page_id, u_href AS href, u_scheme AS scheme, u_host AS host, u_origin AS origin, u_path AS path, u_query AS query, u_frag AS fragment FROM u__pages")
def url_parse(c):
    return c.table("pages").select("page_id", U.parse_url(F.col("url")).alias("u")).select("page_id", "u.*")


#: Another character put into the first label of each page's host, by page_id.
ODD_LETTERS = "üéłя"
#: A page's address: beyond 32 bits for every eleventh page.
ADDRESS = "(page_id * 2654435761 % 4294967296 + CASE WHEN page_id % 11 = 0 THEN 4294967296 ELSE 0 END)"


# The expected name writes one inserted character by arithmetic: three digits, or four past 26.
@query(
    "H1_hosts",
    f"""WITH l AS (SELECT page_id, {ADDRESS} AS n, regexp_extract(url, '://([a-z0-9]+)', 1) AS label, ascii(substr('{ODD_LETTERS}', (page_id % 4)::INT + 1, 1)) AS code FROM pages),
d AS (SELECT *, (code - 128) * (length(label) + 1) + page_id % (length(label) + 1) AS q FROM l),
q AS (SELECT *, (q - 1) // 35 AS q1, ((q - 1) // 35 - 1) // 35 AS q2, 'abcdefghijklmnopqrstuvwxyz0123456789' AS ds FROM d)
SELECT page_id,
 'xn--' || label || '-' || substr(ds, (2 + (q - 1) % 35)::INT, 1)
 || CASE WHEN q1 < 1 THEN 'a' ELSE substr(ds, (2 + (q1 - 1) % 35)::INT, 1)
    || CASE WHEN q2 < 26 THEN substr(ds, (q2 + 1)::INT, 1) ELSE substr(ds, (27 + (q2 - 26) % 10)::INT, 1) || substr(ds, ((q2 - 26) // 10 + 1)::INT, 1) END END
 || '.example' AS name,
 CASE WHEN n < 4294967296 THEN concat_ws('.', n // 16777216, n // 65536 % 256, n // 256 % 256, n % 256) END AS address
FROM q""",
)
def hosts(c):
    label = F.regexp_extract("url", "://([a-z0-9]+)", 1)
    place = (F.col("page_id") % (F.length(label) + 1)).cast("int")
    letter = F.substr(F.lit(ODD_LETTERS), (F.col("page_id") % 4).cast("int") + 1, F.lit(1))
    odd = F.concat(F.substr(label, F.lit(1), place), letter, F.substr(label, place + 1))
    n, kind = F.expr(ADDRESS.replace("4294967296", "4294967296L")), F.col("page_id") % 5
    first, rest = F.floor(n / 2**24).cast("string"), (n % 2**24).cast("long")
    spelled = (
        F.when((kind == 0) | (n >= 2**32), n.cast("string"))
        .when(kind == 1, F.concat(F.lit("0x"), F.hex(n)))
        .when(kind == 2, F.concat(F.lit("0"), F.conv(n.cast("string"), 10, 8)))
        .when(kind == 3, F.concat(first, F.lit("."), rest.cast("string")))
        .otherwise(F.concat(first, F.lit(".0x"), F.hex(F.floor(rest / 2**16)), F.lit("."), (rest % 2**16).cast("string"), F.lit(".")))
    )
    return c.table("pages").select(
        "page_id",
        U.parse_url(F.concat(F.lit("http://"), F.upper(odd), F.lit(".example/")))["host"].alias("name"),
        U.parse_url(F.concat(F.lit("http://"), spelled, F.lit("/")))["host"].alias("address"),
    )


@query("H2_comparable_url", f"SELECT page_id, pos, {comparable('abs')} AS comparable FROM anchor")
def comparable_url(c):
    from sitelens.operators.facts import page_links

    return page_links(c.table("audit_pages")).select("page_id", "pos", U.comparable_url(F.col("absolute")).alias("comparable"))


@query("H3_grouping_url", f"SELECT page_id, {grouping('u', 'url')} AS grouping FROM u__pages")
def grouping_url(c):
    return c.table("pages").select("page_id", U.grouping_url(F.col("url")).alias("grouping"))


@query("H4_sitemap_url", f"SELECT page_id, CASE WHEN {http('rq')} THEN rq_href END AS normal FROM rq__fetches")
def sitemap_url(c):
    return c.table("fetches").select("page_id", U.sitemap_url(F.col("requested_url")).alias("normal"))


@query("H5_slash_variants", "SELECT page_id, array_to_string(vs, '|') AS variants FROM pagevar")
def slash_variants(c):
    return c.table("pages").select("page_id", F.array_join(U.slash_variants(F.col("url")), "|").alias("variants"))


HEAD = "regexp_extract(u_href, '^([^:]+://[^/?#]*)', 1)"
_slash = "u_path LIKE '%/'"
CTES["uvar"] = f"""SELECT page_id, url, kind, label, v, pos FROM (SELECT page_id, url, u_href, u_scheme, u_host, u_path, u_query, u_frag,
  unnest([0,1,2,3,4,5,6,7,8]) AS pos, unnest(['base','scheme','www','trailing-slash','case','index-filename','index-filename','index-filename','index-filename']) AS kind,
  unnest(['Base URL', CASE WHEN u_scheme = 'https' THEN 'HTTP scheme' ELSE 'HTTPS scheme' END, CASE WHEN u_host LIKE 'www.%' THEN 'Non-www host' ELSE 'WWW host' END, CASE WHEN {_slash} THEN 'Without trailing slash' ELSE 'With trailing slash' END,
   'Uppercase host/path', 'Index file index.html','Index file index.php','Index file index.htm','Index file default.aspx']) AS label,
  unnest([u_href, concat(CASE WHEN u_scheme = 'https' THEN 'http' ELSE 'https' END, substring(u_href, length(u_scheme)+1)), CASE WHEN u_host LIKE 'www.%' THEN replace(u_href,'://www.','://') ELSE replace(u_href,'://','://www.') END,
   CASE WHEN {_slash} THEN CASE WHEN length(u_path) > 1 THEN concat({HEAD}, regexp_replace(u_path,'/$',''), u_query, u_frag) END ELSE concat({HEAD}, u_path, '/', u_query, u_frag) END,
   concat({HEAD}, upper(u_path), u_query, u_frag), {', '.join(f"CASE WHEN NOT regexp_matches(lower(u_path), '/(index[.]html|index[.]php|index[.]htm|default[.]aspx)$') THEN concat({HEAD}, u_path, CASE WHEN {_slash} THEN '' ELSE '/' END, '{n}', u_query, u_frag) END" for n in U.INDEX_FILENAMES)}]) AS v FROM u__pages) x WHERE v IS NOT NULL"""
CTES["uvard"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, v ORDER BY pos) AS rn FROM uvar) x WHERE rn = 1"


@query("H6_url_variants", "SELECT url AS base_url, kind, label, v AS url FROM uvard")
def variants(c):
    return X.variant_targets(c.table("pages").select("url")).drop("cap_hit")


@query(
    "F3_capped_targets",
    """SELECT 'variant' AS what, url AS owner, v AS item, n > 5 AS cap_hit FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY v) AS r, count(*) OVER (PARTITION BY page_id) AS n FROM uvard) x WHERE r <= 5
 UNION ALL SELECT 'cluster', CAST(page_id AS VARCHAR), target, n > 1 FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r, count(*) OVER (PARTITION BY page_id) AS n FROM cltarget) y WHERE r <= 1""",
)
def capped_targets(c):
    """Top-k work lists: 5 variants per URL, 1 hreflang target per page."""
    one = X.variant_targets(c.table("pages").select("url"), 5).select(
        F.lit("variant").alias("what"), F.col("base_url").alias("owner"), F.col("url").alias("item"), "cap_hit"
    )
    two = HL.first_targets(_targets(c), 1).select(
        F.lit("cluster").alias("what"), F.col("cluster_id").cast("string").alias("owner"), F.col("target").alias("item"), "cap_hit"
    )
    return one.unionByName(two)


def _targets(c):
    html = HL.html_alternates(c.facts).select(
        F.col("page_id").alias("cluster_id"), "pos", "hreflang", F.coalesce("absolute", "href").alias("href")
    )
    return HL.cluster_targets(html)


CTES["clraw"] = "SELECT page_id, i AS pos, lower(trim(hreflang)) AS hreflang, trim(coalesce(abs_href, href)) AS target_href FROM rel WHERE rel = 'alternate' AND trim(coalesce(abs_href, href)) <> ''"
url_chain("t", "clraw", "target_href")
CTES["cltarget"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target ORDER BY pos) AS rn FROM (SELECT page_id, pos, hreflang, target_href AS requested_url, {grouping('t', 'target_href')} AS target FROM t__clraw WHERE t_href IS NOT NULL) a) b WHERE rn = 1"


@query(
    "H7_probe_url",
    f"SELECT page_id, u_origin || '/missing-page-probe-' || left(sha256(url), 16) AS probe FROM u__pages WHERE {http('u')}",
)
def probe(c):
    return c.table("pages").select("page_id", U.probe_url(F.col("url")).alias("probe"))


url_chain("q", "capwide", "probe_url")
url_chain("w", "q__capwide", "audited_url")
CTES["capwide"] = "SELECT a.pair_id, a.requested_url AS audited_url, p.requested_url AS probe_url FROM captures a JOIN captures p USING (pair_id) WHERE a.role = 'audited' AND p.role = 'probe'"


@query("H7_probe_check", "SELECT pair_id, CASE WHEN q_href IS NULL OR w_href IS NULL THEN 'invalid-url' WHEN q_origin <> w_origin THEN 'cross-origin' END AS problem FROM w__q__capwide")
def probe_check(c):
    t = c.table("captures")
    a = t.filter("role = 'audited'").select("pair_id", F.col("requested_url").alias("a"))
    p = t.filter("role = 'probe'").select("pair_id", F.col("requested_url").alias("p"))
    return a.join(p, "pair_id").select("pair_id", U.probe_check(F.col("a"), F.col("p")).alias("problem"))


@query(
    "B14_url_eligibility",
    f"""SELECT page_id, pos, coalesce({http('abs')} AND abs_host <> '', false) AS eligible, CASE WHEN abs_href IS NULL THEN 'The URL is not readable.' WHEN NOT ({http('abs')}) THEN 'The scheme “' || abs_scheme || ':” is out of scope; only http and https are audited.' END AS reason
  FROM (SELECT * FROM anchor WHERE abs_href IS NOT NULL) a""",
)
def eligibility(c):
    from sitelens.operators.facts import page_links

    links = page_links(c.table("audit_pages")).filter("absolute IS NOT NULL")
    return links.select("page_id", "pos", U.url_eligibility(F.col("absolute")).alias("e")).select("page_id", "pos", "e.*")


@query("H8_robots_tokens", "SELECT page_id, pos, array_to_string(list_filter(string_split_regex(lower(content), '[,;\\s]+'), lambda t: t <> ''), '|') AS tokens FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, content FROM meta WHERE name IN ('robots','googlebot')) m")
def robots_tokens(c):
    from sitelens.operators.facts import page_structure

    metas = page_structure(c.table("audit_pages")).select(
        "page_id", F.posexplode(F.filter("_metas", lambda m: m["name"].isin("robots", "googlebot"))).alias("i", "m")
    )
    return metas.select("page_id", (F.col("i") + 1).alias("pos"), F.array_join(HD.directive_tokens(F.col("m.content")), "|").alias("tokens"))


@query(
    "H11_media_type",
    f"SELECT page_id, CASE WHEN {MEDIA} = '' THEN NULL ELSE {MEDIA} = 'text/html' OR {MEDIA} LIKE 'text/html+%' END AS is_html, {MEDIA} = 'text/html' OR {MEDIA} LIKE 'text/html+%' AS matches FROM fetches",
)
def media_type(c):
    ct = F.col("content_type")
    return c.table("fetches").select("page_id", HD.is_html_type(ct).alias("is_html"), HD.mime_matches(ct, F.lit("text/html")).alias("matches"))


@query("H12_status_predicates", "SELECT page_id, status IN (301,302,303,307,308) AS redirect, status BETWEEN 200 AND 299 AS success FROM fetches")
def status_predicates(c):
    return c.table("fetches").select("page_id", HD.is_redirect(F.col("status")).alias("redirect"), HD.is_success(F.col("status")).alias("success"))


CTES["vlink"] = """SELECT *, regexp_extract(list_filter(list_transform(string_split(link, ','), lambda s: trim(s)), lambda s: regexp_matches(s, '(?i)rel="?canonical"?') AND regexp_matches(s, '^<[^>]+>'))[1], '^<([^>]+)>', 1) AS target FROM variant_results"""
url_chain("k", "vlink", "target")
url_chain("fu", "k__vlink", "final_url")
CTES["vcanon"] = "SELECT *, coalesce(k_href, target) AS canonical FROM fu__k__vlink"


@query("H13_link_canonical", "SELECT page_id, kind, canonical FROM vcanon")
def link_canonical(c):
    return c.table("variant_results").select("page_id", "kind", HD.canonical_from_link(F.col("link")).alias("canonical"))


# -- text functions ------------------------------------------------------------------
def plain(expr: str) -> str:
    stripped = f"regexp_replace({expr}, {q(r'(?is)<(?:script|style)(?:\s[^>]*)?>.*?</(?:script|style)>')}, ' ', 'g')"
    return squeeze(f"regexp_replace({stripped}, '<[^>]+>', ' ', 'g')")


FNV = "lpad(lower(to_hex(list_reduce([2166136261::BIGINT] || list_transform(string_split({0}, ''), lambda x: unicode(x)::BIGINT), lambda h, x: (xor(h, x) * 16777619) % 4294967296))), 8, '0')"
CTES["ptext"] = f"SELECT page_id, {plain('html')} AS text FROM pages"


@query("H14_plain_text", "SELECT page_id, length(text) AS chars, md5(text) AS digest FROM ptext")
def plain_text(c):
    return c.table("pages").select("page_id", H.plain_text(F.col("html")).alias("t")).select("page_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query("H15_fnv_hash", f"SELECT page_id, {FNV.format('url')} AS hash FROM pages")
def fnv(c):
    return c.table("pages").select("page_id", H.fnv1a(F.col("url")).alias("hash"))


@query("H16_tokens", "SELECT page_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS tokens, md5(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))), ' ')) AS digest FROM ptext")
def tokens(c):
    t = H.similarity_tokens(H.plain_text(F.col("html")))
    return c.table("pages").select("page_id", F.array_sort(t).alias("t")).select("page_id", F.size("t").alias("tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


ERR = r"(?i)(?:^|[^A-Za-z0-9_])(?:404|410|not[\s-]?found|page[\s-]?not[\s-]?found|error|does(?:n't| not) exist|no[\s-]?longer[\s-]?available)(?:$|[^A-Za-z0-9_])"
CTES["cap"] = f"""SELECT *, nullif({squeeze("regexp_extract(body, '(?is)<title[^>]*>([^<]*)</title>', 1)")}, '') AS title, {plain('body')} AS text FROM captures"""


@query("H17_titles", f"SELECT pair_id, role, title, coalesce(regexp_matches(title, {q(ERR)}), false) AS error_like FROM cap")
def title_functions(c):
    t = H.title_text(F.col("body"))
    return c.table("captures").select("pair_id", "role", t.alias("title")).withColumn("error_like", H.looks_like_error_title(F.col("title")))


CTES["capx"] = "SELECT *, CASE WHEN text <> '' THEN list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) END AS toks FROM cap WHERE fetch_error IS NULL"
CTES["pair"] = """SELECT x.*, w.w_origin AS origin, CASE WHEN ptok IS NULL OR atok IS NULL THEN 0 WHEN len(ptok) = 0 AND len(atok) = 0 THEN 1 WHEN len(ptok) = 0 OR len(atok) = 0 THEN 0
   ELSE len(list_intersect(ptok, atok)) / (len(ptok) + len(atok) - len(list_intersect(ptok, atok))) END AS sim, CASE WHEN abytes > 0 THEN pbytes / abytes END AS ratio FROM
  (SELECT a.pair_id, p.requested_url AS pu, p.final_url AS pf, p.status AS pstatus, p.title AS ptitle, p.text AS ptext, a.text AS atext, p.body_bytes AS pbytes, a.body_bytes AS abytes, p.toks AS ptok, a.toks AS atok FROM capx a JOIN capx p USING (pair_id) WHERE a.role = 'audited' AND p.role = 'probe') x
  JOIN w__q__capwide w USING (pair_id) WHERE w.q_origin = w.w_origin"""


@query("H18_length_ratio", "SELECT pair_id, round(ratio, 6) AS ratio FROM pair")
def length_ratio(c):
    r = F.col("probe.body_bytes") / F.col("audited.body_bytes")
    return X.soft404_pairs(c.table("captures")).select("pair_id", F.round(F.when(F.col("audited.body_bytes") > 0, r), 6).alias("ratio"))


@query("G2_token_jaccard", "SELECT pair_id, round(sim, 6) AS similarity FROM pair")
def token_jaccard(c):
    p, a = F.col("probe.tokens"), F.col("audited.tokens")
    sim = F.when(p.isNotNull() & a.isNotNull(), H.jaccard(p, a)).otherwise(0.0)
    return X.soft404_pairs(c.table("captures")).select("pair_id", F.round(sim, 6).alias("similarity"))


@query("C9_soft404_pairs", "SELECT pair_id, origin, pstatus AS probe_status, ptitle AS probe_title FROM pair")
def soft404_pairs(c):
    return X.soft404_pairs(c.table("captures")).select("pair_id", "origin", F.col("probe.status").alias("probe_status"), F.col("probe.title").alias("probe_title"))


@query(
    "J21_soft404_observations",
    f"""SELECT pair_id, unnest(list_filter([CASE WHEN ptext = atext AND ptext <> '' AND pbytes > 0 THEN 'identical-body-hash' END, CASE WHEN sim >= 0.85 THEN 'similar-content' END, CASE WHEN ratio BETWEEN 0.8 AND 1.2 AND sim >= 0.6 THEN 'spa-fallback' END,
  CASE WHEN pf = origin || '/' AND pu <> origin || '/' THEN 'redirect-to-home' END, CASE WHEN regexp_matches(ptitle, {q(ERR)}) THEN 'error-template-title' END], lambda k: k IS NOT NULL)) AS kind FROM pair WHERE pstatus BETWEEN 200 AND 299""",
)
def soft404(c):
    return X.soft404_observations(X.soft404_pairs(c.table("captures"))).select("pair_id", "kind")


@query("H20_relative_href", "SELECT page_id, pos, CASE WHEN trim(href) LIKE '//%' OR regexp_matches(trim(href), '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'absolute' ELSE 'relative' END AS kind, trim(href) <> '' AND NOT regexp_matches(trim(href), '(?i)^[a-z][a-z0-9+.-]*:') AND trim(href) NOT LIKE '//%' AS relative FROM anchor")
def relative_href(c):
    from sitelens.operators.facts import page_links

    h = F.col("href")
    return page_links(c.table("audit_pages")).select("page_id", "pos", U.href_kind(h).alias("kind"), U.is_relative_href(h).alias("relative"))


@query("H21_slug", f"SELECT page_id, {slug('url')} AS slug FROM pages")
def slugs(c):
    return c.table("pages").select("page_id", slug_column(F.col("url")).alias("slug"))


@query(
    "H26_user_agent_profile",
    """SELECT page_id, CASE WHEN ua_profile = 'custom' AND reason IS NULL THEN 'custom' WHEN ua_profile = 'googlebot-style' THEN ua_profile ELSE 'browser-default' END AS profile_id, CASE WHEN ua_profile = 'custom' AND reason IS NULL THEN u
   WHEN ua_profile = 'googlebot-style' THEN 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)' END AS user_agent, reason IS NOT NULL AS fell_back FROM (SELECT *, trim(coalesce(ua_text,'')) AS u, CASE WHEN ua_profile <> 'custom' THEN NULL WHEN trim(ua_text) = '' THEN 'empty'
   WHEN length(trim(ua_text)) > 256 THEN 'long' WHEN regexp_matches(ua_text, '[\\x00-\\x1f\\x7f]') THEN 'control' END AS reason FROM fetches) x""",
)
def user_agents(c):
    p = HD.user_agent_profile(F.col("ua_profile"), F.col("ua_text"))
    return c.table("fetches").select("page_id", p.alias("p")).select("page_id", "p.profile_id", "p.user_agent", F.col("p.fallback_reason").isNotNull().alias("fell_back"))


# -- variants ------------------------------------------------------------------------
CTES["vgroup"] = f"SELECT base_url, {grouping('fu', 'final_url')} AS target, count(*) AS members, list_sort(list_distinct(list(status))) AS statuses FROM vcanon WHERE final_url IS NOT NULL AND fetch_error IS NULL GROUP BY ALL"
url_chain("kk", "vcanon", "canonical")
CTES["vobs"] = f"""SELECT base_url, 'inconsistent-finals' AS kind, CAST(count(*) AS VARCHAR) AS subject FROM vgroup GROUP BY base_url HAVING count(*) > 1
 UNION ALL SELECT base_url, 'mixed-status', target FROM vgroup WHERE len(statuses) > 1
 UNION ALL SELECT base_url, 'canonical-mismatch', CAST(count(DISTINCT g) AS VARCHAR) FROM (SELECT base_url, {grouping('kk', 'canonical')} AS g FROM kk__vcanon WHERE canonical IS NOT NULL AND final_url IS NOT NULL AND fetch_error IS NULL) x GROUP BY base_url HAVING count(DISTINCT g) > 1"""


@query("D5_variant_groups", "SELECT base_url, target, members, array_to_string(statuses, '|') AS statuses FROM vgroup")
def variant_groups(c):
    return X.variant_groups(c.table("variant_results")).select("base_url", "target", "members", F.array_join(F.transform("statuses", lambda s: s.cast("string")), "|").alias("statuses"))


def _variant_kind(key: str, kind: str) -> None:
    query(key, f"SELECT base_url, subject FROM vobs WHERE kind = '{kind}'")(
        lambda c: X.variant_observations(c.table("variant_results")).filter(F.col("kind") == kind).select("base_url", "subject")
    )


_variant_kind("D6_inconsistent_finals", "inconsistent-finals")
_variant_kind("D7_mixed_status", "mixed-status")
_variant_kind("D8_canonical_mismatch", "canonical-mismatch")


@query("J22_variant_observations", "SELECT * FROM vobs")
def variant_observations(c):
    return X.variant_observations(c.table("variant_results"))


# -- renders ---------------------------------------------------------------------------
CTES["vis"] = f"SELECT page_id, role, length(t) AS n, {FNV.format('t')} AS hash FROM (SELECT page_id, role, {plain('html')} AS t FROM renders) x"


@query("I5_text_fingerprint", f"SELECT page_id, length(text) AS char_count, {FNV.format('text')} AS hash, left(text, 200) AS sample, false AS truncated FROM ptext")
def text_fingerprint(c):
    return X.visible_text(c.table("pages")).drop("url")


D.define_lexer("renders", "_r", "page_id, url, role")
_st = lambda f: f"CASE {f}.state WHEN 'absent' THEN '(absent)' WHEN 'empty' THEN '(empty)' WHEN 'malformed' THEN '(malformed: ' || hrefs || ')' WHEN 'duplicate' THEN '(duplicate ×' || {f}.n || ')' ELSE "
CTES["rdesc"] = f"""SELECT t.page_id, t.role, {_st('t').replace("'(malformed: ' || hrefs || ')'", "''")} t.text END AS title, {_st('d').replace("'(malformed: ' || hrefs || ')'", "''")} d.text END AS meta_description, {_st('c')} c.absolute END AS canonical,
  coalesce(nullif(concat_ws(' ', {', '.join(f"CASE WHEN h{i} > 0 THEN 'h{i}:' || h{i} END" for i in range(1, 7))}), ''), '(no headings)') AS headings,
  'total:' || l.total || ' internal:' || internal || ' external:' || external || ' other:' || other AS links, coalesce(j.s, '(absent)') AS json_ld, v.n || ' chars, hash ' || v.hash AS visible_text, l.total AS lt, v.n AS vn
  FROM f_title_r t JOIN f_description_r d USING (page_id, role) JOIN f_canonical_r c USING (page_id, role) JOIN f_headings_r h USING (page_id, role) JOIN f_links_r l USING (page_id, role) JOIN vis v USING (page_id, role)
  LEFT JOIN (SELECT page_id, role, 'count:' || count(*) || ' ok:' || count(*) FILTER (status = 'ok') || ' invalid:' || count(*) FILTER (status = 'invalid-json') || ' empty:' || count(*) FILTER (status = 'empty') || ' truncated:' || count(*) FILTER (status = 'truncated') AS s FROM jsonld_r GROUP BY ALL) j USING (page_id, role)"""
CTES["rdiff"] = "SELECT b.page_id, f.field, f.b AS baseline, f.e AS experiment, f.b IS DISTINCT FROM f.e AS changed, f.delta FROM rdesc b JOIN rdesc e USING (page_id), LATERAL (VALUES " + ", ".join(
    f"('{n}', b.{n}, e.{n}, {'e.lt - b.lt' if n == 'links' else 'e.vn - b.vn' if n == 'visible_text' else 'NULL'})" for n in X.DIFF_KINDS
) + ") f(field, b, e, delta) WHERE b.role = 'baseline' AND e.role = 'experiment'"


def _described(c):
    return c.once("described", lambda: X.describe_renders(c.table("renders")))


@query("H23_field_descriptions", "SELECT page_id, role, title, meta_description, canonical, headings, links, json_ld, visible_text FROM rdesc")
def field_descriptions(c):
    return _described(c).drop("links_total", "char_count")


@query("C10_render_diff", "SELECT page_id, field, baseline, experiment, changed FROM rdiff")
def render_diff(c):
    return X.render_diffs(_described(c)).drop("delta")


@query("J23_render_observations", "SELECT page_id, CASE field WHEN 'meta_description' THEN 'meta-description-changed' WHEN 'json_ld' THEN 'jsonld-changed' WHEN 'visible_text' THEN 'visible-text-changed' ELSE field || '-changed' END AS kind, delta FROM rdiff WHERE changed")
def render_observations(c):
    return X.render_observations(X.render_diffs(_described(c))).select("page_id", "kind", "delta")
