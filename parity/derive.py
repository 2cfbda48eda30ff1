"""Input tables derived from the driver's ``pages`` by SQL both engines run.

Each text below is used twice: as a Spark view and as a CTE of the DuckDB
query.  ``{gen(n)}``-style differences are resolved by the dialect helpers.
"""

from __future__ import annotations

from dataclasses import dataclass
from html.entities import html5


@dataclass(frozen=True)
class Dialect:
    name: str

    def text(self, expr: str) -> str:
        return f"CAST({expr} AS {'STRING' if self.name == 'spark' else 'VARCHAR'})"

    def numbers(self, count: str, alias: str = "i") -> str:
        """Lateral 1..count next to the row."""
        if self.name == "spark":
            return f"LATERAL VIEW explode(sequence(1, {count})) g AS {alias}"
        return f", LATERAL (SELECT unnest(range(1, {count} + 1)) AS {alias}) g"

    def concat_rows(self, expr: str, order: str) -> str:
        if self.name == "spark":
            return f"listagg({expr}, '') WITHIN GROUP (ORDER BY {order})"
        return f"string_agg({expr}, '' ORDER BY {order})"

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.name == "spark" else f"({a} // {b})"

    def time(self, seconds: str) -> str:
        if self.name == "spark":
            return f"timestamp_seconds(1700000000 + {seconds})"
        return f"make_timestamp((1700000000 + {seconds}) * 1000000)"


SPARK, DUCK = Dialect("spark"), Dialect("duck")
ORIGIN = "regexp_extract(url,'^(https?://[^/?#]+)',1)"


def audit_pages(d: Dialect) -> str:
    pid = d.text("page_id")
    return f"""
SELECT page_id, url, replace(replace(replace(CASE WHEN page_id % 29 = 6 THEN replace(html,'<html lang=','<html data-lang=') ELSE html END,'</head>', concat(
  CASE page_id % 19 WHEN 3 THEN '<base href="/base/dir/">' ELSE '' END,
  CASE page_id % 5 WHEN 1 THEN '<meta name="description" content="A summary of the page.">'
       WHEN 2 THEN '<meta name="description" content="">'
       WHEN 3 THEN '<meta name="description" content="one"><meta name="description" content="two">'
       WHEN 4 THEN '<META NAME=''Description'' CONTENT=''Single &quot;quoted&quot; ''>' ELSE '' END,
  CASE page_id % 6 WHEN 1 THEN '<meta name="robots" content="noindex">' WHEN 2 THEN '<meta name="robots" content="none">'
       WHEN 3 THEN '<meta name="robots" content="noindex"><meta name="googlebot" content="nofollow">'
       WHEN 4 THEN '<meta name="robots" content="max-snippet:10, index">'
       WHEN 5 THEN '<meta name="robots" content="">' ELSE '' END,
  CASE page_id % 8 WHEN 1 THEN concat('<link rel="canonical" href="', replace(url,'&','&amp;'), '">')
       WHEN 2 THEN concat('<link rel="canonical" href="/canon/', {pid}, '">')
       WHEN 3 THEN '<link rel="canonical" href="/a"><link rel="canonical" href="/b">'
       WHEN 4 THEN '<link rel="canonical" href="">'
       WHEN 5 THEN '<link rel="canonical" href="https://other.example.test/x">'
       WHEN 6 THEN '<link rel="canonical" href="javascript:void(0)">'
       WHEN 7 THEN '<link rel="canonical" href="http://[bad">' ELSE '' END,
  CASE page_id % 7 WHEN 1 THEN concat('<link rel="alternate" hreflang="en" href="', replace(url,'&','&amp;'), '"><link rel="alternate" hreflang="fr" href="https://fr.example.test/', {pid}, '/">')
       WHEN 2 THEN '<link rel="alternate" hreflang="en" href="https://en.example.test/a"><link rel="alternate" hreflang="EN" href="https://en.example.test/b">'
       WHEN 3 THEN '<link rel="alternate" hreflang="en-uk" href="https://uk.example.test/">'
       WHEN 4 THEN '<link rel="alternate" hreflang="xx-yy" href="https://xx.example.test/"><link rel="alternate" hreflang="de-zq" href="https://de.example.test/"><link rel="alternate" hreflang="x-default" href="https://de.example.test/">'
       WHEN 5 THEN '<link rel="alternate" hreflang="de" href="">'
       WHEN 6 THEN '<link rel="alternate" hreflang="es" href="/es/page"><link rel="alternate" hreflang="it" href="mailto:it@example.test"><link rel="alternate" hreflang="pt" href="http://[bad">' ELSE '' END,
  CASE page_id % 10 WHEN 1 THEN '<meta property="og:title" content=" Shared title "><meta property="OG:type" content="article"><meta name="twitter:card" content="summary">'
       WHEN 2 THEN '<meta name="viewport" content="width=device-width">' WHEN 3 THEN '<meta name="viewport" content="">' ELSE '' END,
  CASE page_id % 9
       WHEN 1 THEN '<script type="application/ld+json">{{"@context":"https://schema.org","@type":"Article","@id":"#a","author":{{"@type":"Person","name":"A"}}}}</script>'
       WHEN 2 THEN '<script type="application/ld+json">{{ not json</script>'
       WHEN 3 THEN '<script type="application/ld+json">{{"@type":"Article"}}</script>'
       WHEN 4 THEN '<script type="application/ld+json">{{"@context":"https://schema.org","@graph":[{{"@id":"#x","@type":"Thing"}},{{"@id":"#x","@type":"Thing"}},{{"name":"untyped"}}]}}</script>'
       WHEN 5 THEN '<script type="application/ld+json">"text"</script><script type="Application/LD+JSON">{{"@context":"","@type":"A"}}</script>'
       WHEN 6 THEN '<script type="application/ld+json">[{{"@context":"https://schema.org","@type":"Thing"}},5]</script>'
       WHEN 7 THEN '<script type="application/ld+json"> </script>'
       WHEN 8 THEN '<script type="application/ld+json">{{"@context":["https://schema.org",{{"x":"y"}}],"@type":["Article","News"],"@id":"#org","publisher":{{"@id":"#org"}},"parts":[{{"@type":"Part","@id":"#p"}},[{{"@id":"#p","name":"n"}}]]}}</script><script type="application/ld+json">{{"@type":"B"}} trailing</script>'
       ELSE CASE WHEN page_id % 27 = 9 THEN concat('<script type="application/ld+json">', repeat('{{"@context":"https://schema.org","@type":"T","a":[1,', 25), '{{"@id":"#z"}}', repeat(']}}', 25), '</script>') ELSE '' END END,
  CASE page_id % 11 WHEN 10 THEN '<title>Second title</title>' ELSE '' END,
  '</head>')),
  '<article>', concat('<article>',
  CASE page_id % 11 WHEN 9 THEN '<svg><title>Icon</title><a href="/svg">s</a></svg>' ELSE '' END,
  CASE page_id % 3 WHEN 1 THEN '<main><h2>Part <em>one</em></h2><h2 class="x">Part two</h2></main><!-- <h2>hidden</h2> -->' ELSE '' END)),
  '</article>', concat(
  CASE page_id % 4 WHEN 1 THEN '<img src="/a.png">' WHEN 2 THEN '<img src="/b.png" alt=""><img src="/c.png" data-alt="x">'
       WHEN 3 THEN '<img alt="Chart &amp; table" src=/d.png><a href="../up/./x?y=1#z"> Up <b>now</b></a><a href="//cdn.example.test/lib">CDN</a><a href="mailto:a@example.test">Mail</a><a name="n">none</a><a href="tel:1">t</a><a title="a > b href=no" HREF=''#frag''>f</a><a href="HTTP://Other.Example.test:80">o</a><a href="http://[bad">bad</a>'
       ELSE '' END, '</article>')) AS html
FROM pages""".replace("{{", "{").replace("}}", "}")


def origins(d: Dialect) -> str:
    return f"SELECT DISTINCT {ORIGIN} AS origin FROM pages"


def robots_files(d: Dialect) -> str:
    return """
SELECT origin, CASE length(origin) % 6 WHEN 0 THEN 404 ELSE 200 END AS status,
 CASE WHEN length(origin) % 6 = 3 THEN 'text/html; charset=utf-8' ELSE 'text/plain' END AS content_type,
 length(origin) % 13 = 5 AS truncated,
 CASE WHEN length(origin) % 17 = 4 THEN 'timeout' ELSE NULL END AS fetch_error,
 CASE length(origin) % 6 WHEN 1 THEN concat('User-agent: *', chr(10), 'Disallow: /en/', chr(10), 'Allow: /en/4', chr(10), 'Disallow: /fr', chr(10), 'Allow: /fr', chr(10), 'Sitemap: ', origin, '/sitemap.xml')
  WHEN 2 THEN concat('User-agent: Googlebot', chr(13), chr(10), 'User-agent: other', chr(10), 'Disallow: /fr/ # note', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow: /')
  WHEN 3 THEN '<!doctype html><html></html>' WHEN 4 THEN concat('User-agent: *', chr(10), 'Disallow:', chr(10), 'Sitemap:', chr(10), 'user-agent:')
  WHEN 5 THEN concat('# note', chr(10), 'Disallow: /tmp', chr(10), 'Crawl-delay: 5', chr(10), 'nonsense', chr(10), 'User-agent: *', chr(10), 'Disallow: /*.html$', chr(10), 'User-agent: google', chr(10), 'Allow: /', chr(10), 'Sitemap: ', origin, '/sitemap.xml#x', chr(10), 'Sitemap: notaurl') ELSE '' END AS body
FROM origins"""


# Leaves hold at most LEAF page ids, middle indexes at most MID, so a file stays
# small however many pages one origin has.
LEAF, MID = 1_000, 1_000_000


def sitemap_leaves(d: Dialect) -> str:
    loc = (
        "replace(CASE WHEN page_id % 4 = 2 AND NOT contains(url,'?') AND NOT contains(url,'#') "
        "THEN CASE WHEN url LIKE '%/' THEN substring(url,1,length(url)-1) ELSE concat(url,'/') END ELSE url END,'&','&amp;')"
    )
    entry = f"""concat('<url><loc> ', {loc}, '</loc>',
      CASE WHEN page_id % 2 = 0 THEN '<lastmod>2026-01-02</lastmod><changefreq>daily</changefreq>' ELSE '' END,
      CASE WHEN page_id % 5 = 0 THEN concat('<xhtml:link rel="alternate" hreflang="EN" href="https://en.example.test/b"/><xhtml:link rel="alternate" hreflang="fr" href="https://fr.example.test/', {d.text('page_id')}, '"/><xhtml:link rel="stylesheet" hreflang="de" href="https://de.example.test/"/>')
           WHEN page_id % 7 = 3 THEN '<xhtml:link hreflang="en-uk" href="https://uk.example.test"/><xhtml:link hreflang="en-uk" href="https://uk.example.test/2"/>' ELSE '' END,
      '</url>',
      CASE WHEN page_id % 23 = 5 THEN '<url><lastmod>2026-01-03</lastmod></url>' ELSE '' END,
      CASE WHEN page_id % 7 = 1 THEN concat('<url><loc>', {loc}, '</loc><lastmod>2025-05-05</lastmod></url>') ELSE '' END)"""
    return f"""
SELECT origin, leaf, concat(
  CASE WHEN length(origin) % 13 = 4 THEN '<!DOCTYPE urlset>' ELSE '' END,
  '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml">',
  CASE WHEN length(origin) % 13 = 6 THEN '<url><loc>https://x.example.test/&foo;</loc></url>' ELSE '' END,
  {d.concat_rows(entry, 'page_id')},
  CASE WHEN length(origin) % 7 = 3 THEN '' ELSE '</urlset>' END) AS body
FROM (SELECT page_id, url, {ORIGIN} AS origin, {d.div('page_id', LEAF)} AS leaf
      FROM pages WHERE page_id % 3 <> 0) t
GROUP BY origin, leaf"""


def sitemap_files(d: Dialect) -> str:
    leaf = d.text("leaf")
    mid = d.text(d.div("leaf", MID // LEAF))
    child = f"concat('<sitemap><loc>', origin, '/sitemap-', {leaf}, '.xml</loc></sitemap>')"
    mid_child = "concat('<sitemap><loc>', origin, '/sitemap-index-', mid, '.xml</loc></sitemap>')"
    return f"""
SELECT concat(origin,'/sitemap.xml') AS root_url, concat(origin,'/sitemap-',{leaf},'.xml') AS file_url,
       CASE WHEN length(origin) % 11 = 1 THEN 503 ELSE 200 END AS status, length(origin) % 11 = 2 AS truncated,
       CASE WHEN length(origin) % 11 = 3 THEN 'timeout' ELSE NULL END AS fetch_error, body
FROM sitemap_leaves
UNION ALL
SELECT concat(origin,'/sitemap.xml'), concat(origin,'/sitemap-index-',{mid},'.xml'), 200, false, NULL,
       concat('<?xml version="1.0"?><sitemapindex>', {d.concat_rows(child, 'leaf')}, '</sitemapindex>')
FROM sitemap_leaves GROUP BY origin, {mid}
UNION ALL
SELECT concat(origin,'/sitemap.xml'), concat(origin,'/sitemap.xml'), 200, false, NULL,
       CASE WHEN length(origin) % 17 = 12 THEN '  ' ELSE
       concat('<sitemapindex>', {d.concat_rows(mid_child, 'mid')}, '<sitemap><lastmod>x</lastmod></sitemap><sitemap><loc>',
              origin, '/sitemap-missing.xml</loc></sitemap><sitemap><loc>', origin, '/sitemap.xml</loc></sitemap></sitemapindex>') END
FROM (SELECT DISTINCT origin, {mid} AS mid FROM sitemap_leaves) m GROUP BY origin"""


def sitemap_files_large(d: Dialect) -> str:
    """A file that grows with the pages (about 600 KB of 250), and indexes of twelve levels with cycles."""
    big = f"concat('<url><loc>https://big.example.test/', {d.text('page_id')}, '/', {d.text('i')}, '?long=0123456789</loc></url>')"
    deep_root = f"concat('https://deep', {d.text('site')}, '.example.test/sitemap.xml')"
    deep = f"concat('https://deep', {d.text('site')}, '.example.test/level-', "
    return f"""
SELECT 'https://big.example.test/sitemap.xml' AS root_url, 'https://big.example.test/sitemap.xml' AS file_url, 200 AS status, false AS truncated, NULL AS fetch_error,
       concat('<urlset>', {d.concat_rows(big, 'page_id, i')}, '</urlset>') AS body
FROM pages {d.numbers('50')}
UNION ALL
SELECT {deep_root}, CASE WHEN i = 1 THEN {deep_root} ELSE {deep}{d.text('i - 1')}, '.xml') END, 200, false, NULL,
       CASE WHEN i = 13 THEN concat('<urlset><url><loc>', {deep_root}, '</loc></url></urlset>')
            ELSE concat('<sitemapindex><sitemap><loc>', {deep}{d.text('i')}), '.xml</loc></sitemap><sitemap><loc>',
                        CASE WHEN i = 6 THEN {deep}'2.xml') ELSE {deep_root} END, '</loc></sitemap></sitemapindex>') END
FROM (SELECT DISTINCT page_id % 7 AS site FROM pages) s {d.numbers('13')}"""


def sitemap_parts_large(d: Dialect) -> str:
    """The files of sitemap_files_large in ordered parts, as one text of them outgrows a row."""
    big = f"concat('<url><loc>https://big.example.test/', {d.text('page_id')}, '/', {d.text('i')}, '?long=0123456789</loc></url>')"
    at = "'https://big.example.test/sitemap.xml' AS root_url, 'https://big.example.test/sitemap.xml' AS file_url, 200 AS status, false AS truncated, NULL AS fetch_error"
    block = d.div("page_id", 256)
    return f"""
SELECT {at}, 1 AS section, {block} AS part, {d.concat_rows(big, 'page_id, i')} AS body FROM pages {d.numbers('50')} WHERE page_id IS NOT NULL GROUP BY {block}
UNION ALL SELECT {at}, 0, 0, '<urlset>'
UNION ALL SELECT {at}, 2, 0, '</urlset>'
UNION ALL SELECT root_url, file_url, status, truncated, fetch_error, 0, 0, body FROM sitemap_files_large WHERE root_url <> 'https://big.example.test/sitemap.xml'"""


def fetches(d: Dialect) -> str:
    pid = d.text("page_id")
    return f"""
SELECT page_id, CASE page_id % 31 WHEN 5 THEN 'not a url' WHEN 6 THEN 'ftp://files.example.test/f' ELSE url END AS requested_url,
 url AS final_url,
 CASE page_id % 10 WHEN 4 THEN 404 WHEN 5 THEN 410 WHEN 6 THEN 301 WHEN 7 THEN 301 WHEN 8 THEN 302 ELSE 200 END AS status,
 CASE page_id % 10 WHEN 6 THEN concat('/moved/', {pid}) WHEN 8 THEN 'http://[bad' ELSE NULL END AS location,
 page_id % 13 AS hop_count,
 CASE page_id % 9 WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/html; charset=utf-8' WHEN 3 THEN '' WHEN 4 THEN 'TEXT/HTML'
      WHEN 5 THEN NULL WHEN 6 THEN 'text/html+x' ELSE 'text/html' END AS content_type,
 CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE NULL END AS expect_mime,
 CASE page_id % 6 WHEN 1 THEN 'noindex' WHEN 2 THEN 'unavailable_after: x, NOFOLLOW' WHEN 3 THEN ' ' WHEN 4 THEN 'all' ELSE NULL END AS x_robots_tag,
 length(html) AS body_bytes, page_id % 15 = 4 AS truncated,
 CASE page_id % 29 WHEN 7 THEN 'timeout' WHEN 8 THEN 'aborted' WHEN 9 THEN 'redirect-opaque' ELSE NULL END AS logged_error,
 CASE page_id % 5 WHEN 1 THEN 'googlebot-style' WHEN 2 THEN 'custom' WHEN 3 THEN 'custom' WHEN 4 THEN 'custom' ELSE 'browser-default' END AS ua_profile,
 CASE page_id % 5 WHEN 2 THEN ' Bot/1.0 ' WHEN 3 THEN concat('Bad', chr(10), 'Bot') WHEN 4 THEN CASE WHEN page_id % 2 = 0 THEN '  ' ELSE repeat('u', 300) END ELSE NULL END AS ua_text
FROM pages"""


def response_headers(d: Dialect) -> str:
    pid = d.text("page_id")
    return f"""
SELECT page_id, 1 AS pos, 'Content-Type' AS name, 'text/html' AS value FROM pages
UNION ALL SELECT page_id, 2, 'X-Robots-Tag', CASE WHEN page_id % 2 = 0 THEN 'noindex' ELSE 'all' END FROM pages WHERE page_id % 3 = 1
UNION ALL SELECT page_id, 3, 'x-robots-tag', 'nofollow' FROM pages WHERE page_id % 6 = 1
UNION ALL SELECT page_id, 4, 'Set-Cookie', 'a=b' FROM pages
UNION ALL SELECT page_id, 5, 'LINK', concat('<https://c.example.test/', {pid}, '>; rel="canonical"') FROM pages WHERE page_id % 4 = 1
UNION ALL SELECT page_id, 6, 'Vary', repeat('v', 2500) FROM pages WHERE page_id % 7 = 1"""


def navigations(d: Dialect) -> str:
    """Observed navigations; one page in eleven was not observed."""
    pid = d.text("page_id")
    return f"""
SELECT page_id, url AS requested_url,
 CASE page_id % 8 WHEN 1 THEN url WHEN 2 THEN concat({ORIGIN}, '/canon/', {pid}, '#frag') ELSE concat({ORIGIN}, '/final/', {pid}) END AS final_url,
 CASE page_id % 10 WHEN 4 THEN 404 ELSE 200 END AS status_code,
 CASE page_id % 9 WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/html; charset=utf-8' WHEN 3 THEN '' WHEN 5 THEN NULL ELSE 'text/html' END AS content_type,
 CASE page_id % 4 WHEN 1 THEN 'noindex' WHEN 2 THEN 'NOFOLLOW; max-snippet:1' WHEN 3 THEN ' ' ELSE NULL END AS x_robots_tag
FROM pages WHERE page_id % 11 <> 0"""


def fetch_hops(d: Dialect) -> str:
    pid = d.text("page_id")
    hop = f"concat({ORIGIN}, '/hop/', {pid}, '/', "
    return f"""
SELECT page_id, CAST(i AS INT) AS pos,
 CASE WHEN i = 1 THEN url ELSE {hop}{d.text('i - 1')}) END AS from_url,
 CASE WHEN i = page_id % 13 AND page_id % 17 = 3 THEN url ELSE {hop}{d.text('i')}) END AS to_url,
 CASE WHEN i % 2 = 0 THEN 302 ELSE 301 END AS status
FROM (SELECT page_id, url FROM pages WHERE page_id % 13 > 0) p {d.numbers('page_id % 13')}
UNION ALL
SELECT page_id, CAST(page_id % 13 + 1 AS INT), url, CASE WHEN page_id % 13 = 1 THEN url ELSE {hop}'1') END, 301
FROM pages WHERE page_id % 13 > 0 AND page_id % 17 = 3"""


def hop_log(d: Dialect) -> str:
    """Hops with the time they were seen: those of fetch_hops, chains of 200 hops, loops that only
    close later, and URLs that lead elsewhere from some time on."""
    pid = d.text("page_id")
    step = f"concat({ORIGIN}, '/long/', {pid}, '/', "
    return f"""
SELECT from_url, to_url, status, {d.time('page_id * 10')} AS observed_at FROM fetch_hops
UNION ALL
SELECT CASE WHEN i = 1 THEN concat(url, '#long') ELSE {step}{d.text('i - 1')}) END, {step}{d.text('i')}), 301, {d.time('page_id * 10 + i')}
FROM (SELECT page_id, url FROM pages WHERE page_id % 50 = 7) p {d.numbers('200')}
UNION ALL
SELECT {step}'150'), {step}'40'), 302, {d.time('page_id * 10 + 5000')} FROM pages WHERE page_id % 50 = 7
UNION ALL
SELECT url, concat({ORIGIN}, '/moved/', {pid}), 301, {d.time('page_id * 10 + 1000')} FROM pages WHERE page_id % 5 = 2
UNION ALL
SELECT concat({ORIGIN}, '/moved/', {pid}), CASE WHEN page_id % 10 = 2 THEN url ELSE concat(url, '#end') END, 302, {d.time('page_id * 10 + 1500')} FROM pages WHERE page_id % 5 = 2"""


def hop_requests(d: Dialect) -> str:
    """Three requests a page, before and after what changes; some without a time."""
    asked = d.time("page_id * 10 + (i - 1) * 1200 - 2")
    return f"""
SELECT page_id * 4 + i AS request_id, CASE WHEN page_id % 50 = 7 THEN concat(url, '#long') ELSE url END AS requested_url,
 CASE WHEN page_id % 4 = 3 AND i = 3 THEN NULL WHEN page_id % 50 = 7 AND i = 3 THEN {d.time('page_id * 10 + 9000')} ELSE {asked} END AS requested_at
FROM pages {d.numbers('3')}"""


def captures(d: Dialect) -> str:
    pid = d.text("page_id")
    return f"""
SELECT page_id AS pair_id, 'audited' AS role, url AS requested_url, url AS final_url, 200 AS status,
  CASE WHEN page_id % 37 = 5 THEN 'timeout' ELSE NULL END AS fetch_error, html AS body, length(html) AS body_bytes FROM pages
UNION ALL
SELECT page_id, 'probe', CASE WHEN page_id % 23 = 1 THEN 'https://elsewhere.example.test/p' ELSE concat({ORIGIN}, '/missing-page-probe-', {pid}) END,
  CASE WHEN page_id % 6 = 3 THEN concat({ORIGIN}, '/') ELSE concat({ORIGIN}, '/missing-page-probe-', {pid}) END,
  CASE WHEN page_id % 6 = 0 THEN 404 ELSE 200 END, CASE WHEN page_id % 19 = 2 THEN 'timeout' ELSE NULL END, body, length(body)
FROM (SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN html WHEN 1 THEN html
        WHEN 2 THEN '<html><head><title>Page not  found</title></head><body>Nothing here</body></html>'
        WHEN 3 THEN '<html><head><title>Home</title></head><body>Welcome home</body></html>'
        WHEN 4 THEN replace(html, ' the ', concat(' teh', {pid}, ' ')) ELSE '' END AS body FROM pages) p"""


def variant_results(d: Dialect) -> str:
    flip = "CASE WHEN url LIKE 'https:%' THEN concat('http:', substring(url,7)) ELSE concat('https:', substring(url,6)) END"
    www = "CASE WHEN url LIKE '%://www.%' THEN replace(url,'://www.','://') ELSE replace(url,'://','://www.') END"
    return f"""
SELECT url AS base_url, page_id, 'base' AS kind, url AS request_url, url AS final_url, 200 AS status, 'text/html' AS content_type,
  CASE page_id % 5 WHEN 1 THEN concat('<', url, '>; rel="canonical"') WHEN 2 THEN '</style.css>; rel=preload, <https://C.example.test/x/>; type="a"; rel=canonical' ELSE NULL END AS link, CAST(NULL AS VARCHAR(20)) AS fetch_error FROM pages
UNION ALL SELECT url, page_id, 'scheme', {flip}, CASE WHEN length({ORIGIN}) % 2 = 0 THEN {flip} ELSE url END, 200, 'text/html',
  CASE WHEN page_id % 10 = 1 THEN '<https://c.example.test/x>; rel=canonical' ELSE NULL END, NULL FROM pages
UNION ALL SELECT url, page_id, 'www', {www}, CASE WHEN length({ORIGIN}) % 3 = 0 THEN {www} ELSE url END, CASE WHEN page_id % 7 = 2 THEN 404 ELSE 200 END, 'text/html', NULL, NULL FROM pages
UNION ALL SELECT url, page_id, 'trailing-slash', concat(url,'/'), CASE WHEN page_id % 9 = 4 THEN NULL ELSE url END, CASE WHEN page_id % 9 = 4 THEN NULL ELSE 200 END, 'text/html', NULL,
  CASE WHEN page_id % 9 = 4 THEN 'timeout' ELSE NULL END FROM pages"""


def renders(d: Dialect) -> str:
    return """
SELECT page_id, 'baseline' AS role, url, html FROM audit_pages
UNION ALL
SELECT page_id, 'experiment', url, CASE
  WHEN page_id % 4 = 1 THEN replace(html,'<title>','<title>New ')
  WHEN page_id % 4 = 2 THEN replace(replace(html,'<h1>','<h3>'),'</h1>','</h3>')
  WHEN page_id % 4 = 3 THEN replace(replace(html,'<a href="/','<a data-x="/'),'rel="canonical"','rel="other"')
  WHEN page_id % 8 = 4 THEN replace(replace(html,'application/ld+json','text/plain'),'name="description"','name="desc"')
  ELSE html END FROM audit_pages"""


def nav_events(d: Dialect) -> str:
    """One tab per page; redirects, errors, unwatch, sub-frames, repeated headers."""
    pid = d.text("page_id")
    empty = (
        "CAST(array() AS array<struct<name:string,value:string>>)"
        if d.name == "spark"
        else "CAST([] AS STRUCT(name VARCHAR, value VARCHAR)[])"
    )

    def headers(*pairs: tuple[str, str]) -> str:
        if d.name == "spark":
            return "array(" + ", ".join(f"named_struct('name', {n}, 'value', {v})" for n, v in pairs) + ")"
        return "[" + ", ".join(f"{{'name': {n}, 'value': {v}}}" for n, v in pairs) + "]"

    def row(seq, kind, where, url="url", redirect="NULL", status="NULL", head=empty, req="a", frame="main_frame"):
        return f"""
SELECT page_id AS tab_id, '{req}' AS request_id, CAST({seq} AS INT) AS seq, '{kind}' AS kind, {frame if frame.startswith("CASE") else repr(frame)} AS frame, {url} AS url,
 CAST({redirect} AS VARCHAR(400)) AS redirect_url, CAST({status} AS INT) AS status_code, {head} AS headers, {d.time(f'page_id * 20 + {seq}')} AS ts
FROM pages WHERE {where}"""

    to1, to2 = f"concat({ORIGIN}, '/r1/', {pid})", f"concat({ORIGIN}, '/r2/', {pid})"
    last = f"CASE page_id % 3 WHEN 1 THEN {to1} WHEN 2 THEN {to2} ELSE url END"
    return "\nUNION ALL".join(
        [
            row(0, "watch", "page_id % 11 <> 0"),
            row(1, "headers", "true", status="CASE WHEN page_id % 3 > 0 THEN 301 ELSE 200 END",
                head=headers(("'Location'", "'/r1'"), ("'Content-Type'", "'text/plain'"))),
            row(2, "redirect", "page_id % 3 > 0", redirect=to1, status="301"),
            row(3, "redirect", "page_id % 3 = 2", url=to1, redirect=to2, status="302"),
            row(4, "headers", "page_id % 3 > 0", url=last, status="200",
                head=headers(("'Content-Type'", "'text/html'"), ("'X-Robots-Tag'", "'noindex'"), ("'x-robots-tag'", "'nofollow'"), ("'Server'", "'s'"))),
            row(5, "completed", "page_id % 5 = 2", status="500", frame="sub_frame"),
            row(6, "unwatch", "page_id % 13 = 6"),
            row(7, "error", "page_id % 7 = 0", url=last),
            row(7, "completed", "page_id % 7 <> 0", url=last, status="CASE WHEN page_id % 10 = 4 THEN 404 ELSE 200 END"),
            row(10, "completed", "page_id % 4 = 1", url=f"concat({ORIGIN}, '/second/', {pid})", status="204", req="b"),
        ]
    )


def stored_sessions(d: Dialect) -> str:
    pid = d.text("page_id")
    return f"""
SELECT concat('s', {pid}) AS session_id, page_id, CASE WHEN page_id % 17 = 1 THEN '{{"schemaVersion": broken' ELSE concat('{{"schemaVersion":',
  CASE WHEN page_id % 23 = 4 THEN '9' ELSE {d.text('1 + page_id % 4')} END, ',"id":"s', {pid}, '","createdAt":"2026-01-01T00:00:00.000Z","updatedAt":"2026-01-0', {d.text('1 + page_id % 9')}, 'T00:00:00.000Z",',
  CASE WHEN page_id % 17 = 0 THEN '' ELSE concat('"tabUrl":"', url, '",') END, '"finalUrl":"', {ORIGIN}, '/final/', {d.text('page_id % 40')},
  '","captureTime":"2026-01-01T00:00:00.000Z","extensionVersion":"1.0.', {d.text('page_id % 3')}, '","featureAvailability":{{"domCollector":true,"headerCapture":"unavailable","robotsFetch":false}},',
  '"snapshots":[{{"id":"old","url":"', url, '","capturedAt":"2025-12-31T00:00:00.000Z","evidence":[]}},{{"id":"new","url":"', url, '","capturedAt":"2026-01-01T00:00:00.000Z","evidence":[{{', CASE WHEN page_id % 31 = 11 THEN '' ELSE '"id":"title-0",' END, '"kind":"dom","source":"', CASE WHEN page_id % 31 = 5 AND page_id % 5 < 3 THEN 'document.title' ELSE 'title' END, '","value":{{"state":"present","value":', CASE WHEN page_id % 31 = 3 AND page_id % 5 < 3 THEN '["no","text"]' ELSE concat('"T', {pid}, '"') END, ',"selector":"title"}},"capturedAt":"2026-01-01T00:00:00.000Z"}}]',
  CASE WHEN page_id % 5 < 4 THEN concat(',"captureLimits":{{"schemaVersion":1,"applied":{{"maxStringChars":2000,"maxMetaItems":', CASE WHEN page_id % 31 = 13 THEN '0' ELSE '40' END, ',"maxAlternateItems":50,"maxJsonLdChars":50000,"maxJsonLdScripts":25,"maxHeadingSamplesPerLevel":5}},"maxSnapshotChars":400000,"maxSessionChars":1500000,"domEvidenceSchemaVersion":', CASE WHEN page_id % 5 = 3 THEN '1' ELSE '2' END, '}}') ELSE '' END, '}}],',
  '"findings":[{{"id":"f1","ruleId":"title-length","severity":"', CASE WHEN page_id % 31 = 7 THEN 'fatal' ELSE 'info' END, '","category":"metadata","affectedUrl":"', url, '","description":"d","evidenceIds":["title-0"],"recommendation":"r","sourceRef":"x","capturedAt":"2026-01-01T00:00:00.000Z"}},',
  '{{"id":"f2","ruleId":"canonical-multiple","severity":"error","category":"indexability","affectedUrl":"', url, '","description":"d | e","evidenceIds":["canonical-0"],"recommendation":"r","sourceRef":"x","capturedAt":"2026-01-01T00:00:00.000Z"}}],',
  '"captureErrors":[{{"id":"e1","code":"c1","source":"headerCapture","message":"', CASE WHEN page_id % 31 = 9 THEN '' ELSE 'none' END, '","capturedAt":"2026-01-01T00:00:00.000Z"}}]',
  CASE WHEN page_id % 4 >= 2 AND page_id % 6 <> 2 THEN concat(',"checkSelection":{{"selectedCheckIds":["title-length-advisory"],"skippedChecks":[', CASE WHEN page_id % 31 = 15 THEN '{{"checkId":"x"}}' ELSE '' END, ']}}') ELSE '' END,
  CASE WHEN page_id % 4 >= 1 AND page_id % 3 > 0 THEN ',"reportMarkdown":"notes"' WHEN page_id % 4 = 0 THEN '' ELSE ',"reportMarkdown":""' END, '}}') END AS raw
FROM pages""".replace("{{", "{").replace("}}", "}")


def run_payloads(d: Dialect) -> str:
    """Comparison runs to attach to sessions; some hold a raw body deep inside."""
    pid = d.text("page_id")
    return f"""
SELECT concat('s', {pid}) AS session_id, CASE WHEN page_id % 2 = 0 THEN 'variantTestRun' ELSE 'soft404ProbeRun' END AS run_kind,
  CASE page_id % 5 WHEN 1 THEN '{{"rows":[{{"url":"u","meta":{{"bodyText":"x"}}}}]}}' WHEN 2 THEN '{{"html":"<p>"}}'
       WHEN 3 THEN '{{"note":"the word body: html","rows":[1,2]}}' ELSE '{{"rows":[]}}' END AS payload
FROM pages WHERE page_id % 3 = 0""".replace("{{", "{").replace("}}", "}")


#: name -> builder; later tables may read earlier ones.
def reference_texts(d: Dialect) -> str:
    """A text and an attribute value with references: names in turn, with and without their
    semicolon and what may follow one, and numbers of all ranges."""
    names = f"{'split' if d.name == 'spark' else 'string_split'}('{' '.join(html5)}', ' ')"
    lower = "lower(hex(code))" if d.name == "spark" else "lower(to_hex(code))"
    code = d.text("code")

    def name(k: int) -> str:
        return f"names[{'' if d.name == 'spark' else '1 + '}(page_id * 9 + {k}) % {len(html5)}]"

    def made(first: int) -> str:
        n = [name(first + k) for k in range(3)]
        return (
            f"concat('x &', {n[0]}, ' y &', replace({n[0]}, ';', ''), 'z &', {n[1]}, '=1 &', {n[2]}, '&', {n[2]}, 'amp; & &;&amp;lt; &#', {code}, "
            f"';&#x', {lower}, ' &&#0', {code}, '&num;65;&#99999999999;&#x80;&#', {d.text('128 + page_id % 32')}, '&#;&#x; q')"
        )

    return f"""
SELECT page_id, {made(0)} AS t, {made(4)} AS a FROM (
 SELECT page_id, page_id * 7919 % CASE WHEN page_id % 2 = 0 THEN 1300000 ELSE 700 END AS code, {names} AS names FROM pages) n"""


def reference_pages(d: Dialect) -> str:
    return """
SELECT page_id, 'https://references.example.test/' AS url, concat('<html><head><title>', t, '</title><meta name="description" content="', a,
 '"><link rel="canonical" href="', a, '"></head><body><h1>', t, '</h1><img src="/i" alt="', a, '"><a href="', a, '">', t, '</a></body></html>') AS html
FROM reference_texts"""


DERIVED = {
    f.__name__: f
    for f in (
        audit_pages,
        origins,
        robots_files,
        sitemap_leaves,
        sitemap_files,
        sitemap_files_large,
        sitemap_parts_large,
        fetches,
        response_headers,
        navigations,
        fetch_hops,
        hop_log,
        hop_requests,
        captures,
        variant_results,
        renders,
        nav_events,
        stored_sessions,
        run_payloads,
        reference_texts,
        reference_pages,
    )
}


def cluster_members(d: Dialect) -> str:
    """Four pages per hreflang cluster; one page in eleven was not fetched."""
    return f"""
SELECT {d.div('page_id', 4)} AS cluster_id, page_id AS member_id,
 CASE page_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'FR' WHEN 2 THEN 'de' ELSE 'en-uk' END AS hreflang, url AS requested_url,
 CASE WHEN page_id % 6 = 2 AND NOT contains(url,'?') AND NOT contains(url,'#') AND NOT url LIKE '%/' THEN concat(url,'/') ELSE url END AS final_url
FROM pages WHERE page_id % 11 <> 0"""


def cluster_edges(d: Dialect) -> str:
    same = f"{d.div('p.page_id', 4)} = {d.div('o.page_id', 4)}"
    return f"""
SELECT {d.div('p.page_id', 4)} AS cluster_id, p.page_id AS member_id,
 CASE o.page_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'DE' ELSE 'en-uk' END AS hreflang, o.url AS href
FROM pages p JOIN pages o ON {same}
WHERE NOT (p.page_id % 5 = 0 AND o.page_id = p.page_id) AND NOT (p.page_id % 7 = 0 AND o.page_id % 4 = 2)
UNION ALL
SELECT {d.div('page_id', 4)}, page_id, 'en', concat(url, '-twice') FROM pages WHERE page_id % 9 = 1"""


def robots_fetch_log(d: Dialect) -> str:
    """A robots fetch per page visit; only the first per session and origin counts."""
    return f"SELECT page_id % 7 AS session_id, {ORIGIN} AS origin, page_id, {d.time('page_id')} AS ts FROM pages"


DERIVED.update({f.__name__: f for f in (cluster_members, cluster_edges, robots_fetch_log)})
