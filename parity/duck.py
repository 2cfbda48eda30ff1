"""DuckDB expression helpers: an independent spelling of the page semantics."""

from __future__ import annotations

from parity.registry import CTES

ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
OPEN = rf"(?:[\s/]{ATTRS})?>"
NAME = r"""[^\s"'>/=]+"""
VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
SPACE = r"[\s\x{A0}\x{FEFF}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(expr: str) -> str:
    return f"regexp_replace({expr}, {q(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def squeeze(expr: str) -> str:
    return trim(f"regexp_replace({expr}, {q(SPACE + '+')}, ' ', 'g')")


def decode(expr: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        expr = f"replace({expr}, {q(a)}, {q(b)})"
    return expr


def _walk(name: str, tail: str) -> str:
    return rf"(?is)^<[a-z0-9]+(?:\s+{NAME}(?:\s*=\s*{VALUE})?)*?\s+{name}{tail}"


def attr(tag: str, name: str) -> str:
    raw = f"regexp_extract({tag}, {q(_walk(name, rf'\s*=\s*({VALUE}|)'))}, 1)"
    return decode(f"""regexp_replace({raw}, '^["'']|["'']$', '', 'g')""")


def has(tag: str, name: str) -> str:
    return f"regexp_matches({tag}, {q(_walk(name, r'(?:\s*=|[\s/>])'))})"


def element(chunk: str, name: str) -> str:
    inner = f"regexp_extract({chunk}, {q(rf'(?is)^<{name}{OPEN}(.*?)(?:</{name}\s*>|\z)')}, 1)"
    return trim(decode(f"regexp_replace({inner}, '<[^>]*>', '', 'g')"))


def slug(expr: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace({expr}, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'unknown')"


def enc(expr: str) -> str:
    return (
        f"CASE WHEN regexp_matches({expr}, '[^!#-;=?-~]') THEN list_aggregate(list_transform("
        f"regexp_extract_all({expr}, '[!#-;=?-~]+|[^!#-;=?-~]+'), lambda x: CASE WHEN regexp_matches(x, '^[!#-;=?-~]+$') THEN x ELSE url_encode(x) END), 'string_agg', '') ELSE {expr} END"
    )


SPECIAL = "('http','https','ws','wss','ftp')"


def url_chain(prefix: str, src: str, href: str, base: str = "NULL") -> str:
    """Register CTEs that add {prefix}_href/_scheme/_host/_origin/_path/_query/_frag to ``src``."""
    n = f"{prefix}__{src}"
    names = "['s','a','p','q','f']"
    scratch = "x_h, x_b, x_p, x_bp"
    CTES[f"{n}_1"] = f"""SELECT *, regexp_extract(x_h, {q(URL)}, {names}) AS x_p, regexp_extract(x_b, {q(URL)}, {names}) AS x_bp
 FROM (SELECT *, regexp_replace({trim(href)}, '[\\t\\r\\n]', '', 'g') AS x_h, CAST({base} AS VARCHAR) AS x_b FROM {src}) t"""
    CTES[f"{n}_2"] = f"""SELECT *, CASE WHEN x_h IS NULL THEN 'bad'
   WHEN lower(x_p.s) = '' OR (lower(x_p.s) IN {SPECIAL} AND x_p.a = '' AND x_b IS NOT NULL AND lower(x_p.s) = x_bp.s) THEN CASE WHEN x_b IS NULL OR x_p.a = '//' THEN 'bad' ELSE 'rel' END
   WHEN lower(x_p.s) IN {SPECIAL} THEN CASE WHEN length(x_p.a) > 2 THEN 'abs' ELSE 'bad' END ELSE 'opaque' END AS x_k FROM {n}_1"""
    CTES[f"{n}_3"] = f"""SELECT *, CASE x_k WHEN 'rel' THEN x_bp.s ELSE lower(x_p.s) END AS x_s,
   CASE WHEN length(x_p.a) > 2 THEN substring(x_p.a, 3) WHEN x_k = 'rel' THEN substring(x_bp.a, 3) ELSE '' END AS x_a,
   CASE WHEN x_k <> 'rel' OR length(x_p.a) > 2 OR x_p.p LIKE '/%' OR x_p.p LIKE '\\%' THEN x_p.p WHEN x_p.p = '' THEN x_bp.p
        ELSE concat(regexp_extract(x_bp.p, '(?s)^(.*/)', 1), x_p.p) END AS x_path,
   CASE WHEN x_k = 'rel' AND x_p.p = '' AND length(x_p.a) <= 2 AND x_p.q = '' THEN x_bp.q ELSE x_p.q END AS x_q, x_p.f AS x_f FROM {n}_2"""
    CTES[f"{n}_4"] = f"""SELECT *, string_split(x_a, '@')[-1] AS x_hp, CASE WHEN contains(x_a,'@') THEN regexp_extract(x_a,'^(.*@)',1) ELSE '' END AS x_u,
   CASE WHEN x_path = '' THEN '/' ELSE {enc("replace(x_path, chr(92), '/')")} END AS x_ep, {enc('x_q')} AS x_eq, {enc('x_f')} AS x_ef FROM {n}_3"""
    fold = (
        "concat('/', array_to_string(list_reduce([[]::VARCHAR[]] || list_transform(CASE WHEN string_split(substring(x_ep,2),'/')[-1] IN ('.','..') "
        "THEN list_append(string_split(substring(x_ep,2),'/'), '') ELSE string_split(substring(x_ep,2),'/') END, lambda z: [z]), "
        "lambda acc, z: CASE WHEN z[1] = '..' THEN list_slice(acc, 1, greatest(len(acc)-1,0)) WHEN z[1] = '.' THEN acc ELSE list_concat(acc, z) END), '/'))"
    )
    CTES[f"{n}_5"] = f"""SELECT *, lower(regexp_replace(x_hp, ':[0-9]*$', '')) AS x_host, regexp_extract(x_hp, ':([0-9]+)$', 1) AS x_port,
   CASE WHEN contains(x_ep, '/.') THEN {fold} ELSE x_ep END AS x_fp FROM {n}_4"""
    CTES[f"{n}_6"] = f"""SELECT *, x_k = 'bad' OR (x_k <> 'opaque' AND (NOT regexp_matches(x_host, {q(r'^(?:[^\s<>\[\]^|%/?#@:\\]+|\[[0-9A-Fa-f:.]+\])$')})
     OR (x_port <> '' AND TRY_CAST(x_port AS BIGINT) > 65535))) AS x_bad,
   CASE WHEN x_port = '' OR (x_s IN ('http','ws') AND x_port = '80') OR (x_s IN ('https','wss') AND x_port = '443') OR (x_s = 'ftp' AND x_port = '21') THEN '' ELSE concat(':', x_port) END AS x_pp FROM {n}_5"""
    drop = "x_h, x_b, x_p, x_bp, x_k, x_s, x_a, x_path, x_q, x_f, x_hp, x_u, x_ep, x_eq, x_ef, x_host, x_port, x_fp, x_bad, x_pp"
    p = prefix
    CTES[n] = f"""SELECT * EXCLUDE ({drop}),
   CASE WHEN x_bad THEN NULL WHEN x_k = 'opaque' THEN concat(x_s, ':', substring(x_h, length(x_s)+2)) ELSE concat(x_s,'://',x_u,x_host,x_pp,x_fp,x_eq,x_ef) END AS {p}_href,
   CASE WHEN x_bad THEN NULL ELSE x_s END AS {p}_scheme,
   CASE WHEN x_bad THEN NULL WHEN x_k = 'opaque' THEN '' ELSE x_host END AS {p}_host,
   CASE WHEN x_bad THEN NULL WHEN x_k = 'opaque' THEN 'null' ELSE concat(x_s,'://',x_host,x_pp) END AS {p}_origin,
   CASE WHEN x_bad THEN NULL WHEN x_k = 'opaque' THEN regexp_extract(substring(x_h, length(x_s)+2), '(?s)^([^?#]*)', 1) ELSE x_fp END AS {p}_path,
   CASE WHEN x_bad THEN NULL WHEN x_k = 'opaque' THEN x_p.q ELSE x_eq END AS {p}_query,
   CASE WHEN x_bad THEN NULL WHEN x_k = 'opaque' THEN x_p.f ELSE x_ef END AS {p}_frag FROM {n}_6"""
    return n


def http(p: str) -> str:
    return f"{p}_scheme IN ('http','https')"


def comparable(p: str) -> str:
    return f"CASE WHEN {http(p)} THEN substring({p}_href, 1, length({p}_href) - length({p}_frag)) END"


def grouping(p: str, raw: str) -> str:
    return f"CASE WHEN {p}_href IS NULL THEN {raw} ELSE concat({p}_origin, CASE WHEN length({p}_path) > 1 THEN regexp_replace({p}_path, '/$', '') ELSE {p}_path END, {p}_query) END"


# -- page lexing ------------------------------------------------------------
OPAQUE = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(
    rf"<{n}{OPEN}.*?(?:</{n}\s*>|\z)" for n in ("script", "style", "svg", "template", "textarea")
)
SCRIPT = rf"(?is)<!--.*?(?:-->|\z)|<script{OPEN}.*?(?:</script\s*>|\z)"
LANDMARKS = ("main", "nav", "header", "footer", "article", "section", "aside")
TAG = rf"(?is)<(?:html|base|meta|link|img|{'|'.join(LANDMARKS)}){OPEN}"


def rows(src: str, list_expr: str, cols: str = "page_id, url") -> str:
    """Unnest a list column with its 0-based position."""
    return (
        f"SELECT {cols}, unnest(range(len(l))) AS pos, unnest(l) AS item FROM "
        f"(SELECT {cols}, {list_expr} AS l FROM {src}) t"
    )


def define_lexer(source: str, tag: str, keys: str = "page_id, url") -> None:
    """Register lexing CTEs over ``source`` with the suffix ``tag``."""
    t = tag
    CTES[f"lex{t}"] = f"SELECT {keys}, html, regexp_replace(html, {q(OPAQUE)}, ' ', 'g') AS c FROM {source}"
    url_chain("doc", f"lex{t}", "url")
    CTES[f"tag{t}"] = (
        f"SELECT {keys}, pos, item AS tag, lower(regexp_extract(item, '^<([A-Za-z0-9]+)', 1)) AS name FROM ("
        + rows(f"lex{t}", f"regexp_extract_all(c, {q(TAG)})", keys)
        + ") r"
    )
    CTES[f"basetag{t}"] = f"""SELECT {', '.join('l.' + k for k in keys.split(', '))}, l.doc_href, l.doc_origin, b.href AS bhref FROM doc__lex{t} l
 LEFT JOIN (SELECT {keys}, {attr('tag', 'href')} AS href, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS rn FROM tag{t} WHERE name = 'base' AND {has('tag', 'href')}) b
 ON {' AND '.join(f'l.{k} = b.{k}' for k in keys.split(', '))} AND b.rn = 1"""
    url_chain("base", f"basetag{t}", "bhref", "doc_href")
    CTES[f"page{t}"] = f"SELECT {keys}, doc_href, doc_origin, coalesce(base_href, doc_href) AS base FROM base__basetag{t}"
    CTES[f"meta{t}"] = f"""SELECT {keys}, pos, lower({attr('tag','name')}) AS name, {attr('tag','name')} AS name_raw, {attr('tag','property')} AS prop, {trim(attr('tag','content'))} AS content
 FROM tag{t} WHERE name = 'meta'"""
    CTES[f"relraw{t}"] = f"""SELECT {', '.join('x.' + k for k in keys.split(', '))}, pos, lower({attr('tag','rel')}) AS rel, {attr('tag','href')} AS href, {attr('tag','hreflang')} AS hreflang, {has('tag','hreflang')} AS has_lang, p.base, p.doc_href, p.doc_origin
 FROM tag{t} x JOIN page{t} p USING ({keys}) WHERE name = 'link'"""
    url_chain("abs", f"relraw{t}", "href", "base")
    CTES[f"rel{t}"] = f"SELECT *, row_number() OVER (PARTITION BY {keys}, rel ORDER BY pos) - 1 AS i FROM abs__relraw{t} WHERE rel = 'canonical' OR (rel = 'alternate' AND has_lang)"
    CTES[f"img{t}"] = f"""SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1 AS pos, {attr('tag','src')} AS src, {attr('tag','alt')} AS alt,
 CASE WHEN NOT {has('tag','alt')} THEN 'missing' WHEN {trim(attr('tag','alt'))} = '' THEN 'empty' ELSE 'present' END AS alt_state FROM tag{t} WHERE name = 'img'"""
    cut = lambda e: f"string_split(regexp_replace(c, '(?i)<({e})([\\s>])', chr(1) || '<\\1\\2', 'g'), chr(1))[2:]"
    CTES[f"araw{t}"] = (
        f"SELECT {', '.join('r.' + k for k in keys.split(', '))}, row_number() OVER (PARTITION BY {', '.join('r.' + k for k in keys.split(', '))} ORDER BY pos) - 1 AS pos, {attr('item','href')} AS href, {element('item','a')} AS text, p.base, p.doc_origin FROM ("
        + rows(f"lex{t}", cut("a"), keys)
        + f") r JOIN page{t} p USING ({keys}) WHERE {has('item','href')}"
    )
    url_chain("abs", f"araw{t}", "href", "base")
    CTES[f"anchor{t}"] = f"""SELECT *, CASE WHEN href LIKE '#%' OR href LIKE 'javascript:%' OR href LIKE 'mailto:%' THEN 'other' WHEN abs_href IS NULL THEN 'other'
  WHEN abs_origin = doc_origin AND abs_origin <> 'null' THEN 'internal' WHEN {http('abs')} THEN 'external' ELSE 'other' END AS kind FROM abs__araw{t}"""
    CTES[f"heading{t}"] = (
        f"SELECT {keys}, pos, lower(substring(item, 2, 2)) AS level, CASE lower(substring(item, 2, 2)) "
        + " ".join(f"WHEN 'h{i}' THEN {element('item', f'h{i}')}" for i in range(1, 7))
        + " END AS text FROM ("
        + rows(f"lex{t}", cut("h[1-6]"), keys)
        + ") r"
    )
    CTES[f"ttl{t}"] = f"SELECT {keys}, pos, {trim(decode('item'))} AS text FROM (" + rows(
        f"lex{t}", f"regexp_extract_all(c, {q(rf'(?is)<title{OPEN}(.*?)</title\s*>')}, 1)", keys
    ) + ") r"
    CTES[f"scriptraw{t}"] = rows(f"lex{t}", f"regexp_extract_all(html, {q(SCRIPT)})", keys)
    CTES[f"scriptld{t}"] = f"""SELECT {keys}, pos AS ord, regexp_extract(item, {q(rf'(?is)^<script{OPEN}(.*?)(?:</script\s*>|\z)')}, 1) AS raw
 FROM scriptraw{t} WHERE item NOT LIKE '<!--%' AND lower({attr('item','type')}) = 'application/ld+json'"""
    CTES[f"script{t}"] = f"SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY ord) - 1 AS pos, raw FROM scriptld{t}"
    CTES[f"jsonld{t}"] = f"""SELECT *, CASE WHEN remaining <= 0 OR length(raw) > remaining THEN 'truncated' WHEN {trim('raw')} = '' THEN 'empty' WHEN NOT json_valid({trim('raw')}) THEN 'invalid-json' ELSE 'ok' END AS status
 FROM (SELECT {', '.join('a.' + k for k in keys.split(', '))}, a.pos, a.raw, 50000 - coalesce(sum(length(b.raw)), 0) AS remaining FROM script{t} a LEFT JOIN script{t} b
  ON {' AND '.join(f'a.{k} = b.{k}' for k in keys.split(', '))} AND b.pos < a.pos WHERE a.pos < 25 GROUP BY ALL) z"""
    single = lambda src, extra="": f"""SELECT l.{keys.split(', ')[0]}, {', '.join('l.' + k for k in keys.split(', ')[1:])}, CASE WHEN count(x.pos) = 0 THEN 'absent' WHEN count(x.pos) > 1 THEN 'duplicate' WHEN min(x.text) = '' THEN 'empty' ELSE 'present' END AS state,
 count(x.pos) AS n, CASE WHEN count(x.pos) = 1 THEN min(x.text) END AS text, string_agg(x.text, '|' ORDER BY x.pos) AS texts{extra} FROM lex{t} l LEFT JOIN ({src}) x USING ({keys}) GROUP BY ALL"""  # noqa: E731
    CTES[f"f_title{t}"] = single(f"SELECT {keys}, pos, text FROM ttl{t}")
    for name in ("description", "viewport"):
        CTES[f"f_{name}{t}"] = single(f"SELECT {keys}, pos, content AS text FROM meta{t} WHERE name = '{name}'")
    CTES[f"f_robots{t}"] = single(
        f"SELECT {keys}, pos, content AS text, name FROM meta{t} WHERE name IN ('robots','googlebot')",
        ", string_agg(x.name, '|' ORDER BY x.pos) AS names",
    )
    CTES[f"f_canonical{t}"] = f"""SELECT {', '.join('l.' + k for k in keys.split(', '))}, CASE WHEN count(x.pos) = 0 THEN 'absent' WHEN count(x.pos) > 1 THEN 'duplicate' WHEN {trim('min(x.href)')} = '' THEN 'empty'
  WHEN min(x.abs_href) IS NULL THEN 'malformed' ELSE 'present' END AS state, count(x.pos) AS n, string_agg(x.href, '|' ORDER BY x.pos) AS hrefs, CASE WHEN count(x.pos) = 1 AND {trim('min(x.href)')} <> '' THEN min(x.abs_href) END AS absolute
  FROM lex{t} l LEFT JOIN (SELECT * FROM rel{t} WHERE rel = 'canonical') x USING ({keys}) GROUP BY ALL"""
    CTES[f"f_lang{t}"] = f"""SELECT {', '.join('l.' + k for k in keys.split(', '))}, coalesce({trim(attr('h.tag','lang'))}, '') AS text FROM lex{t} l LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS rn FROM tag{t} WHERE name = 'html') h ON {' AND '.join(f'l.{k} = h.{k}' for k in keys.split(', '))} AND h.rn = 1"""
    lk = ", ".join("l." + k for k in keys.split(", "))
    CTES[f"f_headings{t}"] = f"SELECT {lk}, " + ", ".join(
        f"count(*) FILTER (x.level = 'h{i}') AS h{i}" for i in range(1, 7)
    ) + f" FROM lex{t} l LEFT JOIN heading{t} x USING ({keys}) GROUP BY ALL"
    CTES[f"f_links{t}"] = f"SELECT {lk}, count(x.pos) AS total, " + ", ".join(
        f"count(*) FILTER (x.kind = '{k}') AS {k}" for k in ("internal", "external", "other")
    ) + f" FROM lex{t} l LEFT JOIN anchor{t} x USING ({keys}) GROUP BY ALL"
    CTES[f"f_images{t}"] = f"""SELECT {lk}, count(x.pos) AS total, count(*) FILTER (x.alt_state = 'present') AS with_alt, count(*) FILTER (x.alt_state = 'empty') AS empty_alt,
 count(*) FILTER (x.alt_state = 'missing') AS missing_alt FROM lex{t} l LEFT JOIN img{t} x USING ({keys}) GROUP BY ALL"""


define_lexer("audit_pages", "")
