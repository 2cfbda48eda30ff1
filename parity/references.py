"""Character references of every name and many numbers, in texts and in attributes."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from parity.duck import q, trim
from parity.registry import CTES, query
from sitelens.operators import facts as P

CTES["ref_names"] = "SELECT * FROM (VALUES " + ",".join(f"({q(n)},{q(t)})" for n, t in html5.items()) + ") v(name, chars)"
# Code page 1252 where it has a character.
CTES["ref_windows"] = "SELECT * FROM (VALUES " + ",".join(
    f"({n},{q(bytes([n]).decode('cp1252'))})" for n in range(128, 160) if bytes([n]).decode("cp1252", errors="ignore")
) + ") v(code, chars)"
CTES["ref_parts"] = """SELECT page_id, kind, unnest(range(len(l))) AS i, unnest(l) AS part FROM (
 SELECT page_id, 'text' AS kind, string_split(t, '&') AS l FROM reference_texts UNION ALL SELECT page_id, 'attr', string_split(a, '&') FROM reference_texts)"""
CTES["ref_longest"] = """SELECT page_id, kind, i, arg_max(name, length(name)) AS name, arg_max(chars, length(name)) AS chars
 FROM ref_parts JOIN ref_names ON starts_with(part, name) WHERE i > 0 GROUP BY ALL"""
CTES["ref_number"] = """SELECT page_id, kind, i, part, regexp_extract(part, '^#(?:[0-9]+|[xX][0-9A-Fa-f]+);?') AS token,
 CASE WHEN regexp_matches(part, '^#[0-9]') THEN try_cast(regexp_extract(part, '^#([0-9]+)', 1) AS BIGINT)
      ELSE try_cast('0x' || regexp_extract(part, '^#[xX]([0-9A-Fa-f]+)', 1) AS BIGINT) END AS code
 FROM ref_parts WHERE i > 0 AND regexp_matches(part, '^#(?:[0-9]+|[xX][0-9A-Fa-f]+)')"""
CTES["ref_resolved"] = """SELECT p.page_id, p.kind, string_agg(CASE WHEN p.i = 0 THEN p.part
   WHEN n.token IS NOT NULL THEN CASE WHEN n.code IS NULL OR n.code = 0 OR n.code > 1114111 OR n.code BETWEEN 55296 AND 57343 THEN chr(65533)
        ELSE coalesce(w.chars, chr(n.code::INTEGER)) END || substring(p.part, length(n.token) + 1)
   WHEN l.name IS NULL OR (p.kind = 'attr' AND l.name NOT LIKE '%;' AND regexp_matches(substring(p.part, length(l.name) + 1), '^[=A-Za-z0-9]')) THEN '&' || p.part
   ELSE l.chars || substring(p.part, length(l.name) + 1) END, '' ORDER BY p.i) AS v
 FROM ref_parts p LEFT JOIN ref_longest l USING (page_id, kind, i) LEFT JOIN ref_number n USING (page_id, kind, i) LEFT JOIN ref_windows w ON w.code = n.code
 GROUP BY ALL"""


@query(
    "B1_character_references",
    f"""SELECT page_id, {trim('t.v')} AS title, {trim('t.v')} AS heading, {trim('t.v')} AS link_text, {trim('a.v')} AS description, a.v AS alt, a.v AS link_href,
 a.v AS canonical FROM (SELECT page_id, v FROM ref_resolved WHERE kind = 'text') t JOIN (SELECT page_id, v FROM ref_resolved WHERE kind = 'attr') a USING (page_id)""",
)
def character_references(c):
    pages = c.table("reference_pages")
    facts = P.page_facts(pages).select(
        "page_id",
        F.col("title.raw").alias("title"),
        F.col("headings.value")["samples"][0]["text"].alias("heading"),
        F.col("meta_description.raw").alias("description"),
        F.col("canonical.raw").alias("canonical"),
    )
    links = P.page_links(pages).select("page_id", F.col("text").alias("link_text"), F.col("href").alias("link_href"))
    images = P.page_images(pages).select("page_id", "alt")
    return facts.join(links, "page_id").join(images, "page_id")
