"""Queries over pages: fields, inventories, evidence rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity import duck
from parity.registry import query
from sitelens.operators import facts as P

FIELD = "page_id, state, n, text, texts"


def _joined(column, part=None):
    return F.array_join(F.transform(column, lambda v: v if part is None else v[part]), "|")


def _single(c, field):
    f = F.col(field)
    return c.facts.select(
        "page_id",
        f"{field}.state",
        F.coalesce(f["count"], F.when(f["state"] == "empty", 1).otherwise(0)).alias("n"),
        F.when(f["state"].isin("present", "empty"), f["raw"]).alias("text"),
        F.when(f["state"] == "duplicate", _joined(f["values"])).otherwise(f["raw"]).alias("texts"),
    )


@query(
    "A1_page_scan",
    "SELECT p.page_id, p.doc_href AS document_url, p.base AS base_uri, t.state AS title_state, d.state AS description_state, r.state AS robots_state, c.state AS canonical_state FROM page p JOIN f_title t USING (page_id) JOIN f_description d USING (page_id) JOIN f_robots r USING (page_id) JOIN f_canonical c USING (page_id)",
)
def page_scan(c):
    return c.facts.select(
        "page_id",
        "document_url",
        "base_uri",
        F.col("title.state").alias("title_state"),
        F.col("meta_description.state").alias("description_state"),
        F.col("meta_robots.state").alias("robots_state"),
        F.col("canonical.state").alias("canonical_state"),
    )


@query("B1_title", f"SELECT {FIELD} FROM f_title")
def title(c):
    return _single(c, "title")


@query(
    "B2_meta_content",
    f"SELECT 'description' AS field, {FIELD} FROM f_description UNION ALL SELECT 'viewport', {FIELD} FROM f_viewport",
)
def meta_content(c):
    cols = ["field", "page_id", "state", "n", "text", "texts"]
    one = _single(c, "meta_description").withColumn("field", F.lit("description")).select(cols)
    return one.unionByName(_single(c, "viewport").withColumn("field", F.lit("viewport")).select(cols))


@query("B3_meta_robots", "SELECT page_id, state, n, texts AS contents, names FROM f_robots")
def meta_robots(c):
    f = F.col("meta_robots")
    present = f["state"] == "present"
    return c.facts.select(
        "page_id",
        "meta_robots.state",
        F.coalesce(f["count"], F.when(f["state"] == "empty", 1).otherwise(0)).alias("n"),
        F.when(f["state"] == "duplicate", _joined(f["values"], "content"))
        .otherwise(f["raw"])
        .alias("contents"),
        F.when(f["state"] == "duplicate", _joined(f["values"], "name"))
        .when(present, f["value"]["name"])
        .otherwise(F.regexp_extract(f["selector"], 'name="([a-z]+)"', 1))
        .alias("names"),
    )


@query("B4_canonical", "SELECT page_id, state, n, hrefs, absolute FROM f_canonical")
def canonical(c):
    f = F.col("canonical")
    return c.facts.select(
        "page_id",
        "canonical.state",
        F.coalesce(
            f["count"], F.when(f["state"].isin("empty", "malformed"), 1).otherwise(0)
        ).alias("n"),
        F.when(f["state"] == "duplicate", _joined(f["values"], "href"))
        .otherwise(f["raw"])
        .alias("hrefs"),
        f["value"]["absolute"].alias("absolute"),
    )


@query(
    "B5_alternates",
    "SELECT page_id, i AS pos, hreflang, href, abs_href AS absolute FROM rel WHERE rel = 'alternate'",
)
def alternates(c):
    return c.facts.select(
        "page_id", F.posexplode("alternates.value").alias("pos", "a")
    ).select("page_id", "pos", "a.hreflang", "a.href", "a.absolute")


@query(
    "B6_named_meta_groups",
    """SELECT page_id, 'og' AS grp, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, prop AS key, content FROM meta WHERE lower(prop) LIKE 'og:%'
 UNION ALL SELECT page_id, 'twitter', row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1, name_raw, content FROM meta WHERE name LIKE 'twitter:%'""",
)
def named_meta(c):
    def one(field, name):
        return c.facts.select(
            "page_id", F.lit(name).alias("grp"), F.posexplode(f"{field}.value").alias("pos", "m")
        ).select("page_id", "grp", "pos", "m.key", "m.content")

    return one("open_graph", "og").unionByName(one("twitter", "twitter"))


@query(
    "B7_language",
    "SELECT page_id, CASE WHEN text = '' THEN 'empty' ELSE 'present' END AS state, text AS lang FROM f_lang",
)
def language(c):
    return c.facts.select("page_id", "language.state", F.col("language.raw").alias("lang"))


@query(
    "B8_headings",
    """SELECT h.*, s.samples FROM (SELECT * EXCLUDE (url) FROM f_headings) h LEFT JOIN (SELECT page_id, string_agg(level || ':' || text, '|' ORDER BY level, pos) AS samples
 FROM (SELECT *, row_number() OVER (PARTITION BY page_id, level ORDER BY pos) AS rn FROM heading) z WHERE rn <= 5 GROUP BY page_id) s USING (page_id)""",
)
def headings(c):
    v = F.col("headings.value")
    return c.facts.select(
        "page_id",
        *[v["levels"][f"h{i}"].alias(f"h{i}") for i in range(1, 7)],
        F.array_join(
            F.transform(v["samples"], lambda s: F.concat(s["level"], F.lit(":"), s["text"])), "|"
        ).alias("samples"),
    )


@query("B9_links", "SELECT page_id, total, internal, external, other FROM f_links")
def links(c):
    v = F.col("links.value")
    return c.facts.select("page_id", v["total"].alias("total"), v["internal"].alias("internal"), v["external"].alias("external"), v["other"].alias("other"))


@query(
    "B9_link_inventory",
    "SELECT page_id, pos, href, abs_href AS absolute, text, kind FROM anchor",
)
def link_inventory(c):
    return P.page_links(c.table("audit_pages")).drop("url")


@query("B10_images", "SELECT page_id, total, with_alt, empty_alt, missing_alt FROM f_images")
def images(c):
    v = F.col("images.value")
    return c.facts.select("page_id", *[v[n].alias(n) for n in ("total", "with_alt", "empty_alt", "missing_alt")])


@query(
    "B10_image_inventory",
    "SELECT page_id, pos, src, alt, alt_state FROM img",
)
def image_inventory(c):
    return P.page_images(c.table("audit_pages")).drop("url")


@query(
    "B11_html5",
    f"""SELECT l.page_id, {', '.join(f"count(*) FILTER (t.name = '{n}') AS n_{n}" for n in duck.LANDMARKS)}, count(*) FILTER (t.name IN {duck.LANDMARKS!r}) AS landmark_total,
 count(*) FILTER (t.name = 'main') > 0 AS has_main, any_value(CASE WHEN regexp_matches(l.html, '(?i)^\\s*<!doctype\\s+[^\\s>]') THEN '<!DOCTYPE ' || lower(regexp_extract(l.html, '(?i)^\\s*<!doctype\\s+([^\\s>]+)', 1)) || '>' END) AS doctype
 FROM lex l LEFT JOIN tag t USING (page_id) GROUP BY l.page_id""",
)
def html5(c):
    v = F.col("html5.value")
    return c.facts.select(
        "page_id",
        *[v["counts"][n].alias(f"n_{n}") for n in duck.LANDMARKS],
        v["landmark_total"].alias("landmark_total"),
        v["has_main"].alias("has_main"),
        v["doctype"].alias("doctype"),
    )


@query(
    "B12_json_ld",
    "SELECT page_id, pos, status, length(raw) AS chars FROM jsonld",
)
def json_ld(c):
    return c.facts.select("page_id", F.explode("json_ld.value").alias("e")).select(
        "page_id",
        F.col("e.index").alias("pos"),
        F.col("e.parse_status").alias("status"),
        F.length("e.raw").alias("chars"),
    )
