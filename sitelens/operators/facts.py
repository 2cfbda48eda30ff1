"""Pages in, one typed row of facts per page out.

``page_facts`` is one map-side pass: no shuffle, no Python.  Each field is a
state struct (absent / empty / present / duplicate / malformed).  The element
arrays are computed once per page behind a barrier filters cannot cross;
Catalyst prunes the field structs a job does not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import html as H
from sitelens.functions.expr import browser_trim, cached_columns, clip, computed_once, let
from sitelens.functions.urls import is_http, parse_url, resolve_url
from sitelens.limits import DEFAULT_CAPTURE, CaptureLimits

FACT_FIELDS = (
    "title",
    "meta_description",
    "meta_robots",
    "canonical",
    "alternates",
    "open_graph",
    "twitter",
    "language",
    "viewport",
    "headings",
    "links",
    "images",
    "html5",
    "json_ld",
)

LIMITS_TYPE = "struct<truncated:boolean,reason:string,omitted_count:int>"


def _limits(reasons: list[tuple[Column, str]], omitted: Column | None = None) -> Column:
    """Limits struct, NULL when none of the reasons holds."""
    hit = F.filter(
        F.array(*[F.when(cond, F.lit(text)) for cond, text in reasons]), lambda r: r.isNotNull()
    )
    count = F.lit(None).cast("int") if omitted is None else F.when(omitted > 0, omitted)
    return F.when(
        F.size(hit) > 0,
        F.struct(
            F.lit(True).alias("truncated"),
            F.array_join(hit, "; ").alias("reason"),
            count.cast("int").alias("omitted_count"),
        ),
    ).cast(LIMITS_TYPE)


def _field(
    state: Column,
    value: Column,
    values: Column,
    raw: Column | None,
    selector: Column | None,
    count: Column | None,
    detail: Column | None,
    limits: Column | None,
) -> Column:
    null_text = F.lit(None).cast("string")
    return F.struct(
        state.alias("state"),
        value.alias("value"),
        values.alias("values"),
        (null_text if raw is None else raw).alias("raw"),
        (null_text if selector is None else selector).alias("selector"),
        (F.lit(None).cast("int") if count is None else count.cast("int")).alias("count"),
        (null_text if detail is None else detail).alias("detail"),
        (F.lit(None).cast(LIMITS_TYPE) if limits is None else limits).alias("limits"),
    )


def _absent_or_present(
    items: Column, cap: int, selector: str, label: str, cut: Column, lim: CaptureLimits
) -> Column:
    """List-valued field: absent without items, else present with the first ``cap``."""
    omitted = F.greatest(F.size(items) - cap, F.lit(0))
    return _field(
        state=F.when(F.size(items) == 0, "absent").otherwise("present"),
        value=F.when(F.size(items) > 0, F.slice(items, 1, cap)),
        values=F.lit(None).cast("array<string>"),
        raw=None,
        selector=F.when(F.size(items) > 0, F.lit(selector)),
        count=F.when(F.size(items) > 0, F.size(items)),
        detail=None,
        limits=_limits(
            [
                (omitted > 0, f"{label} clipped to {cap} entries"),
                (cut, f"String clipped to {lim.string_chars} characters"),
            ],
            omitted,
        ),
    )


def _one_or_many(
    items: Column,
    value_of,
    selector: str,
    label: str,
    lim: CaptureLimits,
    numbered: bool = False,
) -> Column:
    """Field that should occur once: absent, empty, present or duplicate.

    ``items`` is array<struct<raw,cut,...>>, raw already trimmed and clipped."""
    n = F.size(items)
    first = F.try_element_at(items, F.lit(1))
    omitted = F.greatest(n - lim.meta_items, F.lit(0))
    state = (
        F.when(n == 0, "absent")
        .when(n > 1, "duplicate")
        .when((first["raw"] == "") & ~first["cut"], "empty")
        .otherwise("present")
    )
    return let(
        F.struct(state.alias("s")),
        lambda x: _field(
            state=x["s"],
            value=F.when(x["s"] == "present", value_of(first)),
            values=F.when(
                x["s"] == "duplicate", F.transform(F.slice(items, 1, lim.meta_items), value_of)
            ),
            raw=F.when(x["s"].isin("present", "empty"), first["raw"]),
            selector=F.when(
                x["s"].isin("present", "empty"),
                first["selector"] if numbered else F.lit(selector),
            ),
            count=F.when(x["s"] == "present", F.lit(1)).when(x["s"] == "duplicate", n),
            detail=None,
            limits=F.when(
                x["s"].isin("present", "duplicate"),
                _limits(
                    [
                        (omitted > 0, f"{label} clipped to {lim.meta_items} entries"),
                        (
                            F.exists(items, lambda i: i["cut"]),
                            f"String clipped to {lim.string_chars} characters",
                        ),
                    ],
                    omitted,
                ),
            ),
        ),
    )


def json_value(text: Column) -> Column:
    """Strict JSON text -> VARIANT, NULL when it is not exactly one value.

    ``try_parse_json`` stops after the first value; wrapping the text as an
    array element and as a member rules trailing text out."""
    as_item = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return let(
        as_item, lambda a: F.when((F.size(a) == 1) & as_member.isNotNull(), a.getItem(0))
    )


@cached_columns
def _lex_columns() -> list[Column]:
    """Stage 1: page -> markup, script elements, parsed document URL."""
    return [
        parse_url(F.col("url")).alias("_doc"),
        H.markup_only(F.col("html")).alias("_markup"),
        H.script_elements(F.col("html")).alias("_scripts"),
        F.lower(
            F.regexp_extract(F.col("html"), r"(?is)^\s*(?:<!--.*?-->\s*)*<!doctype\s+([^\s>]+)", 1)
        ).alias("_doctype"),
    ]


@cached_columns
def _tag_columns() -> list[Column]:
    """Stage 2: markup -> open tags, anchor and heading chunks, titles."""
    return [
        H.open_tags(F.col("_markup")).alias("_tags"),
        H.chunks(F.col("_markup"), "a").alias("_a"),
        H.chunks(F.col("_markup"), "h[1-6]").alias("_h"),
        H.titles(F.col("_markup")).alias("_titles"),
    ]


@cached_columns
def _element_columns() -> list[Column]:
    """Stage 3: tags -> arrays of element structs and the base URL."""

    def of(name: str) -> Column:
        return F.filter(F.col("_tags"), lambda t: t["name"] == name)

    attr = H.attribute
    base_tags = F.filter(of("base"), lambda t: H.has_attribute(t["tag"], "href"))
    return [
        F.coalesce(
            resolve_url(attr(F.try_element_at(base_tags, F.lit(1))["tag"], "href"), F.col("_doc")),
            F.col("_doc"),
        ).alias("_base"),
        F.transform(
            of("meta"),
            lambda t: F.struct(
                F.lower(attr(t["tag"], "name")).alias("name"),
                attr(t["tag"], "name").alias("name_raw"),
                attr(t["tag"], "property").alias("property"),
                browser_trim(attr(t["tag"], "content")).alias("content"),
            ),
        ).alias("_metas"),
        F.transform(
            of("link"),
            lambda t: F.struct(
                F.lower(attr(t["tag"], "rel")).alias("rel"),
                attr(t["tag"], "href").alias("href"),
                attr(t["tag"], "hreflang").alias("hreflang"),
                H.has_attribute(t["tag"], "hreflang").alias("has_hreflang"),
            ),
        ).alias("_rels"),
        F.transform(
            of("img"),
            lambda t: F.struct(
                attr(t["tag"], "src").alias("src"),
                attr(t["tag"], "alt").alias("alt"),
                F.when(~H.has_attribute(t["tag"], "alt"), "missing")
                .when(browser_trim(attr(t["tag"], "alt")) == "", "empty")
                .otherwise("present")
                .alias("alt_state"),
            ),
        ).alias("_imgs"),
        F.transform(
            F.filter(F.col("_a"), lambda c: H.has_attribute(c, "href")),
            lambda c: F.struct(
                attr(c, "href").alias("href"), H.element_text(c, "a").alias("text")
            ),
        ).alias("_anchors"),
        F.transform(
            F.filter(
                F.col("_scripts"),
                lambda s: F.lower(attr(s, "type")) == "application/ld+json",
            ),
            lambda s: F.regexp_extract(s, rf"(?is)^<script{H.OPEN_REST}(.*?)(?:</script\s*>|\z)", 1),
        ).alias("_jsonld"),
    ]


@cached_columns
def _resolved_columns() -> list[Column]:
    """Stage 4: anchors and link elements with their targets resolved."""
    doc, base = F.col("_doc"), F.col("_base")

    def anchor(a: Column) -> Column:
        def classed(u: Column) -> Column:
            kind = (
                F.when(
                    a["href"].startswith("#")
                    | a["href"].startswith("javascript:")
                    | a["href"].startswith("mailto:"),
                    "other",
                )
                .when(u.isNull(), "other")
                .when(doc.isNotNull() & (u["origin"] == doc["origin"]) & (u["origin"] != "null"), "internal")
                .when(is_http(u), "external")
                .otherwise("other")
            )
            return F.struct(
                a["href"].alias("href"),
                u["href"].alias("absolute"),
                a["text"].alias("text"),
                kind.alias("kind"),
            )

        return let(resolve_url(a["href"], base), classed)

    passed = ("_doc", "_base", "_doctype", "_titles", "_tags", "_h", "_metas", "_imgs", "_jsonld")
    return [
        *[F.col(name).alias(name) for name in passed],
        F.transform(F.col("_anchors"), anchor).alias("_anchors"),
        F.transform(
            F.filter(
                F.col("_rels"),
                lambda r: (r["rel"] == "canonical")
                | ((r["rel"] == "alternate") & r["has_hreflang"]),
            ),
            lambda r: r.withField("absolute", resolve_url(r["href"], base)["href"]),
        ).alias("_rels"),
    ]


def _meta_items(selected: Column, lim: CaptureLimits, selector) -> Column:
    return F.transform(
        selected,
        lambda m, i: F.struct(
            clip(m["content"], lim.string_chars).alias("raw"),
            (F.length(m["content"]) > lim.string_chars).alias("cut"),
            m["name"].alias("name"),
            selector(m, i).alias("selector"),
        ),
    )


def _meta_text(name: str, lim: CaptureLimits) -> Column:
    selector = f'meta[name="{name}" i]'
    items = _meta_items(
        F.filter(F.col("_metas"), lambda m: m["name"] == name), lim, lambda m, i: F.lit(selector)
    )
    return let(
        items, lambda x: _one_or_many(x, lambda i: i["raw"], selector, "Meta duplicate list", lim)
    )


def _title(lim: CaptureLimits) -> Column:
    items = F.transform(
        F.col("_titles"),
        lambda t: F.struct(
            clip(t, lim.string_chars).alias("raw"), (F.length(t) > lim.string_chars).alias("cut")
        ),
    )
    return let(
        items, lambda x: _one_or_many(x, lambda i: i["raw"], "title", "Title duplicate list", lim)
    )


def _meta_robots(lim: CaptureLimits) -> Column:
    items = _meta_items(
        F.filter(F.col("_metas"), lambda m: m["name"].isin("robots", "googlebot")),
        lim,
        lambda m, i: F.concat(
            F.lit('meta[name="'), m["name"], F.lit('" i]:nth-of-type('), (i + 1).cast("string"), F.lit(")")
        ),
    )

    def value(i: Column) -> Column:
        return F.struct(
            i["name"].alias("name"), i["raw"].alias("content"), i["selector"].alias("selector")
        )

    return let(items, lambda x: _one_or_many(x, value, "", "Robots duplicate list", lim, numbered=True))


def _rel_items(rel: str, lim: CaptureLimits) -> Column:
    n = lim.string_chars
    selector = 'link[rel="canonical" i]' if rel == "canonical" else 'link[rel="alternate" i][hreflang]'
    return F.transform(
        F.filter(F.col("_rels"), lambda r: r["rel"] == rel),
        lambda r, i: F.struct(
            clip(r["href"], n).alias("href"),
            clip(r["hreflang"], n).alias("hreflang"),
            clip(r["absolute"], n).alias("absolute"),
            F.concat(F.lit(f"{selector}:nth-of-type("), (i + 1).cast("string"), F.lit(")")).alias(
                "selector"
            ),
            F.when(r["absolute"].isNull(), F.lit("Invalid URL")).alias("detail"),
            (
                (F.length(r["href"]) > n)
                | (F.length(r["hreflang"]) > n)
                | (F.length(F.coalesce(r["absolute"], F.lit(""))) > n)
            ).alias("cut"),
        ),
    )


def _canonical(lim: CaptureLimits) -> Column:
    def value(i: Column) -> Column:
        return F.struct(
            i["href"].alias("href"),
            i["absolute"].alias("absolute"),
            i["selector"].alias("selector"),
            i["detail"].alias("detail"),
        )

    def build(items: Column) -> Column:
        n = F.size(items)
        first = F.try_element_at(items, F.lit(1))
        omitted = F.greatest(n - lim.meta_items, F.lit(0))
        state = (
            F.when(n == 0, "absent")
            .when(n > 1, "duplicate")
            .when(browser_trim(first["href"]) == "", "empty")
            .when(first["absolute"].isNull(), "malformed")
            .otherwise("present")
        )
        single = lambda s: s.isin("present", "empty", "malformed")
        return let(
            F.struct(state.alias("s")),
            lambda x: _field(
                state=x["s"],
                value=F.when(x["s"] == "present", value(first)),
                values=F.when(
                    x["s"] == "duplicate", F.transform(F.slice(items, 1, lim.meta_items), value)
                ),
                raw=F.when(x["s"] == "empty", F.lit("")).when(single(x["s"]), first["href"]),
                selector=F.when(single(x["s"]), first["selector"]),
                count=F.when(x["s"] == "present", F.lit(1)).when(x["s"] == "duplicate", n),
                detail=F.when(x["s"] == "malformed", first["detail"]),
                limits=F.when(
                    x["s"].isin("present", "duplicate"),
                    _limits(
                        [
                            (omitted > 0, f"Canonical duplicate list clipped to {lim.meta_items} entries"),
                            (
                                F.exists(items, lambda i: i["cut"]),
                                f"String clipped to {lim.string_chars} characters",
                            ),
                        ],
                        omitted,
                    ),
                ),
            ),
        )

    return let(_rel_items("canonical", lim), build)


def _alternates(lim: CaptureLimits) -> Column:
    def build(items: Column) -> Column:
        return _absent_or_present(
            F.transform(items, lambda i: i.dropFields("cut")),
            lim.alternate_items,
            'link[rel="alternate" i][hreflang]',
            "Alternate list",
            F.exists(items, lambda i: i["cut"]),
            lim,
        )

    return let(_rel_items("alternate", lim), build)


def _meta_group(prefix: str, attr: str, lim: CaptureLimits) -> Column:
    key = "property" if attr == "property" else "name_raw"
    n = lim.string_chars
    items = F.transform(
        F.filter(F.col("_metas"), lambda m: F.lower(m[key]).startswith(prefix)),
        lambda m: F.struct(
            clip(m[key], n).alias("key"),
            clip(m["content"], n).alias("content"),
            ((F.length(m[key]) > n) | (F.length(m["content"]) > n)).alias("cut"),
        ),
    )
    return let(
        items,
        lambda x: _absent_or_present(
            F.transform(x, lambda i: i.dropFields("cut")),
            lim.meta_items,
            f'meta[{attr}^="{prefix}" i]',
            "Item list",
            F.exists(x, lambda i: i["cut"]),
            lim,
        ),
    )


def _language(lim: CaptureLimits) -> Column:
    html_tag = F.try_element_at(
        F.filter(F.col("_tags"), lambda t: t["name"] == "html"), F.lit(1)
    )["tag"]
    lang = F.coalesce(browser_trim(H.attribute(html_tag, "lang")), F.lit(""))

    def build(text: Column) -> Column:
        present = text != ""
        return _field(
            state=F.when(present, "present").otherwise("empty"),
            value=F.when(present, clip(text, lim.string_chars)),
            values=F.lit(None).cast("array<string>"),
            raw=clip(text, lim.string_chars),
            selector=F.lit("html[lang]"),
            count=F.when(present, F.lit(1)),
            detail=None,
            limits=_limits(
                [
                    (
                        F.length(text) > lim.string_chars,
                        f"String clipped to {lim.string_chars} characters",
                    )
                ]
            ),
        )

    return let(lang, build)


def _named(field: str, value: str):
    return lambda item: item[field] == value


def _sample(level: str):
    return lambda i: F.struct(
        F.lit(level).alias("level"), H.element_text(i["chunk"], level).alias("text")
    )


def _headings(lim: CaptureLimits) -> Column:
    typed = F.transform(
        F.col("_h"),
        lambda c: F.struct(F.lower(F.substring(c, 2, 2)).alias("level"), c.alias("chunk")),
    )

    def build(items: Column) -> Column:
        per_level = {level: F.filter(items, _named("level", level)) for level in H.HEADINGS}
        counts = F.struct(*[F.size(per_level[level]).alias(level) for level in H.HEADINGS])
        samples = F.concat(
            *[
                F.transform(F.slice(per_level[level], 1, lim.heading_samples), _sample(level))
                for level in H.HEADINGS
            ]
        )
        return let(
            samples,
            lambda s: _field(
                state=F.lit("present"),
                value=F.struct(
                    counts.alias("levels"),
                    F.transform(
                        s, lambda i: i.withField("text", clip(i["text"], lim.string_chars))
                    ).alias("samples"),
                ),
                values=F.lit(None).cast("array<string>"),
                raw=None,
                selector=F.lit("h1–h6"),
                count=F.size(items),
                detail=None,
                limits=_limits(
                    [
                        (
                            F.exists(s, lambda i: F.length(i["text"]) > lim.string_chars),
                            f"String clipped to {lim.string_chars} characters",
                        )
                    ]
                ),
            ),
        )

    return let(typed, build)


def _inventory_limits(total: Column, cap: int, label: str) -> Column:
    omitted = F.greatest(total - cap, F.lit(0))
    return _limits([(omitted > 0, f"{label} clipped to {cap} rows")], omitted)


def _links(lim: CaptureLimits) -> Column:
    anchors = F.col("_anchors")
    n = lim.string_chars

    def of(kind: str) -> Column:
        return F.size(F.filter(anchors, lambda a: a["kind"] == kind))

    inventory = F.transform(
        F.slice(anchors, 1, lim.link_inventory),
        lambda a: F.struct(
            clip(a["href"], n).alias("href"),
            clip(a["absolute"], n).alias("absolute"),
            clip(a["text"], n).alias("text"),
        ),
    )
    return _field(
        state=F.lit("present"),
        value=F.struct(
            F.size(anchors).alias("total"),
            of("internal").alias("internal"),
            of("external").alias("external"),
            of("other").alias("other"),
            inventory.alias("inventory"),
        ),
        values=F.lit(None).cast("array<string>"),
        raw=None,
        selector=F.lit("a[href]"),
        count=F.size(anchors),
        detail=None,
        limits=_inventory_limits(F.size(anchors), lim.link_inventory, "Link inventory"),
    )


def _images(lim: CaptureLimits) -> Column:
    imgs = F.col("_imgs")
    n = lim.string_chars

    def of(state: str) -> Column:
        return F.size(F.filter(imgs, lambda i: i["alt_state"] == state))

    inventory = F.transform(
        F.slice(imgs, 1, lim.image_inventory),
        lambda i: F.struct(
            clip(i["src"], n).alias("src"),
            F.when(i["alt_state"] == "present", clip(i["alt"], n))
            .when(i["alt_state"] == "empty", "")
            .alias("alt"),
            i["alt_state"].alias("alt_state"),
        ),
    )
    return _field(
        state=F.lit("present"),
        value=F.struct(
            F.size(imgs).alias("total"),
            of("present").alias("with_alt"),
            of("empty").alias("empty_alt"),
            of("missing").alias("missing_alt"),
            inventory.alias("inventory"),
        ),
        values=F.lit(None).cast("array<string>"),
        raw=None,
        selector=F.lit("img"),
        count=F.size(imgs),
        detail=None,
        limits=_inventory_limits(F.size(imgs), lim.image_inventory, "Image inventory"),
    )


def _html5() -> Column:
    counts = F.struct(
        *[
            F.size(F.filter(F.col("_tags"), _named("name", name))).alias(name)
            for name in H.LANDMARKS
        ]
    )
    doctype = F.when(
        F.col("_doctype") != "", F.concat(F.lit("<!DOCTYPE "), F.col("_doctype"), F.lit(">"))
    )

    def build(c: Column) -> Column:
        total = sum((c[name] for name in H.LANDMARKS), F.lit(0))
        return _field(
            state=F.lit("present"),
            value=F.struct(
                doctype.alias("doctype"),
                c.alias("counts"),
                (c["main"] > 0).alias("has_main"),
                total.alias("landmark_total"),
            ),
            values=F.lit(None).cast("array<string>"),
            raw=None,
            selector=F.lit(",".join(H.LANDMARKS)),
            count=total,
            detail=None,
            limits=None,
        )

    return let(counts, build)


def _json_ld(lim: CaptureLimits) -> Column:
    kept = F.slice(F.col("_jsonld"), 1, lim.jsonld_scripts)
    total = F.size(F.col("_jsonld"))

    def entries(scripts: Column) -> Column:
        def entry(text: Column, i: Column) -> Column:
            before = F.aggregate(
                F.slice(scripts, F.lit(1), i), F.lit(0), lambda a, s: a + F.length(s)
            )

            def judged(left: Column) -> Column:
                cut = F.length(text) > left
                trimmed = browser_trim(text)
                status = (
                    F.when(cut | (left <= 0), "truncated")
                    .when(trimmed == "", "empty")
                    .when(json_value(trimmed).isNull(), "invalid-json")
                    .otherwise("ok")
                )
                return F.struct(
                    i.alias("index"),
                    F.substr(text, F.lit(1), F.greatest(left, F.lit(0))).alias("raw"),
                    (cut | (left <= 0)).alias("truncated"),
                    status.alias("parse_status"),
                )

            return let(F.lit(lim.jsonld_chars) - before, judged)

        return F.transform(scripts, entry)

    def build(found: Column) -> Column:
        omitted = F.greatest(total - lim.jsonld_scripts, F.lit(0))
        return _field(
            state=F.when(total == 0, "absent").otherwise("present"),
            value=F.when(total > 0, found),
            values=F.lit(None).cast("array<string>"),
            raw=None,
            selector=F.when(total > 0, F.lit('script[type="application/ld+json" i]')),
            count=F.when(total > 0, total),
            detail=None,
            limits=_limits(
                [
                    (omitted > 0, f"JSON-LD script list clipped to {lim.jsonld_scripts} entries"),
                    (
                        F.exists(found, lambda e: e["truncated"]),
                        f"JSON-LD raw text clipped to {lim.jsonld_chars} characters",
                    ),
                ],
                omitted,
            ),
        )

    return let(let(kept, entries), build)


def page_structure(pages: DataFrame) -> DataFrame:
    """Element arrays of every page (whole, not clipped) before states are built."""
    keys = [c for c in pages.columns if c != "html"]
    lexed = pages.select(*keys, *_lex_columns())
    tags = lexed.select("*", *_tag_columns())
    elements = tags.select(
        *keys, "_doc", "_doctype", "_titles", "_tags", "_h", *_element_columns()
    )
    return computed_once(elements, keys, _resolved_columns())


@cached_columns
def _fact_columns(limits: CaptureLimits) -> list[Column]:
    bound = limits.url_chars
    document, base = F.coalesce(F.col("_doc")["href"], F.col("url")), F.col("_base")["href"]

    def url_bound(text: Column) -> Column:
        return F.when(
            F.length(text) > bound,
            F.struct(
                F.lit(True).alias("truncated"),
                F.lit(f"URL clipped to {bound} characters").alias("reason"),
                F.length(text).alias("original_length"),
            ),
        )

    fields = {
        "title": _title(limits),
        "meta_description": _meta_text("description", limits),
        "meta_robots": _meta_robots(limits),
        "canonical": _canonical(limits),
        "alternates": _alternates(limits),
        "open_graph": _meta_group("og:", "property", limits),
        "twitter": _meta_group("twitter:", "name", limits),
        "language": _language(limits),
        "viewport": _meta_text("viewport", limits),
        "headings": _headings(limits),
        "links": _links(limits),
        "images": _images(limits),
        "html5": _html5(),
        "json_ld": _json_ld(limits),
    }
    return [
        clip(document, bound).alias("document_url"),
        clip(base, bound).alias("base_uri"),
        F.struct(
            url_bound(document).alias("document_url"), url_bound(base).alias("base_uri")
        ).alias("url_bounds"),
        F.col("_doc")["origin"].alias("origin"),
        *[
            # A page without captured HTML has no evidence, which is not "absent".
            F.when(F.col("_tags").isNotNull(), field).alias(name)
            for name, field in fields.items()
        ],
    ]


def page_facts(pages: DataFrame, limits: CaptureLimits = DEFAULT_CAPTURE) -> DataFrame:
    """pages(page_id, url, html, ...) -> facts, one row per page, one struct per field.

    Other columns of ``pages`` (a capture role, a crawl date) are carried along."""
    keys = [c for c in pages.columns if c != "html"]
    return page_structure(pages).select(*keys, *_fact_columns(limits))


def page_links(pages: DataFrame) -> DataFrame:
    """Every anchor of every page as a row (no inventory limit)."""
    return page_structure(pages).select(
        "page_id", "url", F.posexplode("_anchors").alias("pos", "link")
    ).select("page_id", "url", "pos", "link.*")


def page_images(pages: DataFrame) -> DataFrame:
    """Every image of every page as a row (no inventory limit)."""
    return page_structure(pages).select(
        "page_id", "url", F.posexplode("_imgs").alias("pos", "image")
    ).select("page_id", "url", "pos", "image.*")


def page_scripts(pages: DataFrame) -> DataFrame:
    """Every JSON-LD script body of every page as a row."""
    return page_structure(pages).select(
        "page_id", "url", F.posexplode("_jsonld").alias("pos", "raw")
    )
