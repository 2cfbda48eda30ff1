"""One wide row of evidence per page: facts joined with crawl evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.expr import let
from sitelens.functions.headers import directive_tokens, is_html_type
from sitelens.functions.urls import comparable_url

# A chain longer than this is reported.
MAX_QUIET_HOPS = 5


def _directives(tokens: Column) -> Column:
    """struct<noindex,nofollow>, NULL when nothing was declared."""
    return let(
        tokens,
        lambda t: F.when(
            F.size(t) > 0,
            F.struct(
                (F.array_contains(t, "none") | F.array_contains(t, "noindex")).alias("noindex"),
                (F.array_contains(t, "none") | F.array_contains(t, "nofollow")).alias("nofollow"),
            ),
        ),
    )


def meta_robots_contents(field: Column) -> Column:
    """All contents of a meta robots field, present or duplicate."""
    return F.when(field["state"] == "present", F.array(field["value"]["content"])).when(
        field["state"] == "duplicate", F.transform(field["values"], lambda v: v["content"])
    )


def meta_directives(field: Column) -> Column:
    contents = meta_robots_contents(field)
    return _directives(F.flatten(F.transform(contents, directive_tokens)))


def header_directives(x_robots_tag: Column) -> Column:
    return _directives(directive_tokens(F.coalesce(x_robots_tag, F.lit(""))))


def redirect_summary(hops: DataFrame, compat: bool = False) -> DataFrame:
    """hops(page_id, pos, from_url, to_url) -> page_id, hop_count, sources, targets, loop_in_hops.

    A loop is a URL that occurs twice as a hop source.  One aggregate per page,
    combined on the map side.  ``compat`` also counts every step onto a URL met
    before, which makes any chain of two or more hops a loop."""
    keyed = hops.select(
        "page_id",
        "pos",
        comparable_url(F.col("from_url")).alias("f"),
        comparable_url(F.col("to_url")).alias("t"),
    )
    out = keyed.groupBy("page_id").agg(
        F.count("*").alias("hop_count"),
        F.collect_set("f").alias("hop_sources"),
        F.collect_set("t").alias("hop_targets"),
        F.count("f").alias("_known"),
    )
    loops = F.size("hop_sources") < F.col("_known")
    if compat:
        loops = loops | (F.size(F.array_intersect("hop_sources", "hop_targets")) > 0)
    return out.select(
        "page_id", "hop_count", "hop_sources", "hop_targets", loops.alias("loop_in_hops")
    )


def repeated_sources(hops: DataFrame) -> DataFrame:
    """Hops whose source was the source of an earlier hop of the same page."""
    from pyspark.sql import Window

    w = (
        Window.partitionBy("page_id", "source")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        hops.withColumn("source", comparable_url(F.col("from_url")))
        .withColumn("earlier", F.count("*").over(w))
        .filter("earlier > 0 AND source IS NOT NULL")
        .select("page_id", "pos", "from_url", "earlier")
    )


def page_evidence(
    facts: DataFrame,
    navigations: DataFrame | None = None,
    hops: DataFrame | None = None,
    robots: DataFrame | None = None,
    sitemaps: DataFrame | None = None,
    compat: bool = False,
) -> DataFrame:
    """facts ⟕ navigations ⟕ hops ⟕ robots blocks ⟕ sitemap membership, by page.

    Every side is unique per page_id, so each join is one-to-one; NULL in a
    joined column means the evidence was not captured."""
    out = facts.withColumn("meta_signal", meta_directives(F.col("meta_robots")))
    if navigations is not None:
        nav = navigations.select(
            "page_id",
            F.lit(True).alias("nav_observed"),
            F.col("requested_url").alias("nav_requested_url"),
            F.col("final_url").alias("nav_final_url"),
            F.col("status_code").alias("nav_status"),
            F.col("content_type").alias("nav_content_type"),
            F.col("x_robots_tag").alias("nav_x_robots_tag"),
            header_directives(F.col("x_robots_tag")).alias("header_signal"),
        )
        out = out.join(nav, "page_id", "left")
        if hops is not None:
            out = out.join(redirect_summary(hops, compat), "page_id", "left")
    if robots is not None:
        out = out.join(robots, "page_id", "left")
    if sitemaps is not None:
        out = out.join(sitemaps, "page_id", "left")
    # The same columns always exist, so checks need no special cases.
    defaults = {
        "nav_observed": "boolean",
        "nav_requested_url": "string",
        "nav_final_url": "string",
        "nav_status": "int",
        "nav_content_type": "string",
        "nav_x_robots_tag": "string",
        "header_signal": "struct<noindex:boolean,nofollow:boolean>",
        "hop_count": "bigint",
        "hop_sources": "array<string>",
        "hop_targets": "array<string>",
        "loop_in_hops": "boolean",
        "robots_path": "string",
        "robots_blocked": "boolean",
        "robots_blocked_by": "string",
        "sitemap_present": "boolean",
        "matched_loc": "string",
        "sitemap_file": "string",
        "sitemap_alternates": "array<struct<hreflang:string,href:string>>",
    }
    missing = {n: F.lit(None).cast(t) for n, t in defaults.items() if n not in out.columns}
    return out.withColumns(missing) if missing else out


def redirect_loop(compat: bool = False) -> Column:
    """Does the chain revisit a URL: inside the hops, or at the final URL."""
    final = comparable_url(F.col("nav_final_url"))
    seen = F.col("hop_sources")
    if compat:
        seen = F.array_union("hop_sources", "hop_targets")
    return F.coalesce(F.col("loop_in_hops") | F.array_contains(seen, final), F.lit(False))


def canonical_mismatch() -> Column:
    target = comparable_url(F.col("canonical.value.absolute"))
    final = comparable_url(F.col("nav_final_url"))
    return let(
        F.struct(target.alias("c"), final.alias("f")),
        lambda s: F.coalesce((s["c"] != s["f"]), F.lit(False)),
    )


def not_html() -> Column:
    return F.coalesce(~is_html_type(F.col("nav_content_type")), F.lit(False))
