"""Facts as evidence rows, their validation, budgets and readable summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.expr import compact
from sitelens.functions.html import HEADINGS
from sitelens.limits import DEFAULT_CAPTURE, CaptureLimits
from sitelens.operators.checks import SOURCES

DOM_SOURCES = [(s, i, f) for s, (i, kind, f) in SOURCES.items() if kind == "dom"]

# Facts shown in reports, in order.
REPORT_FACTS = (
    ("title", "Title"),
    ("meta[name=description]", "Meta description"),
    ("link[rel=canonical]", "Canonical"),
    ("meta[name=robots|googlebot]", "Meta robots"),
    ("h1-h6", "Headings"),
    ("a[href]", "Links"),
    ("img", "Images"),
)


def evidence_rows(facts: DataFrame) -> DataFrame:
    """Unpivot: one row per page and source, value as VARIANT, stable ids.

    ``inline`` of an array of structs, so the facts are read once."""
    document = F.struct(
        F.lit("doc-0").alias("evidence_id"),
        F.lit("document.URL").alias("source"),
        F.lit(None).cast("string").alias("state"),
        F.parse_json(F.to_json(F.struct("document_url", "base_uri"))).alias("value"),
    )
    rows = [
        F.when(
            F.col(f).isNotNull(),
            F.struct(
                F.lit(i).alias("evidence_id"),
                F.lit(s).alias("source"),
                F.col(f)["state"].alias("state"),
                F.parse_json(F.to_json(F.col(f))).alias("value"),
            ),
        )
        for s, i, f in DOM_SOURCES
    ]
    present = F.filter(F.array(document, *rows), lambda r: r.isNotNull())
    return facts.select(
        "page_id", F.col("document_url").alias("page_url"), F.lit("dom").alias("kind"), F.inline(present)
    )


def capture_limits(facts: DataFrame) -> DataFrame:
    """page_id, source, reason, omitted_count: what was clipped; no row if nothing."""
    rows = [
        F.when(
            F.col(f)["limits"]["truncated"],
            F.struct(
                F.lit(s).alias("source"),
                F.col(f)["limits"]["reason"].alias("reason"),
                F.col(f)["limits"]["omitted_count"].alias("omitted_count"),
            ),
        )
        for s, _, f in DOM_SOURCES
    ]
    bounds = F.concat_ws(
        "; ",
        F.concat(F.lit("documentUrl: "), F.col("url_bounds.document_url.reason")),
        F.concat(F.lit("baseUri: "), F.col("url_bounds.base_uri.reason")),
    )
    rows.append(
        F.when(
            bounds != "",
            F.struct(
                F.lit("document.URL").alias("source"),
                bounds.alias("reason"),
                F.lit(None).cast("int").alias("omitted_count"),
            ),
        )
    )
    return facts.select(
        "page_id", F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull()))
    )


def pivot_evidence(rows: DataFrame) -> DataFrame:
    """Long evidence -> page_id and one state column per source; last row wins.

    rows(page_id, pos, source, state); the sources are listed, so no job is
    spent on finding them, and ``max_by`` combines on the map side."""
    sources = [s for s, _, _ in DOM_SOURCES]
    return rows.groupBy("page_id").pivot("source", sources).agg(F.max_by("state", "pos"))


def validate(facts: DataFrame, limits: CaptureLimits = DEFAULT_CAPTURE) -> DataFrame:
    """page_id, source, issue: facts that break the stored schema's bounds."""
    n = limits.string_chars

    def too_long(text: Column) -> Column:
        return F.coalesce(F.length(text) > n, F.lit(False))

    def any_long(items: Column, *parts: str) -> Column:
        return F.coalesce(
            F.exists(items, lambda x: F.greatest(*[too_long(x[p]) for p in (*parts, parts[0])])), F.lit(False)
        )

    def over(items: Column, cap: int) -> Column:
        return F.coalesce(F.size(items) > cap, F.lit(False))

    rules: list[tuple[str, str, Column]] = []
    for source, _, name in DOM_SOURCES:
        f = F.col(name)
        rules.append((source, "state: unknown", ~f["state"].isin("absent", "empty", "present", "duplicate", "malformed", "inaccessible")))
        rules.append((source, "raw: too long", too_long(f["raw"])))
        rules.append((source, "values: too many", over(f["values"], limits.meta_items)))
    for source, name in (("title", "title"), ("meta[name=description]", "meta_description"), ("html[lang]", "language"), ("meta[name=viewport]", "viewport")):
        f = F.col(name)
        rules.append((source, "value: missing", (f["state"] == "present") & f["value"].isNull()))
        rules.append((source, "values: too long", F.coalesce(F.exists(f["values"], too_long), F.lit(False))))
    alternates = F.col("alternates.value")
    rules.append(("link[rel=alternate][hreflang]", "value: too many", over(alternates, limits.alternate_items)))
    rules.append(("link[rel=alternate][hreflang]", "value: too long", any_long(alternates, "href", "absolute", "hreflang")))
    rules.append(("meta[property^=og:]", "value: too many", over(F.col("open_graph.value"), limits.meta_items)))
    rules.append(("meta[name^=twitter:]", "value: too many", over(F.col("twitter.value"), limits.meta_items)))
    rules.append(("a[href]", "inventory: too many", over(F.col("links.value.inventory"), limits.link_inventory)))
    rules.append(("a[href]", "inventory: too long", any_long(F.col("links.value.inventory"), "href", "absolute", "text")))
    rules.append(("img", "inventory: too many", over(F.col("images.value.inventory"), limits.image_inventory)))
    rules.append(("h1-h6", "samples: too long", any_long(F.col("headings.value.samples"), "text")))
    rules.append(("script[type=application/ld+json]", "value: too many", over(F.col("json_ld.value"), limits.jsonld_scripts)))
    hits = F.filter(
        F.array(
            *[
                F.when(cond, F.struct(F.lit(source).alias("source"), F.lit(issue).alias("issue")))
                for source, issue, cond in rules
            ]
        ),
        lambda r: r.isNotNull(),
    )
    return facts.select("page_id", "url", F.inline(hits))


def split_valid(
    facts: DataFrame, limits: CaptureLimits = DEFAULT_CAPTURE
) -> tuple[DataFrame, DataFrame]:
    """Valid facts, and capture errors for the rest."""
    issues = validate(facts, limits)
    errors = issues.groupBy("page_id", "url").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("source", F.lit(" "), "issue"))), "; ").alias("message")
    ).select(
        "page_id",
        F.lit("dom-evidence-invalid").alias("code"),
        F.lit("domCollector").alias("source"),
        "message",
        "url",
    )
    return facts.join(errors.select("page_id"), "page_id", "left_anti"), errors


def enforce_budget(facts: DataFrame, limits: CaptureLimits = DEFAULT_CAPTURE) -> DataFrame:
    """facts + over_budget; over it, JSON-LD text is dropped and marked truncated."""
    size = F.length(F.to_json(F.struct(*[f for _, _, f in DOM_SOURCES])))
    j = F.col("json_ld")
    emptied = j.withField(
        "value",
        F.transform(
            j["value"],
            lambda e: e.withField("raw", F.lit(""))
            .withField("truncated", F.lit(True))
            .withField("parse_status", F.lit("truncated")),
        ),
    ).withField(
        "limits",
        F.struct(
            F.lit(True).alias("truncated"),
            F.lit(f"Snapshot clipped to {limits.snapshot_chars} characters").alias("reason"),
            F.lit(None).cast("int").alias("omitted_count"),
        ),
    )
    staged = facts.withColumn("over_budget", size > limits.snapshot_chars)
    return staged.withColumn(
        "json_ld", F.when(F.col("over_budget") & (j["state"] == "present"), emptied).otherwise(j)
    )


def budget_errors(budgeted: DataFrame, limits: CaptureLimits = DEFAULT_CAPTURE) -> DataFrame:
    return budgeted.filter("over_budget").select(
        "page_id",
        F.lit("snapshot-budget").alias("code"),
        F.lit("domCollector").alias("source"),
        F.lit(f"Page snapshot exceeded {limits.snapshot_chars} characters; oversized evidence was clipped.").alias("message"),
        "url",
    )


# -- readable summaries -----------------------------------------------------------


def _state_label(f: Column) -> Column:
    return (
        F.when(f.isNull(), "—")
        .when(f["state"] == "absent", "(absent)")
        .when(f["state"] == "empty", "(empty)")
        .when(f["state"] == "inaccessible", F.concat(F.lit("(unavailable: "), f["detail"], F.lit(")")))
        .when(f["state"] == "malformed", F.concat(F.lit("(malformed: "), f["detail"], F.lit(")")))
        .when(f["state"] == "duplicate", F.concat(F.lit("("), f["count"].cast("string"), F.lit(" values)")))
    )


def glance(evidence: DataFrame) -> DataFrame:
    """Overview row per page from the joined page evidence."""
    robots = F.col("meta_robots")
    contents = F.filter(F.transform(robots["values"], lambda v: v["content"]), lambda c: c != "")
    levels = F.col("headings.value.levels")
    observed = F.coalesce("nav_observed", F.lit(False))
    crawled = F.col("robots_blocked").isNotNull()
    return evidence.select(
        "page_id",
        "document_url",
        F.coalesce(_state_label(F.col("title")), F.col("title.value")).alias("title"),
        F.coalesce(_state_label(F.col("meta_description")), F.col("meta_description.value")).alias("description"),
        F.coalesce(_state_label(F.col("canonical")), F.col("canonical.value.absolute")).alias("canonical"),
        F.when(robots["state"] == "present", robots["value"]["content"])
        .when(robots["state"] == "duplicate", F.array_join(contents, " | "))
        .otherwise(_state_label(robots))
        .alias("meta_robots"),
        F.when(observed, F.coalesce("nav_x_robots_tag", F.lit("(absent)"))).otherwise("unavailable").alias("x_robots_tag"),
        F.when(crawled, F.when(F.col("robots_blocked"), "blocked").otherwise("allowed")).otherwise("not fetched").alias("robots_txt"),
        F.col("nav_status").alias("status_code"),
        F.when(observed, F.coalesce("hop_count", F.lit(0))).alias("hops"),
        *[levels[h].alias(h) for h in HEADINGS],
        F.col("links.value.total").alias("links"),
        F.col("images.value.total").alias("images"),
        F.col("html5.value.landmark_total").alias("landmarks"),
        F.when(observed | crawled, "signals-partial").otherwise("unknown").alias("indexability"),
    )


def _value_text(source: str, f: Column) -> Column:
    v = f["value"]

    def text(c: Column) -> Column:
        return c.cast("string")

    if source == "link[rel=canonical]":
        return F.coalesce(v["absolute"], v["href"])
    if source == "meta[name=robots|googlebot]":
        return v["content"]
    if source == "h1-h6":
        parts = F.filter(
            F.array(*[F.when(v["levels"][h] > 0, F.concat(F.lit(f"{h.upper()}: "), text(v["levels"][h]))) for h in HEADINGS]),
            lambda x: x.isNotNull(),
        )
        return F.when(F.size(parts) > 0, F.array_join(parts, " · ")).otherwise("No headings")
    if source == "a[href]":
        return F.concat(
            F.lit("total "), text(v["total"]), F.lit("; internal "), text(v["internal"]),
            F.lit("; external "), text(v["external"]), F.lit("; other "), text(v["other"]),
        )
    if source == "img":
        return F.concat(
            F.lit("total "), text(v["total"]), F.lit("; alt present "), text(v["with_alt"]),
            F.lit("; empty "), text(v["empty_alt"]), F.lit("; missing "), text(v["missing_alt"]),
        )
    return compact(v)


def field_summary(source: str, f: Column) -> Column:
    """One line that says what a field held, or that it was not captured."""
    clipped = f["limits"]["reason"]
    return (
        F.when(f.isNull(), "Not part of this audit.")
        .when(f["state"] == "absent", "(absent)")
        .when(f["state"] == "empty", "(empty)")
        .when(f["state"] == "inaccessible", F.concat(F.lit("Unreadable: "), f["detail"]))
        .when(f["state"] == "malformed", F.concat(F.lit("Malformed: "), f["detail"]))
        .when(
            f["state"] == "duplicate",
            F.concat(f["count"].cast("string"), F.lit(" values"), F.coalesce(F.concat(F.lit("; cut: "), clipped), F.lit(""))),
        )
        .otherwise(
            F.concat(
                _value_text(source, f),
                F.coalesce(F.concat(F.lit(" (truncated: "), clipped, F.lit(")")), F.lit("")),
            )
        )
    )


def report_facts(facts: DataFrame) -> DataFrame:
    """page_id, pos, label, value, source: the fixed list of page facts."""
    names = {s: f for s, _, f in DOM_SOURCES}
    rows = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(label).alias("label"),
            field_summary(source, F.col(names[source])).alias("value"),
            F.lit(source).alias("source"),
        )
        for i, (source, label) in enumerate(REPORT_FACTS)
    ]
    return facts.select("page_id", F.inline(F.array(*rows)))


def finding_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings with their evidence summaries, missing ones named as missing.

    findings(page_id, finding_id, evidence_ids), evidence(page_id, evidence_id,
    source, value) -> one row per finding and evidence id, in order."""
    wanted = findings.select(
        "page_id", "finding_id", F.posexplode_outer("evidence_ids").alias("pos", "evidence_id")
    )
    return wanted.join(
        evidence.select("page_id", "evidence_id", "source", "state"), ["page_id", "evidence_id"], "left"
    ).select(
        "page_id",
        "finding_id",
        "pos",
        F.coalesce("source", "evidence_id").alias("source"),
        F.when(
            F.col("source").isNull() & F.col("evidence_id").isNotNull(),
            "The evidence it names is not in this session.",
        )
        .otherwise(F.col("state"))
        .alias("summary"),
    )
