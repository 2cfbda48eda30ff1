"""Comparisons of captures: URL variants, soft-404 probes, two renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import html as H
from sitelens.functions.expr import clip, let
from sitelens.functions.headers import canonical_from_link, is_success
from sitelens.functions.urls import grouping_url, parse_url, url_variants
from sitelens.operators.facts import page_facts

# Soft-404 thresholds.
SIMILAR, SHELL_SIMILAR, RATIO_MIN, RATIO_MAX = 0.85, 0.6, 0.8, 1.2
FINGERPRINT_SAMPLE = 200


# -- URL variants ---------------------------------------------------------------


def variant_targets(urls: DataFrame, cap: int | None = None) -> DataFrame:
    """base(url) -> base_url, kind, label, url: distinct variants in URL order.

    With ``cap`` only the first ones, plus ``cap_hit``; a URL has nine variants
    at most, so ranking them inside the row needs no shuffle."""
    made = F.array_sort(
        F.transform(
            url_variants(F.col("url")),
            lambda v: F.struct(
                v["url"].alias("url"), v["pos"].alias("pos"), v["kind"].alias("kind"), v["label"].alias("label")
            ),
        )
    )
    first = F.filter(
        F.col("_v"),
        lambda v, i: (i == 0)
        | (F.try_element_at(F.col("_v"), F.greatest(i, F.lit(1)))["url"] != v["url"]),
    )
    staged = urls.select("url", made.alias("_v")).select("url", first.alias("_d"))
    shown = F.col("_d") if cap is None else F.slice("_d", 1, cap)
    hit = F.lit(False) if cap is None else F.size("_d") > cap
    return staged.select(
        F.col("url").alias("base_url"), hit.alias("cap_hit"), F.explode(shown).alias("v")
    ).select("base_url", "v.kind", "v.label", F.col("v.url").alias("url"), "cap_hit")


def _landed(results: DataFrame) -> DataFrame:
    return results.filter("final_url IS NOT NULL AND fetch_error IS NULL").withColumn(
        "target", grouping_url(F.col("final_url"))
    )


def variant_groups(results: DataFrame) -> DataFrame:
    """base_url, target, members, statuses: outcomes by normalised final URL."""
    return _landed(results).groupBy("base_url", "target").agg(
        F.count("*").alias("members"),
        F.array_sort(F.collect_set("status")).alias("statuses"),
        F.array_sort(F.collect_list("request_url")).alias("request_urls"),
    )


def variant_observations(results: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """base_url, kind, subject: inconsistent-finals, mixed-status, canonical-mismatch."""
    groups = variant_groups(results) if groups is None else groups
    finals = (
        groups.groupBy("base_url")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("base_url", F.lit("inconsistent-finals").alias("kind"), F.col("n").cast("string").alias("subject"))
    )
    mixed = groups.filter(F.size("statuses") > 1).select(
        "base_url", F.lit("mixed-status").alias("kind"), F.col("target").alias("subject")
    )
    named = _landed(results).withColumn("canonical", canonical_from_link(F.col("link")))
    canon = (
        named.filter("canonical IS NOT NULL")
        .groupBy("base_url")
        .agg(F.count_distinct(grouping_url(F.col("canonical"))).alias("n"))
        .filter("n > 1")
        .select("base_url", F.lit("canonical-mismatch").alias("kind"), F.col("n").cast("string").alias("subject"))
    )
    return finals.unionByName(mixed).unionByName(canon)


# -- soft 404 -------------------------------------------------------------------


def fingerprints(captures: DataFrame, max_chars: int | None = None) -> DataFrame:
    """captures(…, body) -> the same rows with title, text hash and token set.

    The whole text is used; ``max_chars`` limits it to a prefix for results
    comparable with a browser session."""
    text = H.plain_text(F.coalesce("body", F.lit("")))
    if max_chars is not None:
        text = clip(text, max_chars)
    keep = [c for c in captures.columns if c != "body"]
    usable = F.col("fetch_error").isNull()
    return captures.select(*keep, H.title_text(F.col("body")).alias("_title"), text.alias("_text")).select(
        *keep,
        F.when(usable, F.col("_title")).alias("title"),
        F.when(usable & (F.col("_text") != ""), F.xxhash64("_text")).alias("text_hash"),
        F.when(usable & (F.col("_text") != ""), H.similarity_tokens(F.col("_text"))).alias("tokens"),
    )


def soft404_pairs(captures: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Probe ⋈ audited capture by pair, same origin, both fetched."""
    prints = fingerprints(captures, max_chars)
    cols = ["requested_url", "final_url", "status", "fetch_error", "body_bytes", "title", "text_hash", "tokens"]

    def side(role: str) -> DataFrame:
        return prints.filter(F.col("role") == role).select(
            "pair_id", F.struct(*cols).alias(role)
        )

    origin = parse_url(F.col("audited.requested_url"))["origin"]
    return (
        side("audited")
        .join(side("probe"), "pair_id")
        .filter("audited.fetch_error IS NULL AND probe.fetch_error IS NULL")
        .withColumn("origin", origin)
        .filter(F.col("origin") == parse_url(F.col("probe.requested_url"))["origin"])
    )


def soft404_observations(pairs: DataFrame) -> DataFrame:
    """pair_id, kind, similarity: what suggests the probe was a soft 404.

    Observations, not verdicts; only a successful probe gives any."""
    p, a = F.col("probe"), F.col("audited")
    similarity = F.when(
        p["tokens"].isNotNull() & a["tokens"].isNotNull(), H.jaccard(p["tokens"], a["tokens"])
    ).otherwise(0.0)
    ratio = F.when(a["body_bytes"] > 0, p["body_bytes"] / a["body_bytes"])
    final, asked = parse_url(p["final_url"]), parse_url(p["requested_url"])
    home = let(
        F.struct(final.alias("f"), asked.alias("r")),
        lambda s: F.coalesce(
            (s["r"]["path"] != "/") & (s["f"]["path"] == "/") & (s["f"]["origin"] == F.col("origin")),
            F.lit(False),
        ),
    )
    staged = pairs.filter(is_success(p["status"])).select(
        "pair_id",
        "origin",
        "probe",
        "audited",
        similarity.alias("similarity"),
        ratio.alias("ratio"),
    )
    sim, rat = F.col("similarity"), F.col("ratio")
    kinds = F.array(
        F.when(
            (p["text_hash"] == a["text_hash"]) & (p["body_bytes"] > 0), "identical-body-hash"
        ),
        F.when(sim >= SIMILAR, "similar-content"),
        F.when(rat.between(RATIO_MIN, RATIO_MAX) & (sim >= SHELL_SIMILAR), "spa-fallback"),
        F.when(home, "redirect-to-home"),
        F.when(H.looks_like_error_title(p["title"]), "error-template-title"),
    )
    return staged.select(
        "pair_id",
        F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"),
        "similarity",
    ).withColumn("rule_id", F.lit("soft-404-possible"))


# -- two renderings ---------------------------------------------------------------


def visible_text(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """page keys, char_count, hash, sample, truncated of the page's plain text."""
    keys = [c for c in pages.columns if c != "html"]
    text = H.plain_text(F.col("html"))
    staged = pages.select(*keys, text.alias("_t"))
    kept = F.col("_t") if max_chars is None else clip(F.col("_t"), max_chars)
    cut = F.lit(False) if max_chars is None else F.length("_t") > max_chars
    return staged.select(
        *keys,
        F.length(kept).alias("char_count"),
        H.fnv1a(kept).alias("hash"),
        F.substring(kept, 1, FINGERPRINT_SAMPLE).alias("sample"),
        cut.alias("truncated"),
    )


def _describe_text(f: Column) -> Column:
    return (
        F.when(f["state"] == "absent", "(absent)")
        .when(f["state"] == "empty", "(empty)")
        .when(f["state"] == "inaccessible", F.concat(F.lit("(inaccessible: "), f["detail"], F.lit(")")))
        .when(f["state"] == "malformed", F.concat(F.lit("(malformed: "), f["raw"], F.lit(")")))
        .when(f["state"] == "duplicate", F.concat(F.lit("(duplicate ×"), f["count"].cast("string"), F.lit(")")))
    )


def field_descriptions() -> dict[str, Column]:
    """One comparable line per field of a facts row."""
    canonical = F.col("canonical")
    target = canonical["value"]
    levels = F.col("headings.value.levels")
    heads = F.filter(
        F.array(
            *[
                F.when(levels[n] > 0, F.concat(F.lit(f"{n}:"), levels[n].cast("string")))
                for n in H.HEADINGS
            ]
        ),
        lambda x: x.isNotNull(),
    )
    link = F.col("links.value")

    def count(status: str) -> Column:
        return F.size(F.filter("json_ld.value", lambda e: e["parse_status"] == status)).cast("string")

    return {
        "title": F.coalesce(_describe_text(F.col("title")), F.col("title.value")),
        "meta_description": F.coalesce(
            _describe_text(F.col("meta_description")), F.col("meta_description.value")
        ),
        "canonical": F.coalesce(_describe_text(canonical), target["absolute"], target["href"]),
        "headings": F.when(F.size(heads) > 0, F.array_join(heads, " ")).otherwise("(no headings)"),
        "links": F.concat(
            F.lit("total:"), link["total"].cast("string"), F.lit(" internal:"), link["internal"].cast("string"),
            F.lit(" external:"), link["external"].cast("string"), F.lit(" other:"), link["other"].cast("string"),
        ),
        "json_ld": F.when(F.col("json_ld.state") == "absent", "(absent)").otherwise(
            F.concat(
                F.lit("count:"), F.col("json_ld.count").cast("string"), F.lit(" ok:"), count("ok"),
                F.lit(" invalid:"), count("invalid-json"), F.lit(" empty:"), count("empty"),
                F.lit(" truncated:"), count("truncated"),
            )
        ),
    }


DIFF_KINDS = {
    "title": "title-changed",
    "meta_description": "meta-description-changed",
    "canonical": "canonical-changed",
    "headings": "headings-changed",
    "links": "links-changed",
    "json_ld": "jsonld-changed",
    "visible_text": "visible-text-changed",
}


def describe_renders(renders: DataFrame) -> DataFrame:
    """renders(page_id, role, url, html) -> page_id, role, one description per field."""
    facts = page_facts(renders).select(
        "page_id", "role", *[c.alias(n) for n, c in field_descriptions().items()],
        F.col("links.value.total").alias("links_total"),
    )
    text = visible_text(renders.select("page_id", "role", "html")).select(
        "page_id",
        "role",
        F.concat(F.col("char_count").cast("string"), F.lit(" chars, hash "), "hash").alias("visible_text"),
        "char_count",
    )
    return facts.join(text, ["page_id", "role"])


def render_diffs(descriptions: DataFrame) -> DataFrame:
    """page_id, field, baseline, experiment, changed: seven rows per page.

    Baseline and experiment meet in one aggregate per page, not in a join."""
    fields = list(DIFF_KINDS)

    def pick(role: str, name: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(name))).alias(f"{role}_{name}")

    wide = descriptions.groupBy("page_id").agg(
        *[pick(r, n) for r in ("baseline", "experiment") for n in (*fields, "links_total", "char_count")],
        F.count_distinct("role").alias("roles"),
    )
    deltas = {
        "links": F.col("experiment_links_total") - F.col("baseline_links_total"),
        "visible_text": F.col("experiment_char_count") - F.col("baseline_char_count"),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("field"),
                F.col(f"baseline_{n}").alias("baseline"),
                F.col(f"experiment_{n}").alias("experiment"),
                (~F.col(f"baseline_{n}").eqNullSafe(F.col(f"experiment_{n}"))).alias("changed"),
                deltas.get(n, F.lit(None)).cast("int").alias("delta"),
            )
            for n in fields
        ]
    )
    return wide.filter("roles = 2").select("page_id", F.inline(rows))


def render_observations(diffs: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in DIFF_KINDS.items() for x in kv])
    return diffs.filter("changed").select(
        "page_id", kinds[F.col("field")].alias("kind"), "baseline", "experiment", "delta"
    )
