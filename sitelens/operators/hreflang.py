"""hreflang: directive findings per page, source mismatches, cluster reciprocity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.codes import hreflang_verdict
from sitelens.functions.expr import browser_trim, slug
from sitelens.functions.urls import grouping_url, is_relative_href, parse_url
from sitelens.session import cut_lineage

# Rule -> severity.
CLUSTER_RULES = {
    "hreflang-cluster-duplicate-alternate": "error",
    "hreflang-cluster-invalid-language": "error",
    "hreflang-cluster-likely-typo": "warning",
    "hreflang-cluster-missing-self-ref": "error",
    "hreflang-cluster-missing-return": "error",
}


def page_keys(df: DataFrame) -> list[str]:
    return [c for c in ("page_id", "url") if c in df.columns]


def html_alternates(facts: DataFrame) -> DataFrame:
    """page_id, url, source, pos, hreflang (lower case), href, absolute."""
    keys = page_keys(facts)
    return facts.select(*keys, F.posexplode("alternates.value").alias("pos", "a")).select(
        *keys,
        F.lit("HTML").alias("source"),
        "pos",
        F.lower("a.hreflang").alias("hreflang"),
        "a.href",
        "a.absolute",
    )


def sitemap_alternates(membership: DataFrame) -> DataFrame:
    keys = page_keys(membership)
    return membership.select(
        *keys, F.posexplode("sitemap_alternates").alias("pos", "a")
    ).select(
        *keys,
        F.lit("sitemap").alias("source"),
        "pos",
        F.lower("a.hreflang").alias("hreflang"),
        "a.href",
        F.lit(None).cast("string").alias("absolute"),
    )


def duplicates(alternates: DataFrame) -> DataFrame:
    """page_id, source, hreflang, n for codes declared more than once."""
    return (
        alternates.groupBy(*page_keys(alternates), "source", "hreflang")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )


def source_mismatches(html: DataFrame, sitemap: DataFrame) -> DataFrame:
    """HTML alternates whose target differs from the sitemap's for the same code.

    The first sitemap entry per code counts; every HTML entry is compared."""
    first = sitemap.groupBy("page_id", "hreflang").agg(
        F.min_by("href", "pos").alias("sitemap_href")
    )
    return (
        html.select(*page_keys(html), "pos", "hreflang", F.coalesce("absolute", "href").alias("html_href"))
        .join(first, ["page_id", "hreflang"])
        .filter(grouping_url(F.col("html_href")) != grouping_url(F.col("sitemap_href")))
    )


def directive_findings(alternates: DataFrame, mismatches: DataFrame) -> DataFrame:
    """page_id, rule_id, source, hreflang, href, detail."""

    keys = page_keys(alternates)

    def rows(df: DataFrame, rule: str, detail: Column) -> DataFrame:
        return df.select(
            *keys, F.lit(rule).alias("rule_id"), "source", "hreflang", "href", detail.alias("detail")
        )

    judged = alternates.withColumn("v", hreflang_verdict(F.col("hreflang")))
    blank = browser_trim(F.col("href")) == ""
    relative = (F.col("source") == "HTML") & is_relative_href(F.col("href"))
    per_item = judged.select(
        *keys,
        "source",
        "hreflang",
        "href",
        F.explode(
            F.filter(
                F.array(
                    F.when(
                        ~F.col("v.valid"),
                        F.struct(
                            F.when(F.col("v.typo").isNotNull(), "hreflang-likely-typo")
                            .otherwise("hreflang-invalid-language")
                            .alias("rule_id"),
                            F.coalesce("v.typo", "v.reason").alias("detail"),
                        ),
                    ),
                    F.when(
                        blank,
                        F.struct(F.lit("hreflang-empty-href").alias("rule_id"), F.lit("").alias("detail")),
                    ).when(
                        relative,
                        F.struct(
                            F.lit("hreflang-relative-url").alias("rule_id"), F.col("href").alias("detail")
                        ),
                    ),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("f"),
    ).select(*keys, "f.rule_id", "source", "hreflang", "href", "f.detail")
    repeated = rows(
        duplicates(alternates).withColumn("href", F.lit(None).cast("string")),
        "hreflang-duplicate-alternate",
        F.col("n").cast("string"),
    )
    differing = rows(
        mismatches.withColumn("source", F.lit("HTML")).withColumnRenamed("html_href", "href"),
        "hreflang-html-sitemap-mismatch",
        F.col("sitemap_href"),
    )
    return per_item.unionByName(repeated).unionByName(differing)


def directive_finding_id(f: DataFrame) -> DataFrame:
    """Adds the stable finding id of a directive finding."""
    part = slug(F.col("hreflang"))
    evidence = F.when(F.col("source") == "HTML", "alternates-0").otherwise("sitemap-hreflang-0")
    name = F.regexp_replace("rule_id", "-alternate$", "")
    with_source = ~F.col("rule_id").isin("hreflang-relative-url", "hreflang-html-sitemap-mismatch")
    return f.withColumn(
        "finding_id",
        F.concat_ws("-", name, F.when(with_source, F.col("source")), part, evidence),
    )


def page_edges(structure: DataFrame) -> DataFrame:
    """Page structure -> page_id, pos, hreflang, href: usable alternates as edges.

    Blank codes or targets are skipped; a target that does not resolve stays raw."""
    alternates = F.filter("_rels", lambda r: r["rel"] == "alternate")
    code, href = F.lower(browser_trim(F.col("r.hreflang"))), browser_trim(F.col("r.href"))
    return (
        structure.select("page_id", F.posexplode(alternates).alias("pos", "r"))
        .select("page_id", "pos", code.alias("hreflang"), F.coalesce("r.absolute", href).alias("href"), href.alias("_raw"))
        .filter("hreflang <> '' AND _raw <> ''")
        .drop("_raw")
    )


# -- clusters -----------------------------------------------------------------


def cluster_targets(alternates: DataFrame) -> DataFrame:
    """Work list of a cluster: one row per distinct target, first declaration wins.

    alternates(cluster_id, pos, hreflang, href) -> cluster_id, hreflang,
    requested_url, target, pos."""
    href = browser_trim(F.col("href"))
    usable = alternates.withColumn("href", href).filter("href <> ''")
    normal = usable.withColumn("u", parse_url(F.col("href"))).filter("u IS NOT NULL")
    return (
        normal.withColumn("target", grouping_url(F.col("u.href")))
        .groupBy("cluster_id", "target")
        .agg(
            F.min_by(F.struct(F.lower(browser_trim(F.col("hreflang"))).alias("hreflang"), "href"), "pos").alias("t"),
            F.min("pos").alias("pos"),
        )
        .select("cluster_id", "t.hreflang", F.col("t.href").alias("requested_url"), "target", "pos")
    )


def first_targets(targets: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` targets per cluster, with a flag that more exist."""
    w = Window.partitionBy("cluster_id").orderBy("pos")
    ranked = targets.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap + 1)
    hit = F.max("n").over(Window.partitionBy("cluster_id")) > cap
    return ranked.withColumn("cap_hit", hit).filter(F.col("n") <= cap)


def _label(df: DataFrame) -> Column:
    return F.coalesce("final_url", "requested_url")


#: Parts that members of a cluster are numbered in, and most targets that one row is exploded to.
PARTS, RUN = 64, 10_000


def _numbered(targets: DataFrame) -> DataFrame:
    """targets + ``n``: a number from 0 within the cluster, in no particular order.

    Counted in hashed parts with offsets, so a large cluster is not one task's work."""
    part = F.pmod(F.xxhash64("other_id"), F.lit(PARTS))
    rows = targets.withColumn("_part", part)
    counts = rows.groupBy("cluster_id", "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("cluster_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("cluster_id", "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("cluster_id", "_part").orderBy("other_id")) - 1
    return rows.withColumn("_own", own).join(starts, ["cluster_id", "_part"]).withColumn("n", F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def deficit_groups(targets: DataFrame, returns: DataFrame, short: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who lacks which returns, without a row for each pair: (membership, lacking).

    targets(cluster_id, other_id, ...) are what each member owes a return, returns(cluster_id,
    member_id, other_id) who returns to whom, own page left out, short(cluster_id, member_id, ...) the members that
    fall short.  Members that return to the same targets make a group, named by its smallest
    member: membership is short + group_id, lacking is targets' rows + group_id for each target that
    no member of the group returns to.  A pair is missing if its member's group lacks the target
    and the target is not the member's own page; ``missing_pairs`` writes them out.

    A group is known by the count and two sums of hashes of its targets.  What it lacks are the gaps
    between the numbers of those it has, so work grows with the declared links and the result,
    never with the square of a cluster."""
    marked = returns.groupBy("cluster_id", "member_id").agg(
        F.count("*").alias("_k"),
        F.sum(F.xxhash64("other_id").cast("decimal(38,0)")).alias("_h"),
        F.sum(F.xxhash64(F.lit("second"), "other_id").cast("decimal(38,0)")).alias("_g"),
    )
    zero = F.lit(0).cast("decimal(38,0)")
    known = short.join(marked, ["cluster_id", "member_id"], "left").withColumns(
        {"_k": F.coalesce("_k", F.lit(0)), "_h": F.coalesce("_h", zero), "_g": F.coalesce("_g", zero)}
    )
    groups = known.groupBy("cluster_id", "_k", "_h", "_g").agg(F.min("member_id").alias("group_id"))
    groups = cut_lineage(groups, "groups")
    membership = known.join(groups, ["cluster_id", "_k", "_h", "_g"]).drop("_k", "_h", "_g")
    placed = cut_lineage(_numbered(targets), "targets")
    sizes = placed.groupBy("cluster_id").agg(F.count("*").alias("n"))
    # What a group's smallest member returns to, and one place past the end.
    named = groups.select("cluster_id", "group_id")
    has = (
        named.join(returns.withColumnRenamed("member_id", "group_id"), ["cluster_id", "group_id"])
        .join(placed.select("cluster_id", "other_id", "n"), ["cluster_id", "other_id"])
        .select("cluster_id", "group_id", "n")
        .unionByName(named.join(sizes, "cluster_id"))
    )
    previous = F.coalesce(F.lag("n").over(Window.partitionBy("cluster_id", "group_id").orderBy("n")), F.lit(-1))
    gaps = has.withColumn("low", previous + 1).filter("low < n")
    runs = gaps.select("cluster_id", "group_id", "n", F.explode(F.sequence("low", F.col("n") - 1, F.lit(RUN).cast("long"))).alias("low"))
    places = runs.select(
        "cluster_id", "group_id", F.explode(F.sequence("low", F.least(F.col("n"), F.col("low") + RUN) - 1)).alias("n")
    )
    return membership, places.join(placed, ["cluster_id", "n"]).drop("n")


def missing_pairs(membership: DataFrame, lacking: DataFrame) -> DataFrame:
    """Every missing return as a row: for clusters that are small enough to be read that way."""
    return membership.join(lacking, ["cluster_id", "group_id"]).filter("other_url <> requested_url")


def cluster_findings(members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reciprocity among fetched members of each cluster: (findings, membership, lacking).

    members(cluster_id, member_id, hreflang, requested_url, final_url) are the
    fetched ones; edges(cluster_id, member_id, hreflang, href) what each declares.

    A member must reference itself and every other member.  The members that
    *are* referenced come from one equi join of declarations with members; what
    is missing is counted by comparing against the cluster's size.  A member that falls short has
    one finding with the exact number and its deficit group; membership and lacking name every
    missing return (``deficit_groups``), at every size."""
    # Both are read by every rule below, so they are stored normalised.
    normal = members.select(
        "cluster_id",
        "member_id",
        F.lower("hreflang").alias("hreflang"),
        "requested_url",
        "final_url",
        grouping_url(F.col("final_url")).alias("norm"),
        _label(members).alias("affected_url"),
    )
    m = cut_lineage(normal, "members")
    declared_links = edges.select(
        "cluster_id", "member_id", F.lower("hreflang").alias("hreflang"), grouping_url(F.col("href")).alias("norm")
    )
    e = cut_lineage(declared_links, "edges")
    codes = e.groupBy("cluster_id", "member_id", "hreflang").agg(F.count("*").alias("n"))
    label = m.select("cluster_id", "member_id", "affected_url")
    repeated = (
        codes.filter("n > 1")
        .join(label, ["cluster_id", "member_id"])
        .select(
            "cluster_id",
            "member_id",
            F.lit("hreflang-cluster-duplicate-alternate").alias("rule_id"),
            "affected_url",
            F.col("hreflang").alias("detail"),
        )
    )
    v = hreflang_verdict(F.col("hreflang"))
    invalid = (
        e.select("cluster_id", "member_id", "hreflang", v.alias("v"))
        .filter("NOT v.valid")
        .join(label, ["cluster_id", "member_id"])
        .select(
            "cluster_id",
            "member_id",
            F.when(F.col("v.typo").isNotNull(), "hreflang-cluster-likely-typo")
            .otherwise("hreflang-cluster-invalid-language")
            .alias("rule_id"),
            "affected_url",
            F.col("hreflang").alias("detail"),
        )
    )
    declared = e.select("cluster_id", "member_id", "hreflang", "norm").distinct()
    met = declared.join(
        m.filter("norm IS NOT NULL").select(
            "cluster_id", F.col("member_id").alias("other_id"), "hreflang", "norm",
            F.col("requested_url").alias("other_url"),
        ),
        ["cluster_id", "hreflang", "norm"],
    ).select("cluster_id", "member_id", "other_id", "other_url").distinct()
    returns = cut_lineage(met, "returns")
    own = returns.filter("member_id = other_id").select("cluster_id", "member_id")
    missing_self = (
        m.filter("norm IS NOT NULL")
        .join(own, ["cluster_id", "member_id"], "left_anti")
        .select(
            "cluster_id",
            "member_id",
            F.lit("hreflang-cluster-missing-self-ref").alias("rule_id"),
            "affected_url",
            F.col("hreflang").alias("detail"),
        )
    )
    # Members with the same requested URL are one page and owe no return.
    size = m.filter("norm IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("size"))
    same = m.filter("norm IS NOT NULL").groupBy("cluster_id", "requested_url").agg(F.count("*").alias("same"))
    given = (
        returns.join(m.select("cluster_id", "member_id", "requested_url"), ["cluster_id", "member_id"])
        .filter("other_url <> requested_url")
        .select("cluster_id", "member_id", "other_id")
    )
    held = given.groupBy("cluster_id", "member_id").agg(F.count("*").alias("held"))
    short = (
        m.join(size, "cluster_id")
        .join(same, ["cluster_id", "requested_url"], "left")
        .join(held, ["cluster_id", "member_id"], "left")
        .filter(F.coalesce("held", F.lit(0)) < F.col("size") - F.coalesce("same", F.lit(0)))
        .withColumn("owed", F.col("size") - F.coalesce("same", F.lit(0)))
        .select(
            "cluster_id",
            "member_id",
            "requested_url",
            "affected_url",
            "size",
            "owed",
            (F.col("owed") - F.coalesce("held", F.lit(0))).alias("lacking"),
        )
    )
    targets = m.filter("norm IS NOT NULL").select(
        "cluster_id",
        F.col("member_id").alias("other_id"),
        F.col("hreflang").alias("other_lang"),
        F.col("final_url").alias("other_final"),
        F.col("requested_url").alias("other_url"),
    )
    membership, lacking = deficit_groups(targets, given, cut_lineage(short, "short"))
    membership = cut_lineage(membership, "membership")
    counted = membership.select(
        "cluster_id",
        "member_id",
        F.lit("hreflang-cluster-missing-return").alias("rule_id"),
        "affected_url",
        F.concat(F.col("lacking").cast("string"), F.lit(" of "), F.col("owed").cast("string"), F.lit(" members, as "), F.col("group_id").cast("string")).alias("detail"),
    )
    found = repeated.unionByName(invalid).unionByName(missing_self).unionByName(counted)
    severity = F.create_map(*[F.lit(x) for kv in CLUSTER_RULES.items() for x in kv])
    return found.withColumn("severity", severity[F.col("rule_id")]), membership, lacking
