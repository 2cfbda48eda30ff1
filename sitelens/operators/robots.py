"""robots.txt: admission, corpus parsing, and evaluation of pages against rules.

Parsing explodes every file into lines and numbers the user-agent groups with
windows.  The windows are keyed by file *and* read only directive lines, so a
task holds one file's directives, which the admission byte limit bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.expr import browser_trim
from sitelens.functions.headers import looks_like_html
from sitelens.functions.urls import parse_url
from sitelens.limits import DEFAULT_ROBOTS, RobotsLimits
from sitelens.session import cut_lineage

# Fixed values.
PROFILES = ("Googlebot", "*")
KNOWN_DIRECTIVES = ("user-agent", "allow", "disallow", "sitemap")


def admission_error(limits: RobotsLimits = DEFAULT_ROBOTS) -> Column:
    """Why a captured robots.txt may not be parsed; NULL when it may."""
    too_big = F.coalesce(F.col("truncated"), F.lit(False))
    if limits.body_bytes is not None:
        too_big = too_big | (F.octet_length(F.coalesce(F.col("body"), F.lit(""))) > limits.body_bytes)
    return (
        F.when(F.col("fetch_error").isNotNull(), "robots-fetch-failed")
        .when(~F.col("status").eqNullSafe(200), "robots-fetch-non-200")
        .when(too_big, "robots-fetch-oversized")
        .when(
            looks_like_html(F.col("content_type"), F.coalesce(F.col("body"), F.lit(""))),
            "robots-fetch-html",
        )
    )


def admit(robots_files: DataFrame, limits: RobotsLimits = DEFAULT_ROBOTS) -> DataFrame:
    """robots_files + error_code; NULL rows feed the parser, the rest are capture errors."""
    return robots_files.withColumn("error_code", admission_error(limits))


def robots_lines(robots_files: DataFrame, limits: RobotsLimits = DEFAULT_ROBOTS) -> DataFrame:
    """Admitted files -> one row per meaningful line, split into name and value."""
    ok = admit(robots_files, limits).filter(F.col("error_code").isNull())
    lines = ok.select(
        "origin", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\r?\n")).alias("i", "line")
    )
    if limits.lines is not None:
        lines = lines.filter(F.col("i") < limits.lines)
    text = browser_trim(F.regexp_replace("line", "(?s)#.*$", ""))
    parsed = lines.select("origin", (F.col("i") + 1).alias("line_number"), text.alias("text")).filter(
        "text <> ''"
    )
    has_name = F.col("text").rlike(r"^[^:]*[^:\s][^:]*:")
    return parsed.select(
        "origin",
        "line_number",
        "text",
        F.when(has_name, browser_trim(F.substring_index("text", ":", 1))).alias("name"),
        F.when(has_name, browser_trim(F.regexp_extract("text", r"(?s)^[^:]*:(.*)$", 1))).alias("value"),
    )


def _directives(lines: DataFrame) -> DataFrame:
    """Directive lines with a running group number.

    A user-agent line opens a group unless it directly continues a run of
    user-agent lines; a rule before any user-agent opens an implicit one."""
    kind = F.lower("name")
    d = lines.filter(
        kind.isin("allow", "disallow") | ((kind == "user-agent") & (F.col("value") != ""))
    ).withColumn("kind", kind)
    order = Window.partitionBy("origin").orderBy("line_number")
    previous = F.lag("kind").over(order)
    opens = previous.isNull() | ((F.col("kind") == "user-agent") & (previous != "user-agent"))
    return (
        d.withColumn("opens", opens.cast("int"))
        .withColumn("group_no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        .withColumn(
            "implicit",
            (F.col("kind") != "user-agent") & previous.isNull(),
        )
    )


def robots_groups(robots_files: DataFrame, limits: RobotsLimits = DEFAULT_ROBOTS) -> DataFrame:
    """Directive lines of admitted files with ``group_no`` (0-based per file)."""
    return _directives(robots_lines(robots_files, limits))


def robots_agents(groups: DataFrame) -> DataFrame:
    """origin, group_no, user_agent: the agents each group is written for.

    Rules ahead of any user-agent form group 0 for ``*``; user-agent lines
    that follow such rules open the next group."""
    named = groups.filter("kind = 'user-agent'").select(
        "origin", "group_no", F.col("value").alias("user_agent")
    )
    implicit = groups.filter("implicit").select("origin", "group_no", F.lit("*").alias("user_agent"))
    return named.unionByName(implicit)


def robots_rules(groups: DataFrame) -> DataFrame:
    return groups.filter("kind <> 'user-agent'").select(
        "origin", "group_no", "kind", F.col("value").alias("pattern"), "line_number"
    )


def robots_sitemaps(lines: DataFrame) -> DataFrame:
    return lines.filter((F.lower("name") == "sitemap") & (F.col("value") != "")).select(
        "origin", "line_number", F.col("value").alias("sitemap")
    )


def robots_diagnostics(
    robots_files: DataFrame, limits: RobotsLimits = DEFAULT_ROBOTS
) -> DataFrame:
    """origin, line_number, directive, message."""
    lines = robots_lines(robots_files, limits)
    kind = F.lower("name")
    message = (
        F.when(F.col("name").isNull(), 'Not of the form "name: value".')
        .when(
            ~kind.isin(*KNOWN_DIRECTIVES),
            F.concat(F.lit('Passed over the unknown name "'), "name", F.lit('".')),
        )
        .when((kind == "sitemap") & (F.col("value") == ""), "A sitemap line without a URL.")
        .when((kind == "user-agent") & (F.col("value") == ""), "A user-agent line without a name.")
    )
    directive = (
        F.when(F.col("name").isNull(), F.col("text"))
        .when(kind == "sitemap", "Sitemap")
        .when(kind == "user-agent", "User-agent")
        .otherwise(F.col("name"))
    )
    by_line = lines.select(
        "origin", "line_number", directive.alias("directive"), message.alias("message")
    ).filter("message IS NOT NULL")
    early = (
        _directives(lines)
        .filter("implicit")
        .select(
            "origin",
            "line_number",
            F.col("name").alias("directive"),
            F.lit("A rule before the first user-agent line; it counts for every agent.").alias(
                "message"
            ),
        )
    )
    if limits.lines is None:
        return by_line.unionByName(early)
    admitted = admit(robots_files, limits).filter("error_code IS NULL")
    long_files = admitted.filter(F.size(F.split("body", "\r?\n")) > limits.lines).select(
        "origin",
        F.lit(limits.lines + 1).alias("line_number"),
        F.lit("(file)").alias("directive"),
        F.lit(f"robots.txt exceeded {limits.lines} lines; remainder ignored.").alias("message"),
    )
    return by_line.unionByName(early).unionByName(long_files)


def path_regex(pattern: Column) -> Column:
    """robots path pattern -> anchored regular expression (``*`` and a final ``$``)."""
    ends = pattern.endswith("$")
    body = F.when(ends, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    escaped = F.regexp_replace(body, r"([|\\{}()\[\]^$+?.])", r"\\$1")
    return F.concat(
        F.lit("(?s)^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.when(ends, F.lit(r"\z")).otherwise("")
    )


def agent_matches(declared: Column, profile: Column) -> Column:
    return (declared == "*") | F.startswith(F.lower(profile), F.lower(declared))


def select_groups(agents: DataFrame) -> DataFrame:
    """origin × profile -> the group with the most specific agent, first on a tie.

    A plain ``min_by`` aggregate: it combines on the map side, so an origin with
    many groups is not gathered anywhere."""
    profiles = F.explode(F.array(*[F.lit(p) for p in PROFILES]))
    fits = agents.withColumn("profile", profiles).filter(
        agent_matches(F.col("user_agent"), F.col("profile"))
    )
    specificity = F.when(F.col("user_agent") == "*", 0).otherwise(F.length("user_agent"))
    return fits.groupBy("origin", "profile").agg(
        F.min_by("group_no", F.struct(-specificity, F.col("group_no"))).alias("group_no")
    )


COLUMNS = ("googlebot", "generic")


def rule_index(
    robots_files: DataFrame, limits: RobotsLimits = DEFAULT_ROBOTS, compat: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The rules of the groups that apply, by their literal heads: (origins, index).

    index(origin, head, profile, rule): a rule is found by the text before its first wildcard, which
    a path must begin with.  origins(origin, googlebot, generic, sizes): which profiles have a group,
    and the lengths of the heads there are.  ``compat`` keeps empty patterns, which match every
    path; the robots standard ignores them."""
    groups = robots_groups(robots_files, limits)
    chosen = cut_lineage(select_groups(robots_agents(groups)), "groups")
    rules = robots_rules(groups)
    if not compat:
        rules = rules.filter("pattern <> ''")
    rule = F.struct(
        (-F.length("pattern")).alias("rank"),
        F.when(F.col("kind") == "allow", 0).otherwise(1).alias("is_block"),
        "line_number",
        "kind",
        "pattern",
        F.col("pattern").rlike(r"[*$]").alias("wild"),
        path_regex(F.col("pattern")).alias("regex"),
    )
    head = F.regexp_extract("pattern", r"(?s)^([^*$]*)", 1)
    index = cut_lineage(chosen.join(rules, ["origin", "group_no"]).select("origin", head.alias("head"), "profile", rule.alias("rule")), "rules")
    sizes = index.groupBy("origin").agg(F.collect_set(F.length("head")).alias("sizes"))
    found = chosen.groupBy("origin").agg(*[F.max(F.col("profile") == p).alias(n) for p, n in zip(PROFILES, COLUMNS)])
    admitted = admit(robots_files, limits).filter("error_code IS NULL").select("origin")
    origins = admitted.join(found, "origin", "left").join(sizes, "origin", "left")
    return origins, index


def rule_candidates(pages: DataFrame, origins: DataFrame, index: DataFrame) -> DataFrame:
    """pages(page_id, origin, path) with each rule whose head the path begins with, and one row
    without a rule for every page.

    A path is cut at the lengths that its origin's heads have and looked up by an equi join, so a page
    meets the rules that may match it, not all of its origin's."""
    none = F.lit(-1)
    fitting = F.filter(F.coalesce("sizes", F.array().cast("array<int>")), lambda n: n <= F.length("path"))
    cut = pages.join(origins, "origin").select(
        "page_id", "origin", "path", *COLUMNS, F.explode(F.concat(F.array(none), fitting)).alias("size")
    )
    cut = cut.withColumn("head", F.when(F.col("size") >= 0, F.substring("path", F.lit(1), F.col("size"))))
    return cut.join(index, ["origin", "head"], "left").filter("size = -1 OR rule IS NOT NULL").drop("size", "head")


def page_verdicts(
    pages: DataFrame,
    robots_files: DataFrame,
    limits: RobotsLimits = DEFAULT_ROBOTS,
    compat: bool = False,
) -> DataFrame:
    """pages(page_id, url) -> page_id, origin, path, verdicts (one per profile).

    Pages whose origin has no admitted robots.txt get no row: missing evidence
    is not an answer.  Only the path is matched, not the query string.  Regular expressions
    are left to wildcard rules whose literal head fits."""
    origins, index = rule_index(robots_files, limits, compat)
    parsed = pages.select("page_id", parse_url(F.col("url")).alias("u")).select(
        "page_id", F.col("u.origin").alias("origin"), F.col("u.path").alias("path")
    )
    met = rule_candidates(parsed, origins, index).filter(
        F.col("rule").isNull() | ~F.col("rule.wild") | F.rlike("path", F.col("rule.regex"))
    )
    first = F.struct("rule.rank", "rule.is_block", "rule.line_number")
    best = met.groupBy("page_id", "origin", "path", *COLUMNS).agg(
        *[F.min_by("rule", F.when(F.col("profile") == p, first)).alias(f"_{n}") for p, n in zip(PROFILES, COLUMNS)]
    )

    def verdict(profile: str, column: str) -> Column:
        r = F.col(f"_{column}")
        return F.struct(
            F.lit(profile).alias("profile"),
            (~F.coalesce(r["kind"] == "disallow", F.lit(False))).alias("crawlable"),
            F.when(~F.coalesce(F.col(column), F.lit(False)), "no-matching-group")
            .when(r.isNull(), "no-matching-rules")
            .when(r["kind"] == "allow", "allow-rule")
            .otherwise("disallow-rule")
            .alias("reason"),
            r["kind"].alias("rule_kind"),
            r["pattern"].alias("pattern"),
            r["line_number"].alias("line_number"),
        )

    verdicts = F.array(*[verdict(p, n) for p, n in zip(PROFILES, COLUMNS)])
    return best.select("page_id", "origin", "path", verdicts.alias("verdicts"))


def evaluate(
    pages: DataFrame,
    robots_files: DataFrame,
    limits: RobotsLimits = DEFAULT_ROBOTS,
    compat: bool = False,
) -> DataFrame:
    """page_id, origin, path, profile, crawlable, reason, matched rule: a row per profile."""
    return page_verdicts(pages, robots_files, limits, compat).select(
        "page_id", "origin", "path", F.inline("verdicts")
    )


def page_blocks(verdicts: DataFrame) -> DataFrame:
    """One row per page: robots_path, robots_blocked, robots_blocked_by."""
    blocked = F.filter("verdicts", lambda v: ~v["crawlable"])
    text = F.transform(
        blocked,
        lambda v: F.concat(
            v["profile"], F.lit(": disallowed ("), v["rule_kind"], F.lit(" "), v["pattern"], F.lit(")")
        ),
    )
    return verdicts.select(
        "page_id",
        F.col("path").alias("robots_path"),
        (F.size(blocked) > 0).alias("robots_blocked"),
        F.array_join(text, "; ").alias("robots_blocked_by"),
    )
