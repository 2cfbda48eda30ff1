"""Captured HTTP exchanges: failure classes, redirect chains, navigation lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.expr import let
from sitelens.functions.headers import is_redirect, mime_matches
from sitelens.functions.urls import parse_url, resolve_url
from sitelens.limits import DEFAULT_NETWORK, NetworkLimits
from sitelens.operators.asof import last_before
from sitelens.session import cut_lineage

# Failures the fetcher itself logs.
LOGGED_ERRORS = ("timeout", "aborted", "redirect-opaque", "network-error")


def error_code(limits: NetworkLimits = DEFAULT_NETWORK) -> Column:
    """Ordered failure class of a logged fetch; NULL is a usable response.

    Reads requested_url, final_url, status, location, hop_count, content_type,
    expect_mime, logged_error."""
    redirect = F.coalesce(is_redirect(F.col("status")), F.lit(False))

    def judge(u: Column) -> Column:
        return (
            F.when(u["asked"].isNull(), "invalid-url")
            .when(~u["asked"].isin("http", "https"), "unsupported-scheme")
            .when(F.col("logged_error").isin(*LOGGED_ERRORS), F.col("logged_error"))
            .when(redirect & (F.col("hop_count") >= limits.redirects), "redirect-limit")
            .when(redirect & (F.coalesce("location", F.lit("")) == ""), "network-error")
            .when(redirect & u["target"].isNull(), "invalid-url")
            .when(
                F.col("expect_mime").isNotNull()
                & ~mime_matches(F.col("content_type"), F.col("expect_mime")),
                "mime-mismatch",
            )
        )

    return let(
        F.struct(
            parse_url(F.col("requested_url"))["scheme"].alias("asked"),
            resolve_url(F.col("location"), parse_url(F.col("final_url")))["href"].alias("target"),
        ),
        judge,
    )


def classify(fetches: DataFrame, limits: NetworkLimits = DEFAULT_NETWORK) -> DataFrame:
    """fetches + error_code + body_truncated (truncation is not a failure)."""
    return fetches.withColumns(
        {
            "error_code": error_code(limits),
            "body_truncated": F.coalesce("truncated", F.lit(False)),
        }
    )


#: Stands for the time of a hop that was always in force, and of a request that sees the latest.
ALWAYS, LATEST = "1900-01-01", "9999-01-01"
POSITION = ("request_id", "asked", "url", "place")
#: Doublings after which chains that are still going on are looked at for circles.
LOOK = 4


def _edges(hops: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(src, dst, since) of URLs that only ever led to one URL, and (src, since, dst) of the others,
    None if there are none.

    Counted with partial sums first: a URL logged millions of times is no large group.  Of two
    targets at one time the smaller counts."""
    time = F.col("observed_at") if "observed_at" in hops.columns else F.lit(None)
    log = (
        hops.where("from_url IS NOT NULL AND to_url IS NOT NULL")
        .groupBy(F.col("from_url").alias("src"), F.coalesce(time.cast("timestamp"), F.lit(ALWAYS).cast("timestamp")).alias("since"))
        .agg(F.min("to_url").alias("dst"))
    )
    known = log.groupBy("src").agg(F.min("dst").alias("dst"), F.max("dst").alias("most"), F.min("since").alias("since"))
    known = cut_lineage(known, "hops")
    stable, changed = known.where("dst = most").select("src", "dst", "since"), known.where("dst <> most").select("src")
    return stable, None if changed.isEmpty() else cut_lineage(log.join(changed, "src", "left_semi"), "hops")


def _repeats(positions: DataFrame) -> DataFrame:
    """request_id and the place where a chain first comes to a URL it has been to.

    A chain is at a URL a few times at most: what goes round is taken out early."""
    places = positions.groupBy("request_id", "url").agg(F.array_sort(F.collect_list("place")).alias("places"))
    again = F.try_element_at("places", F.lit(2))
    return places.groupBy("request_id").agg(F.min(again).alias("repeat")).where("repeat IS NOT NULL")


class _Jumps:
    """Jumps of 1, 2, 4 ... hops over URLs that led to one URL only; a longer one is made when asked for.

    A jump is in force since its youngest hop is.  A URL whose chain is shorter has no row, so
    the tables get smaller."""

    def __init__(self, stable: DataFrame):
        self.tables = [stable]

    def __getitem__(self, k: int) -> DataFrame:
        while len(self.tables) <= k:
            last = self.tables[-1]
            further = last.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("since").alias("too"))
            joined = last.join(further, "dst").select("src", F.col("end").alias("dst"), F.greatest("since", "too").alias("since"))
            self.tables.append(cut_lineage(joined, "hops"))
        return self.tables[k]


def _along(start: DataFrame, jumps: _Jumps) -> DataFrame:
    """All positions reached from the start positions over jumps, the start included.

    Positions at distances below 2^k give those below 2^(k+1) with one join, so a chain of n hops
    takes log n joins; one that has ended has no longer jump.  A chain that has come round in a circle
    is taken out; what it repeats is cut off afterwards."""
    every = going = start
    k = 0
    while True:
        jump = jumps[k].withColumnsRenamed({"src": "url", "dst": "next"})
        reached = going.join(jump, "url").where("asked >= since").select(
            "request_id", "asked", F.col("next").alias("url"), (F.col("place") + 2**k).alias("place")
        )
        reached = cut_lineage(reached, "chains")
        if reached.isEmpty():
            return every
        every, going = every.unionByName(reached), going.unionByName(reached)
        k += 1
        if k >= LOOK:
            round_again = cut_lineage(_repeats(going.join(reached.select("request_id").distinct(), "request_id", "left_semi")), "circles")
            if not round_again.isEmpty():
                going = going.join(round_again, "request_id", "left_anti")


def resolve_chains(requests: DataFrame, hops: DataFrame, limit: int | None = None) -> DataFrame:
    """Follow every request through the hop log to its end, as the log stood when it was made.

    requests(request_id, requested_url[, requested_at]),
    hops(from_url, to_url, status[, observed_at]) ->
    request_id, final_url, hop_count, hop_urls, looped, limit_reached.

    A hop is in force from its time until the URL is logged with another target; without times
    it always is, and a request without one sees the latest.  A chain that comes to a URL again ends
    there and is looped.  ``limit`` cuts chains after so many hops, if one is asked for.

    Hops of URLs that led to one URL only are followed by doubling; one of a URL whose target
    changed is looked up as of the request, by time buckets, and the chain goes on from there.  Every
    step is an equi join on a URL whose right side has one row a URL, or such a lookup."""
    stable, moving = _edges(hops)
    jumps = _Jumps(stable)
    time = F.col("requested_at").cast("timestamp") if "requested_at" in requests.columns else F.lit(None).cast("timestamp")
    start = cut_lineage(
        requests.select(
            "request_id",
            F.coalesce(time, F.lit(LATEST).cast("timestamp")).alias("asked"),
            F.col("requested_url").alias("url"),
            F.lit(0).cast("long").alias("place"),
        ),
        "chains",
    )
    total = _along(start, jumps)
    if moving is not None:
        changing = moving.select(F.col("src").alias("url")).distinct()
        found, been = total, None
        while True:
            # Chains that stand at a URL whose target changed, and haven't stood there before, go on.
            ends = found.groupBy("request_id").agg(F.max_by(F.struct("asked", "url", "place"), "place").alias("end")).select("request_id", "end.*")
            waiting = ends.join(changing, "url", "left_semi").select(*POSITION)
            if been is not None:
                waiting = waiting.join(been, ["request_id", "url"], "left_anti")
            waiting = cut_lineage(waiting, "chains")
            asked = last_before(waiting, moving, "url", F.col("asked"), F.col("since"), F.col("dst"), "next", right_key="src")
            start = asked.where("next IS NOT NULL").select("request_id", "asked", F.col("next").alias("url"), (F.col("place") + 1).alias("place"))
            start = cut_lineage(start, "chains")
            if start.isEmpty():
                break
            own = waiting.select("request_id", "url")
            been = own if been is None else been.unionByName(own)
            found = _along(start, jumps)
            total = total.unionByName(found)
        total = cut_lineage(total, "chains")
    kept = total.join(_repeats(total), "request_id", "left").where("repeat IS NULL OR place <= repeat")
    out = kept.groupBy("request_id").agg(
        F.max_by("url", "place").alias("final_url"),
        F.max("place").cast("int").alias("hop_count"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "url")))), lambda x: x["url"]).alias("hop_urls"),
        F.max("repeat").isNotNull().alias("looped"),
    )
    if limit is None:
        return out.withColumn("limit_reached", F.lit(False))
    over = F.col("hop_count") > limit
    last = F.when(over, F.element_at("hop_urls", limit)).otherwise(F.col("final_url"))
    return out.select(
        "request_id",
        last.alias("final_url"),
        F.least("hop_count", F.lit(limit)).alias("hop_count"),
        F.slice("hop_urls", 1, limit).alias("hop_urls"),
        "looped",
        (over | F.col("looped")).alias("limit_reached"),
    )


def latest_navigation(
    requests: DataFrame, navigations: DataFrame, watched: DataFrame, bucket_seconds: int = 3600
) -> DataFrame:
    """As-of lookup: a tab's newest observation at audit time, if it is of that URL.

    requests(request_id, tab_id, requested_url, audit_time);
    navigations(tab_id, requested_url, final_url, status_code, observed_at);
    watched(tab_id).  Adds nav_status observed / unavailable and a reason code."""
    seen = F.struct(
        F.col("requested_url").alias("nav_requested_url"),
        F.col("final_url").alias("nav_final_url"),
        "status_code",
    )
    near = last_before(
        requests,
        navigations,
        "tab_id",
        F.col("audit_time"),
        F.col("observed_at"),
        seen,
        "n",
        bucket_seconds,
    )
    armed = watched.select("tab_id").distinct().withColumn("armed", F.lit(True))
    same = (F.col("n.nav_requested_url") == F.col("requested_url")) | (
        F.col("n.nav_final_url") == F.col("requested_url")
    )
    reason = F.when(
        F.col("n").isNull(),
        F.when(F.col("armed"), "navigation-completed-before-attach").otherwise("listener-not-attached"),
    ).when(~same, "navigation-completed-before-attach")
    return (
        near.join(armed, "tab_id", "left")
        .select(
            "request_id",
            "tab_id",
            "requested_url",
            F.when(reason.isNull(), "observed").otherwise("unavailable").alias("nav_status"),
            reason.alias("reason"),
            F.when(reason.isNull(), F.col("n.nav_final_url")).alias("final_url"),
            F.when(reason.isNull(), F.col("n.status_code")).alias("status_code"),
        )
    )
