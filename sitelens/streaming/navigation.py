"""Navigation assembly from browser events: a streaming job, its serving table, its batch twin.

The stream keeps one small state per tab (watched or not, plus the navigation
under way).  Event time only bounds that state; events later than the
watermark are dropped by Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sitelens.functions.headers import ALLOWED_HEADERS, merge_headers
from sitelens.limits import DEFAULT_NETWORK
from sitelens.operators.asof import last_before
from sitelens.sources.session_table import BUCKETS, SessionTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OBSERVATION = (
    "tab_id bigint, request_id string, requested_url string, final_url string, status_code int, "
    "hops string, headers string, observed_at timestamp"
)
#: An observation, or (cleared) the end of a tab's watch, in the order of its event.
CHANGE = f"{OBSERVATION}, seq bigint, cleared boolean"
IDLE_MILLIS = 6 * 3600 * 1000
#: State of a tab without one: watched, navigation under way, its timer.
UNWATCHED = (False, "", 0)
MAIN_FRAME = "main_frame"


def main_frame(events: DataFrame) -> DataFrame:
    return events.filter((F.col("frame") == MAIN_FRAME) & (F.col("tab_id") >= 0))


class TabNavigation(StatefulProcessor):
    """Keyed by tab.  State: is the tab watched, and the pending navigation.

    With ``changes`` the ends of watches are rows too."""

    def __init__(self, changes: bool = False) -> None:
        self._changes = changes
        self._row = Row(*(c.split()[0] for c in (CHANGE if changes else OBSERVATION).split(", ")))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("tab", "watched boolean, pending string, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # One call for the state; a tab that was never watched has none.
        held = self._state.get() or UNWATCHED
        watched, pending, timer = held
        nav = json.loads(pending) if pending else None
        # One micro-batch of one tab; a batch is bounded by maxFilesPerTrigger.
        events = sorted(rows, key=_place)
        for e in events:
            if e.kind in ("watch", "unwatch"):
                watched, nav = e.kind == "watch", nav if e.kind == "watch" else None
                if self._changes and not watched:
                    yield self._row(key[0], *[None] * 6, e.at, e.seq, True)
                continue
            if not watched:
                continue
            if e.kind == "error":
                nav = None
                continue
            if nav is None or nav["request"] != e.request_id:
                nav = {"request": e.request_id, "asked": e.url, "hops": [], "headers": {}}
            if e.kind == "headers":
                nav["headers"].update(_merge(e.headers))
            elif e.kind == "redirect":
                nav["hops"].append([e.url, e.redirect_url, int(e.status_code)])
            elif e.kind == "completed":
                yield self._row(*_observation(key[0], nav, e), *((e.seq, False) if self._changes else ()))
                nav = None
        # Event time, not the watermark (0 in the first batch), tells how long a navigation idles.
        idle = max(timer, max(e.at for e in events if e.at is not None) // 1000 + IDLE_MILLIS) if nav else 0
        if timer != idle:
            if timer:
                self._handle.deleteTimer(timer)
            if idle:
                self._handle.registerTimer(idle)
        state = (watched, json.dumps(nav) if nav else "", idle)
        if state != tuple(held):
            self._state.update(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # A navigation that never completed is given up; the tab stays watched.
        held = self._state.get()
        if held:
            self._state.update((held[0], "", 0))
        return iter(())

    def close(self) -> None:
        pass


def _place(event: Row) -> tuple:
    """By time, then number; what has none comes last."""
    return event.at is None, event.at or 0, event.seq is None, event.seq or 0


def _merge(headers) -> dict[str, str]:
    out: dict[str, list[str]] = {}
    for h in headers if headers is not None else []:
        name = h["name"].lower()
        if name in ALLOWED_HEADERS:
            out.setdefault(name, []).append((h["value"] or "")[: DEFAULT_NETWORK.header_chars])
    return {name: ", ".join(values) for name, values in out.items()}


def _observation(tab: int, nav: dict, event) -> tuple:
    hops = "|".join(f"{a}>{b}>{s}" for a, b, s in nav["hops"])
    headers = "|".join(f"{k}={v}" for k, v in sorted(nav["headers"].items()))
    return (
        tab, nav["request"], nav["asked"], event.url, int(event.status_code), hops, headers, event.at,
    )


def _by_tab(events: DataFrame, late: str, changes: bool) -> DataFrame:
    """Rows, not frames, go through Python: a frame costs more than the few events of a tab.
    Times are microseconds there, whatever the worker's time zone."""
    keyed = main_frame(events).withColumn("at", F.unix_micros("ts")).withWatermark("ts", late).groupBy("tab_id")
    columns = CHANGE if changes else OBSERVATION
    rows = keyed.transformWithState(
        TabNavigation(changes), columns.replace("observed_at timestamp", "observed_at bigint"), outputMode="append", timeMode="eventtime"
    )
    return rows.withColumn("observed_at", F.timestamp_micros("observed_at"))


def navigation_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Event stream -> one observation per completed main-frame navigation."""
    return _by_tab(events, late, changes=False)


def change_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Event stream -> observations and ends of watches, for the serving table."""
    return _by_tab(events, late, changes=True)


def write_observations(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run what is available into parquet, one folder per micro-batch.

    A replayed batch overwrites its own folder, so the sink is idempotent."""

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_per_tab(observations: DataFrame) -> DataFrame:
    """Serving table: the newest observation of each tab."""
    keep = [c for c in observations.columns if c not in ("tab_id", "epoch")]
    return (
        observations.groupBy("tab_id")
        .agg(F.max_by(F.struct(*keep), F.struct("observed_at", "request_id")).alias("o"))
        .select("tab_id", "o.*")
    )


def serving_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> SessionTable:
    """A versioned table of one row per tab; made if there is none."""
    columns = OBSERVATION.split(", ", 1)[1]
    empty = spark.createDataFrame([], f"session_id string, updated_at string, {columns}")
    return SessionTable(spark, path, empty.schema, buckets)


def serving_rows(changes: DataFrame) -> DataFrame:
    """Rows and tombstones of a serving table: the last change of each tab.

    ``updated_at`` sorts as (time, place among the events of that time), so a change counts by when
    it happened, and one that is applied again changes nothing."""
    keep = [c.split()[0] for c in OBSERVATION.split(", ")[1:]]
    last = F.max_by(F.struct(*keep, "seq", "cleared"), F.struct("observed_at", "seq", "cleared"))
    at = F.concat(F.date_format("o.observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("#"), F.lpad(F.col("o.seq").cast("string"), 20, "0"))
    newest = changes.groupBy("tab_id").agg(last.alias("o"))
    return newest.select(
        F.col("tab_id").cast("string").alias("session_id"),
        at.alias("updated_at"),
        *(F.col(f"o.{c}").alias(c) for c in keep),
        F.col("o.cleared").alias("deleted"),
    )


def write_latest(changes: DataFrame, table: SessionTable, checkpoint: str) -> StreamingQuery:
    """Upsert what is available: a micro-batch rewrites the buckets of its own tabs only, and a
    tab that is no longer watched leaves a tombstone.  A replayed batch changes nothing."""

    def upsert(batch: DataFrame, epoch: int) -> None:
        table.apply(serving_rows(batch))

    return (
        changes.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(table: SessionTable, version: int | None = None) -> DataFrame:
    """The newest observation of every tab that is watched, as of a version."""
    rows = table.read(version).withColumn("tab_id", F.col("session_id").cast("long"))
    return rows.select(*(c.split()[0] for c in OBSERVATION.split(", ")))


def latest_watched(observations: DataFrame, events: DataFrame) -> DataFrame:
    """Batch form of the serving table: what an end of the watch came after is gone."""
    ends = main_frame(events).filter("kind = 'unwatch'").groupBy("tab_id").agg(F.max("ts").alias("_ended"))
    newest = latest_per_tab(observations).join(ends, "tab_id", "left")
    return newest.filter("_ended IS NULL OR _ended < observed_at").drop("_ended")


def robots_once(fetch_log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream of robots fetches -> the first to arrive per (session, origin)."""
    return fetch_log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "origin"])


def first_robots_fetch(fetch_log: DataFrame) -> DataFrame:
    """Batch form: the earliest fetch per (session, origin)."""
    keep = [c for c in fetch_log.columns if c not in ("session_id", "origin")]
    return (
        fetch_log.groupBy("session_id", "origin")
        .agg(F.min_by(F.struct(*keep), "ts").alias("r"))
        .select("session_id", "origin", "r.*")
    )


# -- batch twin ---------------------------------------------------------------------


def gate(events: DataFrame) -> DataFrame:
    """Events of tabs watched at that moment, with the time the watch began.

    Whether a tab is watched is an as-of lookup of its last watch or unwatch; a watch of a tab that
    is watched already begins nothing."""
    main = main_frame(events)
    in_order = Window.partitionBy("tab_id").orderBy("ts", "seq")
    control = (
        main.filter(F.col("kind").isin("watch", "unwatch"))
        .withColumn("_before", F.lag("kind").over(in_order))
        .filter("_before IS NULL OR _before <> kind")
        .drop("_before")
    )
    seen = F.struct(F.col("kind").alias("control"), F.col("ts").alias("since"))
    body = last_before(
        main.filter(~F.col("kind").isin("watch", "unwatch")),
        control,
        "tab_id",
        F.col("ts"),
        F.col("ts"),
        seen,
        "watch",
    )
    return body.filter("watch.control = 'watch'").withColumn("since", F.col("watch.since")).drop("watch")


def _in_order(kind: str, value: Column) -> Column:
    picked = F.collect_list(F.when(F.col("kind") == kind, F.struct("ts", "seq", value.alias("v"))))
    return F.transform(F.array_sort(picked), lambda x: x["v"])


def assemble(events: DataFrame) -> DataFrame:
    """Batch form: group the gated events of a navigation and fold them.

    As in the stream a navigation ends with its completion or error, and when the tab turns to
    another request.  They are numbered by a running sum over the tab's events, which Spark sorts
    with spill and reads once; the groups folded after it are small however busy the tab."""
    hop = F.struct("url", "redirect_url", "status_code")
    merged = merge_headers(F.col("headers"), DEFAULT_NETWORK.header_chars)
    ends = F.col("kind").isin("completed", "error")
    rows = gate(events).withColumn("_m", F.when(F.col("kind") == "headers", F.map_entries(merged)))
    in_order = Window.partitionBy("tab_id", "since").orderBy("ts", "seq")
    other = ~F.lag("request_id").over(in_order).eqNullSafe(F.col("request_id"))
    ended = F.coalesce(F.lag(ends).over(in_order), F.lit(False))
    rows = rows.withColumn("_starts", (other | ended).cast("long"))
    rows = rows.withColumn("_part", F.sum("_starts").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = rows.groupBy("tab_id", "since", "_part", "request_id").agg(
        F.min_by("url", F.struct("ts", "seq")).alias("requested_url"),
        F.max_by(F.struct("kind", "url", "status_code", "ts"), F.when(ends, F.struct("ts", "seq"))).alias("end"),
        _in_order("redirect", hop).alias("hops"),
        F.flatten(_in_order("headers", F.col("_m"))).alias("_headers"),
    )
    names = F.array_sort(F.array_distinct(F.transform("_headers", lambda h: h["key"])))
    headers = F.transform(
        names,
        lambda n: F.concat(
            n, F.lit("="), F.element_at(F.filter("_headers", lambda h: h["key"] == n), -1)["value"]
        ),
    )
    return grouped.filter("end.kind = 'completed'").select(
        "tab_id",
        "request_id",
        "requested_url",
        F.col("end.url").alias("final_url"),
        F.col("end.status_code").alias("status_code"),
        F.array_join(
            F.transform(
                "hops",
                lambda h: F.concat(h["url"], F.lit(">"), h["redirect_url"], F.lit(">"), h["status_code"].cast("string")),
            ),
            "|",
        ).alias("hops"),
        F.array_join(headers, "|").alias("headers"),
        F.col("end.ts").alias("observed_at"),
    )
