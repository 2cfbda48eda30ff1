"""Stored audit sessions: load with migration and quarantine, list, save, delete, attach.

A stored session is one JSON document per row.  It is parsed once against a
fixed schema; headers become columns, children stay typed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.expr import cached_columns
from sitelens.functions.shapes import issues
from sitelens.functions.urls import parse_url
from sitelens.limits import DEFAULT_CAPTURE, CaptureLimits
from sitelens.sources.session_shapes import session_shape

# Fixed values.
CURRENT_VERSION = 4
DOM_EVIDENCE_VERSION = 2
HISTORICAL_EVIDENCE_VERSION = 1
HISTORICAL_NOTE = "Made before checks were recorded."
MISSING_NOTE = "There is no record of the checks."
RAW_BODY_KEYS = ("bodyText", "rawBody", "responseBody", "htmlBody", "html", "body")

SCHEMA = """
schemaVersion INT, id STRING, createdAt STRING, updatedAt STRING, tabUrl STRING, finalUrl STRING,
captureTime STRING, extensionVersion STRING, featureAvailability MAP<STRING, STRING>,
snapshots ARRAY<STRUCT<id: STRING, url: STRING, capturedAt: STRING,
  evidence: ARRAY<STRUCT<id: STRING, kind: STRING, source: STRING, value: VARIANT, capturedAt: STRING>>,
  captureLimits: STRUCT<domEvidenceSchemaVersion: INT>>>,
findings ARRAY<STRUCT<id: STRING, ruleId: STRING, severity: STRING, category: STRING, affectedUrl: STRING,
  description: STRING, evidenceIds: ARRAY<STRING>, recommendation: STRING, sourceRef: STRING, capturedAt: STRING>>,
captureErrors ARRAY<STRUCT<id: STRING, code: STRING, source: STRING, message: STRING, url: STRING, capturedAt: STRING>>,
checkSelection STRUCT<selectedCheckIds: ARRAY<STRING>,
  skippedChecks: ARRAY<STRUCT<checkId: STRING, reason: STRING>>, recordingNote: STRING>,
reportMarkdown STRING, variantTestRun STRING, soft404ProbeRun STRING, _corrupt STRING
"""


@cached_columns
def _issues(limits: CaptureLimits) -> Column:
    """Where the document departs from the session's shape, as "path: what is wrong"."""
    return issues(session_shape(limits), F.col("doc"))


def parse(stored: DataFrame, limits: CaptureLimits = DEFAULT_CAPTURE) -> DataFrame:
    """stored(session_id, raw) -> session_id, raw, s (typed), issues.

    Nested members are checked, too, DOM evidence by its source; texts and lists have no bounds unless
    ``limits`` names them."""
    s = F.from_json("raw", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    typed = stored.select("session_id", "raw", s.alias("s"), F.try_parse_json("raw").alias("doc"))
    return typed.select("session_id", "raw", "s", _issues(limits).alias("issues"))


def _note() -> Column:
    """Recording note after migration: versions 1 and 2 never recorded a selection."""
    return (
        F.when(F.col("s.schemaVersion") <= 2, HISTORICAL_NOTE)
        .when(F.col("s.checkSelection").isNull(), MISSING_NOTE)
        .otherwise(F.col("s.checkSelection.recordingNote"))
    )


def migrated(parsed: DataFrame) -> DataFrame:
    """Valid sessions in the current shape, header columns plus child arrays."""
    s = F.col("s")
    historical = s["schemaVersion"] <= 2
    snapshots = F.when(
        s["schemaVersion"] == 1,
        F.transform(
            s["snapshots"],
            lambda x: x.withField(
                "captureLimits",
                F.coalesce(
                    x["captureLimits"],
                    F.struct(F.lit(HISTORICAL_EVIDENCE_VERSION).alias("domEvidenceSchemaVersion")),
                ),
            ),
        ),
    ).otherwise(s["snapshots"])
    return parsed.filter(F.size("issues") == 0).select(
        "session_id",
        F.lit(CURRENT_VERSION).alias("schema_version"),
        s["schemaVersion"].alias("stored_version"),
        s["createdAt"].alias("created_at"),
        s["updatedAt"].alias("updated_at"),
        s["tabUrl"].alias("tab_url"),
        s["finalUrl"].alias("final_url"),
        s["captureTime"].alias("capture_time"),
        s["extensionVersion"].alias("extension_version"),
        s["featureAvailability"].alias("feature_availability"),
        snapshots.alias("snapshots"),
        s["findings"].alias("findings"),
        s["captureErrors"].alias("capture_errors"),
        F.when(historical, F.array().cast("array<string>"))
        .otherwise(F.coalesce(s["checkSelection"]["selectedCheckIds"], F.array().cast("array<string>")))
        .alias("selected_checks"),
        _note().alias("recording_note"),
        F.coalesce(s["reportMarkdown"], F.lit("")).alias("report_markdown"),
        s["variantTestRun"].alias("variant_run"),
        s["soft404ProbeRun"].alias("soft404_run"),
    )


def quarantined(parsed: DataFrame) -> DataFrame:
    """Rows that fail the schema: id, reason, version found, payload."""
    return parsed.filter(F.size("issues") > 0).select(
        "session_id",
        F.concat(F.lit("Schema validation failed: "), F.array_join("issues", "; ")).alias("reason"),
        F.col("s.schemaVersion").alias("original_version"),
        F.col("raw").alias("payload"),
    )


def load(stored: DataFrame, limits: CaptureLimits = DEFAULT_CAPTURE) -> tuple[DataFrame, DataFrame]:
    """Sessions in the current shape, and the quarantine."""
    rows = parse(stored, limits)
    return migrated(rows), quarantined(rows)


def listing(sessions: DataFrame) -> DataFrame:
    """Six header columns, newest first; child arrays are not read."""
    return sessions.select(
        "session_id", "tab_url", "final_url", "capture_time", "updated_at", "extension_version"
    ).orderBy(F.desc("updated_at"), "session_id")


def latest_by_url(sessions: DataFrame) -> DataFrame:
    """url, session_id: the newest session whose tab or final URL is that URL."""
    urls = F.array_distinct(
        F.array(*[F.coalesce(parse_url(F.col(c))["href"], F.col(c)) for c in ("tab_url", "final_url")])
    )
    return (
        sessions.select("session_id", "updated_at", F.explode(urls).alias("url"))
        .groupBy("url")
        .agg(F.max_by("session_id", F.struct("updated_at", "session_id")).alias("session_id"))
    )


def save_guard(sessions: DataFrame) -> Column:
    """Reason a session must not be written, NULL when it may.

    New writes with DOM evidence must declare the current evidence version."""
    bad = F.exists(
        "snapshots",
        lambda s: F.exists(s["evidence"], lambda e: e["kind"] == "dom")
        & ~s["captureLimits"]["domEvidenceSchemaVersion"].eqNullSafe(DOM_EVIDENCE_VERSION),
    )
    return F.when(
        bad, f"new writes with DOM evidence must declare version {DOM_EVIDENCE_VERSION}"
    )


def holds_raw_body(payload: Column) -> Column:
    """Does a JSON payload hold a forbidden key at any depth?

    A key is a string followed by a colon outside of other strings; escaped
    quotes inside string values cannot start one.  Valid JSON is written anew first, so that
    escaped letters of a key are plain."""
    plain = F.coalesce(F.to_json(F.try_parse_json(payload)), payload)
    strings_gone = F.regexp_replace(plain, r'"((?:[^"\\]|\\.)*+)"(\s*:)?', "\x02$1\x03$2")
    keys = "|".join(RAW_BODY_KEYS)
    return strings_gone.rlike(f"\x02(?:{keys})\x03\\s*:")


def attach(sessions: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach comparison runs by session id: (sessions, refused runs).

    runs(session_id, run_kind variantTestRun | soft404ProbeRun, payload)."""
    judged = runs.withColumn("raw_body", holds_raw_body(F.col("payload")))
    good = judged.filter("NOT raw_body")
    per_session = good.groupBy("session_id").agg(
        F.max(F.when(F.col("run_kind") == "variantTestRun", F.col("payload"))).alias("_v"),
        F.max(F.when(F.col("run_kind") == "soft404ProbeRun", F.col("payload"))).alias("_s"),
    )
    out = sessions.join(per_session, "session_id", "left").withColumns(
        {
            "variant_run": F.coalesce("_v", "variant_run"),
            "soft404_run": F.coalesce("_s", "soft404_run"),
        }
    )
    return out.drop("_v", "_s"), judged.filter("raw_body").drop("raw_body")


def newest_snapshot() -> Column:
    """The newest capture of a session, the first one on equal times."""
    order = F.transform(
        "snapshots",
        lambda s, i: F.struct(s["capturedAt"].alias("at"), (-i).alias("first"), i.alias("i")),
    )
    newest = F.try_element_at(F.array_sort(order), F.lit(-1))["i"]
    return F.try_element_at("snapshots", newest + 1)


def latest_snapshot(sessions: DataFrame) -> DataFrame:
    """session_id, snapshot: in-row, no shuffle."""
    return sessions.select("session_id", newest_snapshot().alias("snapshot")).filter(
        "snapshot IS NOT NULL"
    )
