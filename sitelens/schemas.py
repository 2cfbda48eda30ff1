"""Schemas of the tables jobs write and read.  Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

HOP = T.StructType(
    [
        T.StructField("from_url", T.StringType()),
        T.StructField("to_url", T.StringType()),
        T.StructField("status", T.IntegerType()),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

FETCHES = T.StructType(
    [
        T.StructField("fetch_id", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("requested_url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("location", T.StringType()),
        T.StructField("hop_count", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("expect_mime", T.StringType()),
        T.StructField("logged_error", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("redirect_hops", T.ArrayType(HOP)),
        T.StructField("body_bytes", T.IntegerType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

ROBOTS_FILES = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("fetch_error", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

SITEMAP_FILES = T.StructType(
    [
        T.StructField("root_url", T.StringType()),
        T.StructField("file_url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("fetch_error", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

HOPS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        *HOP.fields,
        T.StructField("observed_at", T.TimestampType()),
    ]
)

NAVIGATIONS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("tab_id", T.LongType()),
        T.StructField("requested_url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("x_robots_tag", T.StringType()),
        T.StructField("redirect_hops", T.ArrayType(HOP)),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("observed_at", T.TimestampType()),
    ]
)

NAV_EVENTS = T.StructType(
    [
        T.StructField("tab_id", T.LongType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("frame", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("redirect_url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField(
            "headers",
            T.ArrayType(
                T.StructType(
                    [T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]
                )
            ),
        ),
        T.StructField("ts", T.TimestampType()),
    ]
)

EVIDENCE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("page_url", T.StringType()),
        T.StructField("evidence_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

FINDINGS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("finding_id", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("affected_url", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("evidence_ids", T.ArrayType(T.StringType())),
        T.StructField("recommendation", T.StringType()),
        T.StructField("source_ref", T.StringType()),
    ]
)

CAPTURE_ERRORS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("code", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

OBSERVATIONS = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)

SESSIONS = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
        T.StructField("tab_url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("capture_time", T.StringType()),
        T.StructField("extension_version", T.StringType()),
        T.StructField("feature_availability", T.MapType(T.StringType(), T.StringType())),
        T.StructField("recording_note", T.StringType()),
        T.StructField("report_markdown", T.StringType()),
    ]
)
