"""HTTP header, media-type and robots-token expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.expr import browser_trim, let
from sitelens.functions.urls import parse_url

# Response headers kept, and the redirect statuses.
ALLOWED_HEADERS = (
    "cache-control",
    "content-type",
    "link",
    "location",
    "refresh",
    "vary",
    "x-robots-tag",
)
REDIRECT_STATUSES = (301, 302, 303, 307, 308)


def media_type(content_type: Column) -> Column:
    return F.lower(browser_trim(F.substring_index(content_type, ";", 1)))


def is_html_type(content_type: Column) -> Column:
    """True / False, or NULL when no media type was captured."""
    return let(
        media_type(content_type),
        lambda m: F.when(m != "", (m == "text/html") | m.startswith("text/html+")),
    )


def mime_matches(content_type: Column, expected: Column) -> Column:
    return let(
        F.struct(
            media_type(F.coalesce(content_type, F.lit(""))).alias("m"),
            F.lower(browser_trim(expected)).alias("e"),
        ),
        lambda s: (s["m"] == s["e"]) | s["m"].startswith(F.concat(s["e"], F.lit("+"))),
    )


def looks_like_html(content_type: Column, body: Column) -> Column:
    by_type = F.coalesce(is_html_type(content_type), F.lit(False))
    return by_type | F.coalesce(body.rlike(r"(?i)^\s*(?:<!doctype html|<html)"), F.lit(False))


def is_redirect(status: Column) -> Column:
    return status.isin(*REDIRECT_STATUSES)


def is_success(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def directive_tokens(content: Column) -> Column:
    """Lower-case robots directives; separators are comma, semicolon, space."""
    return F.filter(F.split(F.lower(content), r"[,;\s]+"), lambda t: t != "")


def canonical_from_link(link: Column) -> Column:
    """First rel=canonical target of a Link header (split on commas), or NULL."""
    sections = F.transform(F.split(link, ","), browser_trim)
    hits = F.filter(
        sections, lambda s: s.rlike('(?i)rel="?canonical"?') & s.rlike("^<[^>]+>")
    )
    target = F.regexp_extract(F.try_element_at(hits, F.lit(1)), "^<([^>]+)>", 1)
    return let(target, lambda t: F.coalesce(parse_url(t)["href"], t))


def merge_headers(headers: Column, max_chars: int) -> Column:
    """array<struct<name,value>> in arrival order -> map of the allowed ones.

    Names lower-cased; a repeated header is joined with ', '."""
    known = F.filter(
        F.transform(
            headers,
            lambda h: F.struct(
                F.lower(h["name"]).alias("name"),
                F.substring(F.coalesce(h["value"], F.lit("")), 1, max_chars).alias("value"),
            ),
        ),
        lambda h: h["name"].isin(*ALLOWED_HEADERS),
    )

    def joined(rows: Column) -> Column:
        names = F.array_distinct(F.transform(rows, lambda h: h["name"]))
        return F.map_from_entries(
            F.transform(
                names,
                lambda n: F.struct(
                    n.alias("name"),
                    F.array_join(
                        F.transform(
                            F.filter(rows, lambda h: h["name"] == n), lambda h: h["value"]
                        ),
                        ", ",
                    ).alias("value"),
                ),
            )
        )

    return let(known, joined)


# Fixed values of the user-agent profiles.
GOOGLEBOT_STYLE_UA = "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)"
MAX_CUSTOM_UA_CHARS = 256


def user_agent_profile(profile_id: Column, custom: Column) -> Column:
    """struct<profile_id,label,user_agent,method,fallback_reason>."""

    def resolve(ua: Column) -> Column:
        reason = F.when(
            profile_id == "custom",
            F.when(
                ua == "",
                "The custom agent is blank, so the default one is kept.",
            )
            .when(
                F.length(ua) > MAX_CUSTOM_UA_CHARS,
                F.concat(
                    F.lit(f"The custom agent is longer than {MAX_CUSTOM_UA_CHARS} characters ("),
                    F.length(ua).cast("string"),
                    F.lit(" given), so the default one is kept."),
                ),
            )
            .when(
                ua.rlike(r"[\x00-\x1f\x7f]"),
                "The custom agent holds control characters, so the default one is kept.",
            ),
        )
        custom_ok = (profile_id == "custom") & reason.isNull()
        bot = profile_id == "googlebot-style"
        return F.struct(
            F.when(custom_ok, "custom")
            .when(bot, "googlebot-style")
            .otherwise("browser-default")
            .alias("profile_id"),
            F.when(custom_ok, "Custom")
            .when(bot, "Googlebot-style (static)")
            .otherwise("Browser default")
            .alias("label"),
            F.when(custom_ok, ua).when(bot, GOOGLEBOT_STYLE_UA).alias("user_agent"),
            F.when(custom_ok | bot, "extension-fetch-header").otherwise("none").alias("method"),
            reason.alias("fallback_reason"),
        )

    return let(browser_trim(F.coalesce(custom, F.lit(""))), resolve)
