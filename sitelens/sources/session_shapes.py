"""The shape of a stored session: fixed values and formats that stored documents have to match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.expr import let
from sitelens.functions.shapes import (
    Also,
    Anything,
    Either,
    Flag,
    ListOf,
    Nullable,
    Object,
    Record,
    Shape,
    Tagged,
    Text,
    Whole,
    as_list,
    as_object,
    member,
    none,
    one,
    under,
)
from sitelens.limits import UNLIMITED, CaptureLimits

TIME, NAME = Text(time=True), Text(least=1)
EVIDENCE_KINDS = ("dom", "header", "network", "robots", "sitemap", "other")
SEVERITIES = ("info", "warning", "error", "critical")
HISTORICAL = 1


def _most(n: int) -> int | None:
    return None if n == UNLIMITED else n


def value_shapes(limits: CaptureLimits) -> dict[str, tuple[Shape, Shape | None]]:
    """source -> shape of a present value, and of each of a duplicate's values if it can be one."""
    text, selector = Text(most=_most(limits.string_chars)), Text(least=1, most=_most(limits.string_chars))
    maybe = Nullable(text)
    robots = Object({"name": text, "content": text, "selector": selector})
    link = Object({"href": text, "absolute": maybe, "selector": selector}, {"detail": text})
    alternate = Object({"href": text, "hreflang": text, "absolute": maybe, "selector": selector}, {"detail": text})
    group = ListOf(Object({"key": text, "content": text}), _most(limits.meta_items))
    levels = tuple(f"h{k}" for k in range(1, 7))
    landmarks = ("main", "nav", "header", "footer", "article", "section", "aside")
    return {
        "title": (text, text),
        "meta[name=description]": (text, text),
        "meta[name=robots|googlebot]": (robots, robots),
        "link[rel=canonical]": (Object({"href": text, "absolute": text}), link),
        "link[rel=alternate][hreflang]": (ListOf(alternate, _most(limits.alternate_items)), None),
        "meta[property^=og:]": (group, None),
        "meta[name^=twitter:]": (group, None),
        "html[lang]": (text, text),
        "meta[name=viewport]": (text, text),
        "h1-h6": (
            Object({"levels": Object({k: Whole() for k in levels}), "samples": ListOf(Object({"level": Text(among=levels), "text": text}))}),
            None,
        ),
        "a[href]": (
            Object(
                {k: Whole() for k in ("total", "internal", "external", "other")}
                | {"inventory": ListOf(Object({"href": text, "absolute": maybe, "text": text}))}
            ),
            None,
        ),
        "img": (
            Object(
                {k: Whole() for k in ("total", "withAlt", "emptyAlt", "missingAlt")}
                | {"inventory": ListOf(Object({"src": text, "alt": maybe, "altState": Text(among=("missing", "empty", "present"))}))}
            ),
            None,
        ),
        "html5-landmarks": (
            Object({"doctype": maybe, "counts": Object({k: Whole() for k in landmarks}), "hasMain": Flag(), "landmarkTotal": Whole()}),
            None,
        ),
        "script[type=application/ld+json]": (
            ListOf(
                Object(
                    {
                        "index": Whole(),
                        "selector": selector,
                        "raw": Text(most=_most(limits.jsonld_chars)),
                        "truncated": Flag(),
                        "parseStatus": Text(among=("ok", "invalid-json", "empty", "truncated")),
                    },
                    {"parseDetail": text},
                ),
                _most(limits.jsonld_scripts),
            ),
            None,
        ),
    }


def evidence_value(limits: CaptureLimits):
    """Issues of an evidence row's value, which depend on its source; an unknown source is one."""
    text, selector = Text(most=_most(limits.string_chars)), Text(least=1, most=_most(limits.string_chars))
    cut = Object({"truncated": Flag(only=True), "reason": selector}, {"omittedCount": Whole()})
    # What all fields share, whatever their values are.
    state = Tagged(
        "state",
        {
            "absent": Object({}),
            "inaccessible": Object({"detail": selector}),
            "empty": Object({"raw": text, "selector": selector}),
            "malformed": Object({"raw": text, "selector": selector, "detail": selector}),
            "present": Object({"value": Anything(), "selector": selector}, {"raw": text, "count": Whole(), "limits": cut}),
            "duplicate": Object(
                {"values": ListOf(Anything(), _most(limits.meta_items)), "selectors": ListOf(selector, _most(limits.meta_items)), "count": Whole(least=1)},
                {"limits": cut},
            ),
        },
    )
    url = Text(most=_most(limits.url_chars))
    bound = Object({"truncated": Flag(only=True), "reason": selector, "originalLength": Whole(least=1)})
    others = {
        "document.URL": Object({"documentUrl": url, "baseUri": url}, {"bounds": Object({}, {"documentUrl": bound, "baseUri": bound})}),
        "capture.limits": Object(
            {"truncated": Flag(only=True), "fields": ListOf(Object({"source": selector, "reason": selector}, {"omittedCount": Whole()}))}
        ),
    }
    fields = value_shapes(limits)

    def by_source(source: Column, value: Column) -> Column:
        def own(name: Column) -> Column:
            out = F
            for known, (single, several) in fields.items():
                several = ListOf(several) if several else None
                wrong = under(F.lit(".state"), one("is none of the known values"))
                found = F.when(name == "present", under(F.lit(".value"), single.issues(member(value, "value")))).when(
                    name == "duplicate", under(F.lit(".values"), several.issues(member(value, "values"))) if several else wrong
                )
                out = out.when(source == known, found.otherwise(none()))
            return out.otherwise(none())

        rule = Also(state, lambda v: let(F.try_variant_get(v, "$.state", "string"), own))
        out = F.when(source.isin(*fields), under(F.lit(".value"), rule.issues(value)))
        for known, shape in others.items():
            out = out.when(source == known, under(F.lit(".value"), shape.issues(value)))
        return out.otherwise(under(F.lit(".source"), one("is no known source")))

    return by_source


def session_shape(limits: CaptureLimits) -> Shape:
    """A session of any supported version, as it is after it was brought to the current one."""
    positive = Whole(least=1)
    capture_limits = Object(
        {
            "schemaVersion": Whole(among=(1,)),
            "applied": Object(
                {k: positive for k in ("maxStringChars", "maxMetaItems", "maxAlternateItems", "maxJsonLdChars", "maxJsonLdScripts", "maxHeadingSamplesPerLevel")},
                {k: positive for k in ("maxUrlChars", "maxLinkInventory", "maxImageInventory")},
            ),
            "maxSnapshotChars": positive,
            "maxSessionChars": positive,
        },
        {"domEvidenceSchemaVersion": Whole(among=(1, 2))},
    )
    evidence = Object({"id": NAME, "kind": Text(among=EVIDENCE_KINDS), "source": NAME, "capturedAt": TIME}, {"value": Anything()})
    snapshot = Object({"id": NAME, "url": NAME, "capturedAt": TIME, "evidence": ListOf(evidence)}, {"captureLimits": capture_limits})
    by_source = evidence_value(limits)

    def dom_values(value: Column) -> Column:
        """DOM evidence of a snapshot that isn't marked historical fits its source."""

        def row_issues(row: Column, i: Column) -> Column:
            content = F.coalesce(member(row, "value"), F.parse_json(F.lit("null")))
            found = let(F.try_variant_get(row, "$.source", "string"), lambda s: let(content, lambda v: by_source(s, v)))
            at = F.concat(F.lit(".evidence."), i.cast("string"))
            return F.when(F.try_variant_get(row, "$.kind", "string") == "dom", under(at, found)).otherwise(none())

        marked = F.try_variant_get(value, "$.captureLimits.domEvidenceSchemaVersion", "int")
        checked = F.flatten(F.transform(as_list(member(value, "evidence")), row_issues))
        return F.when(marked.eqNullSafe(F.lit(HISTORICAL)), none()).otherwise(checked)

    finding = Object(
        {k: NAME for k in ("id", "ruleId", "category", "affectedUrl", "description", "recommendation", "sourceRef")}
        | {"severity": Text(among=SEVERITIES), "evidenceIds": ListOf(NAME), "capturedAt": TIME}
    )
    error = Object({k: NAME for k in ("id", "code", "source", "message")} | {"capturedAt": TIME}, {"url": Text()})
    selection = Object(
        {"selectedCheckIds": ListOf(NAME), "skippedChecks": ListOf(Object({"checkId": NAME, "reason": NAME}))}, {"recordingNote": NAME}
    )
    header = Object(
        {"schemaVersion": Whole(among=(1, 2, 3, 4))}
        | {k: NAME for k in ("id", "tabUrl", "finalUrl", "extensionVersion")}
        | {k: TIME for k in ("createdAt", "updatedAt", "captureTime")}
        | {"featureAvailability": Record(Either((Flag(), Text(among=("unavailable",))))), "findings": ListOf(finding), "captureErrors": ListOf(error)},
        {"variantTestRun": Object({}), "soft404ProbeRun": Object({})},
    )
    modern = Object({}, {"reportMarkdown": Text()})

    def by_version(value: Column) -> Column:
        version = F.try_variant_get(value, "$.schemaVersion", "int")

        def snapshots(old: Column) -> Column:
            # The first version had no limits; a snapshot without them counts as historical.
            def each(s: Column, i: Column) -> Column:
                bare = old & member(s, "captureLimits").isNull()
                own = let(snapshot.issues(s), lambda found: F.when((F.size(found) > 0) | bare, found).otherwise(dom_values(s)))
                return under(F.concat(F.lit(".snapshots."), i.cast("string")), own)

            return let(
                as_list(member(value, "snapshots")),
                lambda items: F.when(items.isNull(), under(F.lit(".snapshots"), one("is no list"))).otherwise(F.flatten(F.transform(items, each))),
            )

        # A selection that is no object at all counts as not recorded.
        chosen = let(
            member(value, "checkSelection"),
            lambda v: F.when(as_object(v).isNotNull() | as_list(v).isNotNull(), selection.issues(v)).otherwise(none()),
        )
        recent = F.concat(modern.issues(value), under(F.lit(".checkSelection"), chosen))
        return F.concat(let(version == 1, snapshots), F.when(version <= 2, none()).otherwise(recent))

    return Also(header, by_version)
