"""Sessions, sinks, comparisons, streaming, against small fixtures and brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sitelens.operators import asof, compare, fetchlog
from sitelens.schemas import NAV_EVENTS
from sitelens.sources import sessions as S
from sitelens.sources import sinks
from sitelens.sources.session_table import SessionTable
from sitelens.streaming import navigation as N


def session(version=4, **changes):
    doc = {
        "schemaVersion": version, "id": "a", "createdAt": "2026-01-01T00:00:00.000Z", "updatedAt": "2026-01-01T00:00:00.000Z",
        "tabUrl": "https://s/", "finalUrl": "https://s/", "captureTime": "2026-01-01T00:00:00.000Z", "extensionVersion": "1",
        "featureAvailability": {"domCollector": True}, "snapshots": [], "findings": [], "captureErrors": [],
        "checkSelection": {"selectedCheckIds": ["x"], "skippedChecks": []}, "reportMarkdown": "n",
    }
    doc.update(changes)
    return json.dumps({k: v for k, v in doc.items() if v is not None})


EVIDENCE = {"id": "e", "kind": "dom", "source": "title", "value": {"state": "present", "value": "T", "selector": "title"}, "capturedAt": "2026-01-01T00:00:00Z"}
FINDING = {k: "x" for k in ("id", "ruleId", "category", "affectedUrl", "description", "recommendation", "sourceRef")} | {
    "severity": "error", "evidenceIds": ["e"], "capturedAt": "2026-01-01T00:00:00Z"
}


def snapshot(value=None, historical=False, **changes):
    applied = dict.fromkeys(("maxStringChars", "maxMetaItems", "maxAlternateItems", "maxJsonLdChars", "maxJsonLdScripts", "maxHeadingSamplesPerLevel"), 5)
    limits = {"schemaVersion": 1, "applied": applied, "maxSnapshotChars": 5, "maxSessionChars": 5, "domEvidenceSchemaVersion": 1 if historical else 2}
    row = EVIDENCE | ({} if value is None else {"value": value}) | changes
    return [{"id": "s", "url": "u", "capturedAt": "2026-01-01T00:00:00.000Z", "evidence": [row], "captureLimits": limits}]


def field(source, value):
    return session(4, snapshots=snapshot({"state": "present", "value": value, "selector": "x"}, source=source))


# raw -> the first issue, None if it is valid.
SESSIONS = [
    (session(1), None), (session(3), None), (session(4, checkSelection=None), None), (session(5), "schemaVersion: is none of the known values"),
    (session(4, tabUrl=None), "tabUrl: is missing"), (session(4, tabUrl=""), "tabUrl: is empty"), (session(4, captureTime="yesterday"), "captureTime: is no date and time"),
    (session(4, captureTime="2026-13-01T00:00:00Z"), "captureTime: is no date and time"),
    (session(4, featureAvailability={"a": "maybe"}), "featureAvailability.a: is none of the known values"), (session(4, featureAvailability={"a": "unavailable"}), None),
    ("{broken", "(root): is no JSON value"), ("[1]", "(root): is no object"), (session(4, findings={}), "findings: is no list"), (session(4, findings=[FINDING]), None),
    (session(4, findings=[FINDING, FINDING | {"severity": "fatal"}]), "findings.1.severity: is none of the known values"),
    (session(4, findings=[FINDING | {"evidenceIds": ["a", 5]}]), "findings.0.evidenceIds.1: is no text"),
    (session(4, captureErrors=[{"id": "a"}]), "captureErrors.0.code: is missing"),
    (session(4, snapshots=snapshot()), None), (session(4, snapshots=snapshot(["not", "a", "field"])), "snapshots.0.evidence.0.value: is no object"),
    (session(4, snapshots=snapshot({"state": "present", "value": ["no"], "selector": "title"})), "snapshots.0.evidence.0.value.value: is no text"),
    (session(4, snapshots=snapshot({"state": "present", "value": "T"})), "snapshots.0.evidence.0.value.selector: is missing"),
    (session(4, snapshots=snapshot({"state": "odd"})), "snapshots.0.evidence.0.value.state: is none of the known values"),
    (session(4, snapshots=snapshot({"state": "odd"}, historical=True)), None), (session(4, snapshots=snapshot({"state": "odd"}, kind="header")), None),
    (session(4, snapshots=snapshot(source="document.title")), "snapshots.0.evidence.0.source: is no known source"),
    (session(4, snapshots=snapshot({"state": "duplicate", "values": ["a", 1], "selectors": ["x"], "count": 2})), "snapshots.0.evidence.0.value.values.1: is no text"),
    (session(4, snapshots=snapshot({"state": "duplicate", "values": [], "selectors": [], "count": 0})), "snapshots.0.evidence.0.value.count: is below 1"),
    (field("link[rel=canonical]", {"href": "a", "absolute": "b"}), None), (field("link[rel=canonical]", {"href": "a"}), "snapshots.0.evidence.0.value.value.absolute: is missing"),
    (field("img", {"total": 1.5, "withAlt": 0, "emptyAlt": 0, "missingAlt": 0, "inventory": []}), "snapshots.0.evidence.0.value.value.total: is no whole number"),
    (field("img", {"total": 1, "withAlt": 1, "emptyAlt": 0, "missingAlt": 0, "inventory": [{"src": "", "alt": None, "altState": "?"}]}), "snapshots.0.evidence.0.value.value.inventory.0.altState: is none of the known values"),
    (field("meta[property^=og:]", [{"key": "a", "content": "b"}, {"key": "a"}]), "snapshots.0.evidence.0.value.value.1.content: is missing"),
    (session(4, snapshots=snapshot({"documentUrl": "u", "baseUri": 5}, source="document.URL")), "snapshots.0.evidence.0.value.baseUri: is no text"),
    (session(4, checkSelection={"selectedCheckIds": ["x"], "skippedChecks": [{"checkId": "a"}]}), "checkSelection.skippedChecks.0.reason: is missing"),
    (session(2, checkSelection={"selectedCheckIds": 5}), None), (session(4, variantTestRun=7), "variantTestRun: is no object"), (session(4, reportMarkdown=7), "reportMarkdown: is no text"),
]


def test_session_shapes_migration_and_quarantine(spark):
    rows = [(str(k), raw) for k, (raw, _) in enumerate(SESSIONS)]
    good, bad = S.load(spark.createDataFrame(rows, "session_id string, raw string"))
    found = {int(r.session_id): r.reason.removeprefix("Schema validation failed: ").split(";")[0] for r in bad.collect()}
    assert found == {k: issue for k, (_, issue) in enumerate(SESSIONS) if issue}
    notes = {int(r.session_id): (r.recording_note, r.schema_version) for r in good.select("session_id", "recording_note", "schema_version").collect()}
    assert set(notes) == {k for k, (_, issue) in enumerate(SESSIONS) if not issue}
    assert (notes[0], notes[1], notes[2]) == ((S.HISTORICAL_NOTE, 4), (None, 4), (S.MISSING_NOTE, 4))


@pytest.mark.parametrize(
    "payload,found",
    [('{"a":{"bodyText":1}}', True), ('{"a":"bodyText: x"}', False), ('{"a":"\\"html\\": x"}', False), ('{"html" : 1}', True), ('[{"x":[{"body":""}]}]', True), ('{"bodyHash":1}', False), ('{"bod\\u0079Text":1}', True)],
)
def test_raw_body_keys_at_any_depth(spark, payload, found):
    df = spark.createDataFrame([(payload,)], "p string")
    assert df.select(S.holds_raw_body(F.col("p")).alias("x")).first().x is found


def test_session_table_reads_back_what_was_written(spark, tmp_path):
    raw = [(k, session(4, snapshots=[], reportMarkdown=f"of {k}")) for k in "abcdef"]
    good, _ = S.load(spark.createDataFrame(raw, "session_id string, raw string"))
    table = SessionTable(spark, str(tmp_path / "t"), good.schema, buckets=4)
    assert table.read().count() == 0
    table.load(good)
    first = table.manifest()["files"]
    table.save(good.filter("session_id = 'a'").withColumn("report_markdown", F.lit("new")), "2026-03-01T00:00:00.000Z")
    assert sum(first[b] != f for b, f in table.manifest()["files"].items()) == 1  # one bucket was touched
    table.delete(spark.createDataFrame([("b",), ("zz",)], "session_id string"), "2026-03-01T00:00:00.000Z")
    table.load(good.filter("session_id = 'b'"))  # older than the deletion
    rows = {r.session_id: r.report_markdown for r in table.read().collect()}
    assert rows == {"a": "new"} | {k: f"of {k}" for k in "cdef"}
    assert table.read(version=1).count() == 6 and table.read().columns == good.columns
    # Two rows of one id and time: the larger content, whatever the order.
    twice = good.filter("session_id = 'c'").withColumn("updated_at", F.lit("2026-04-01T00:00:00.000Z"))
    seen = set()
    for texts in (("x", "y"), ("y", "x")):
        for text in texts:
            table.load(twice.withColumn("report_markdown", F.lit(text)))
        seen |= {r.report_markdown for r in table.read().filter("session_id = 'c'").collect()}
    assert len(seen) == 1
    assert SessionTable(spark, str(tmp_path / "t")).version() == table.version()


def test_session_table_applies_a_change_anew_after_a_conflict(spark, tmp_path):
    good, _ = S.load(spark.createDataFrame([(k, session(4, snapshots=[])) for k in "ab"], "session_id string, raw string"))
    one = SessionTable(spark, str(tmp_path / "t"), good.schema, buckets=1)
    two = SessionTable(spark, str(tmp_path / "t"))
    publish, calls = one._publish, []

    def late(version, manifest):
        if not calls:
            calls.append(version)
            two.load(good.filter("session_id = 'b'"))  # another writer makes this version first
        return publish(version, manifest)

    one._publish = late
    one.load(good.filter("session_id = 'a'"))
    assert {r.session_id for r in one.read().collect()} == {"a", "b"} and one.version() == 2


def test_csv_sink_quotes_by_rfc_4180(spark, tmp_path):
    rows = spark.createDataFrame([("https://s/a,b", 'say "hi"', "x", "y")], "link string, anchor string, type string, source string")
    sinks.write_csv(rows, str(tmp_path / "c"))
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert '"https://s/a,b","say ""hi""",x,y' in text
    line = rows.select(sinks.csv_lines(rows).alias("l")).first().l
    assert line == '"https://s/a,b","say ""hi""",x,y'


def test_asof_against_brute_force(spark):
    rng = random.Random(7)
    base = dt.datetime(2026, 1, 1)
    seen = [(rng.randrange(3), base + dt.timedelta(seconds=rng.randrange(20_000)), f"v{i}") for i in range(120)]
    asks = [(i, rng.randrange(4), base + dt.timedelta(seconds=rng.randrange(20_000))) for i in range(80)]
    left = spark.createDataFrame(asks, "id int, k int, t timestamp")
    right = spark.createDataFrame(seen, "k int, t timestamp, v string")
    got = asof.last_before(left, right, "k", F.col("t"), F.col("t"), F.struct("v"), "hit", bucket_seconds=600).collect()
    for r in got:
        before = [(t, v) for k, t, v in seen if k == r.k and t <= r.t]
        newest = {v for t, v in before if t == max(before)[0]} if before else {None}
        assert (r.hit.v if r.hit else None) in newest
    assert len(got) == len(asks)


def follow(url: str, asked: int, hops: list[tuple]) -> tuple[list[str], bool]:
    """Hops one by one, each as the log stood at the time of the request."""
    path, seen = [], {url}
    while known := [(t, -ord(to[0]), to) for a, to, t in hops if a == url and t <= asked]:
        newest = max(t for t, _, _ in known)
        url = min(to for t, _, to in known if t == newest)
        path.append(url)
        if url in seen:
            return path, True
        seen.add(url)
    return path, False


def test_redirect_chains_against_brute_force(spark):
    hops = [(f"u{i}", f"u{i + 1}", 5) for i in range(3)] + [(f"t{i}", f"t{i + 1}", 5) for i in range(12)]
    hops += [(f"l{i}", f"l{i + 1}", i) for i in range(200)] + [("p", "q", 5), ("q", "p", 5), ("s", "s", 1), ("z", "y", 3), ("z", "x", 3)]
    # Elsewhere later, a circle that closes later, and back again.
    hops += [("m", "u0", 10), ("m", "t5", 20), ("m", "u0", 30), ("t12", "m", 25), ("l200", "l150", 500), ("l150", "m", 600), ("in", "m", 0)]
    urls = ["u0", "u2", "u3", "t0", "l0", "l190", "p", "s", "z", "m", "in", "none", "l150"]
    asked = [-1, 4, 5, 12, 22, 26, 31, 300, 550, 700]
    reqs = [(i, u, t) for i, (u, t) in enumerate((u, t) for u in urls for t in asked)]
    epoch = F.timestamp_seconds(F.col("t") + 1_700_000_000)
    requests = spark.createDataFrame(reqs, "request_id int, requested_url string, t int").withColumn("requested_at", epoch)
    log = spark.createDataFrame([(a, b, 301, t) for a, b, t in hops], "from_url string, to_url string, status int, t int")
    rows = fetchlog.resolve_chains(requests.drop("t"), log.withColumn("observed_at", epoch).drop("t")).collect()
    want = {i: follow(u, t, hops) for i, u, t in reqs}
    assert {r.request_id: (r.hop_urls, r.looped) for r in rows} == want
    assert all(r.final_url == (r.hop_urls or [reqs[r.request_id][1]])[-1] and r.hop_count == len(r.hop_urls) for r in rows)
    # Without times the log counts as one state; a limit is cut off where it is asked for.
    few = log.where("from_url LIKE 't%' OR from_url LIKE 'p'").drop("t")
    got = {r.request_id: r for r in fetchlog.resolve_chains(requests.drop("t", "requested_at"), few.where("to_url <> 'm'"), 10).collect()}
    r = got[urls.index("t0") * len(asked)]
    assert (r.final_url, r.hop_count, r.limit_reached) == ("t10", 10, True)
    assert fetchlog.resolve_chains(requests.drop("t"), log.where("false").drop("t")).where("hop_count > 0 OR looped").count() == 0


SOFT = [
    ("<title>Shop</title><p>alpha beta gamma", "<title>Shop</title><p>alpha beta gamma", 200, {"identical-body-hash", "similar-content", "spa-fallback"}),
    ("<p>alpha beta gamma", "<title>404 Not Found</title><p>nothing", 200, {"error-template-title"}),
    ("<p>alpha beta gamma", "<p>alpha beta gamma", 404, set()),
    ("<p>alpha beta gamma delta", "<p>one two three four five", 200, set()),
]


@pytest.mark.parametrize("audited,probe,status,kinds", SOFT)
def test_soft404(spark, audited, probe, status, kinds):
    rows = [
        (1, "audited", "https://s/a", "https://s/a", 200, None, audited, len(audited)),
        (1, "probe", "https://s/z", "https://s/z", status, None, probe, len(probe)),
    ]
    caps = spark.createDataFrame(rows, "pair_id int, role string, requested_url string, final_url string, status int, fetch_error string, body string, body_bytes int")
    got = {r.kind for r in compare.soft404_observations(compare.soft404_pairs(caps)).collect()}
    assert got == kinds


T0 = dt.datetime(2026, 1, 1)


def ev(seq, kind, url="https://s/a", redirect=None, status=200, headers=(), tab=1, req="r", frame="main_frame"):
    return (tab, req, seq, kind, frame, url, redirect, status, [(n, v) for n, v in headers], T0 + dt.timedelta(seconds=seq))


SEQUENCES = [
    [ev(0, "watch"), ev(1, "headers", headers=[("Content-Type", "text/html"), ("X-Robots-Tag", "a"), ("x-robots-tag", "b"), ("Server", "s")]), ev(2, "completed")],
    [ev(0, "watch"), ev(1, "headers", status=301), ev(2, "redirect", redirect="https://s/b", status=301), ev(3, "headers", url="https://s/b"), ev(4, "completed", url="https://s/b", status=404)],
    [ev(1, "headers"), ev(2, "completed")],
    [ev(0, "watch"), ev(1, "headers"), ev(2, "unwatch"), ev(3, "completed")],
    [ev(0, "watch"), ev(1, "headers"), ev(2, "error")],
    [ev(0, "watch"), ev(1, "completed", frame="sub_frame")],
    [ev(0, "watch"), ev(1, "completed", status=204)],
]
EXPECTED = [
    [("https://s/a", "https://s/a", 200, "", "content-type=text/html|x-robots-tag=a, b")],
    [("https://s/a", "https://s/b", 404, "https://s/a>https://s/b>301", "")],
    [], [], [], [],
    [("https://s/a", "https://s/a", 204, "", "")],
]


def _events(spark):
    rows = [(i,) + e[1:] for i, seq in enumerate(SEQUENCES) for e in seq]
    return spark.createDataFrame(rows, NAV_EVENTS)


def _check(rows):
    got = {}
    for r in rows:
        got.setdefault(r.tab_id, []).append((r.requested_url, r.final_url, r.status_code, r.hops, r.headers))
    assert [got.get(i, []) for i in range(len(SEQUENCES))] == EXPECTED


def test_navigation_batch(spark):
    _check(N.assemble(_events(spark)).collect())


def test_navigation_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", N.ROCKSDB)
    _events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = N.navigation_stream(spark.readStream.schema(NAV_EVENTS).parquet(str(tmp_path / "in")))
    N.write_observations(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    _check(out.collect())
    assert N.latest_per_tab(out).count() == 3


def test_navigation_batch_and_stream_agree(spark, tmp_path):
    """A second watch, requests that interleave, an error after the end, a request tried again."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", N.ROCKSDB)
    b = "https://s/b"
    sequences = [
        [ev(0, "watch"), ev(1, "redirect", redirect=b, status=301), ev(2, "watch"), ev(3, "completed", url=b)],
        [ev(0, "watch"), ev(1, "redirect", redirect=b, status=301), ev(2, "headers", url=b, req="q"), ev(3, "completed", url=b), ev(4, "completed", req="q")],
        [ev(0, "watch"), ev(1, "completed"), ev(2, "error")],
        [ev(0, "watch"), ev(1, "redirect", redirect=b, status=301), ev(2, "error"), ev(3, "headers", url=b, headers=[("vary", "x")]), ev(4, "completed", url=b)],
        [ev(0, "watch"), ev(1, "completed"), ev(2, "completed", url=b), ev(3, "unwatch"), ev(4, "watch"), ev(5, "completed", url=b)],
    ]
    events = spark.createDataFrame([(i,) + e[1:] for i, seq in enumerate(sequences) for e in seq], NAV_EVENTS)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = N.navigation_stream(spark.readStream.schema(NAV_EVENTS).parquet(str(tmp_path / "in")))
    N.write_observations(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = N.assemble(events)
    streamed = spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)
    assert sorted(batch.collect(), key=str) == sorted(streamed.collect(), key=str)
    assert [sum(r.tab_id == i for r in batch.collect()) for i in range(5)] == [1, 2, 1, 1, 3]


def test_navigation_stream_over_micro_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", N.ROCKSDB)
    long = "x" * 3_000
    parts = [
        [ev(0, "watch")],
        [ev(1, "headers", headers=[("Link", long)], status=301), ev(2, "redirect", redirect="https://s/b", status=301)],
        [ev(3, "headers", url="https://s/b", headers=[("vary", "a")])],
        [ev(4, "completed", url="https://s/b")],
    ]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(NAV_EVENTS).parquet(str(tmp_path / "in"))
    for part in parts:
        spark.createDataFrame(part, NAV_EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        N.write_observations(N.navigation_stream(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = N.assemble(spark.createDataFrame(sum(parts, []), NAV_EVENTS))
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns).collect()
    assert got == want.collect() and got[0].hops == "https://s/a>https://s/b>301" and long in got[0].headers


def test_serving_table_follows_watches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", N.ROCKSDB)
    rows = lambda tab, *events: [(tab,) + e[1:] for e in events]
    parts = [
        rows(1, ev(0, "watch"), ev(1, "completed")) + rows(2, ev(0, "watch"), ev(1, "completed")) + rows(3, ev(0, "watch"), ev(1, "completed")),
        rows(2, ev(2, "unwatch"), ev(3, "completed", url="https://s/unseen")),
        rows(3, ev(4, "unwatch"), ev(5, "watch"), ev(6, "completed", url="https://s/again")),
        rows(4, ev(6, "watch"), ev(7, "unwatch")),
    ]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(NAV_EVENTS).parquet(str(tmp_path / "in"))
    table, seen = N.serving_table(spark, str(tmp_path / "latest"), buckets=8), []
    for part in parts:
        spark.createDataFrame(part, NAV_EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        N.write_latest(N.change_stream(source), table, str(tmp_path / "state")).awaitTermination()
        seen.append({r.tab_id: r.final_url for r in N.read_latest(table).collect()})
    a, again = "https://s/a", "https://s/again"
    assert seen == [{1: a, 2: a, 3: a}, {1: a, 3: a}, {1: a, 3: again}, {1: a, 3: again}]
    # A batch touches the buckets of its tabs, and nothing changes if it comes again.
    first, second = table.manifest(1)["files"], table.manifest(2)["files"]
    assert sum(first.get(b) != f for b, f in second.items()) == 1
    every = spark.createDataFrame(sum(parts, []), NAV_EVENTS)
    assert {r.tab_id: r.final_url for r in N.latest_watched(N.assemble(every), every).collect()} == seen[-1]
    rows = spark.createDataFrame([(1, "r", a, "https://s/old", 200, "", "", every.agg(F.min("ts")).first()[0], 0, False)], N.CHANGE)
    table.apply(N.serving_rows(rows))
    assert {r.tab_id: r.final_url for r in N.read_latest(table).collect()} == seen[-1]


def test_a_tab_takes_few_calls_of_its_state():
    """Rows come as rows, and what didn't change isn't written: each call is a trip to the state store."""

    class State:
        def __init__(self):
            self.value, self.calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    def run(*events):
        job = N.TabNavigation()
        job._state, job._handle = state, None
        names = [f.name for f in NAV_EVENTS] + ["at"]
        rows = [Row(*names)(*e, int(e[-1].replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)) for e in events]
        return list(job.handleInputRows((1,), iter(rows), None))

    state = State()
    assert run(ev(1, "completed"), ev(0, "headers")) == [] and state.calls == ["get"]
    out = run(ev(4, "completed"), ev(3, "redirect", redirect="https://s/b", status=301), ev(2, "watch"))
    assert [(r.final_url, r.hops) for r in out] == [("https://s/a", "https://s/a>https://s/b>301")]
    state.calls.clear()
    assert len(run(ev(5, "completed"))) == 1 and state.calls == ["get"]
