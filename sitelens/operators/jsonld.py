"""JSON-LD: the node tree of every script as rows, with bounded depth.

Each parsed script is walked level by level inside one ``aggregate``: the
state is the frontier of values still to open plus the nodes found so far.
There is no recursion across stages and no shuffle; depth and node limits make
the state of one script bounded.  Object members come in key order (VARIANT
keeps no other), arrays in array order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.expr import browser_trim, cached_columns, clip, computed_once, let
from sitelens.limits import DEFAULT_CAPTURE, CaptureLimits
from sitelens.operators.facts import json_value

NODE_TYPE = (
    "struct<sort:string,path:string,depth:int,types:array<string>,id:string,"
    "id_only:boolean,graph_node:boolean>"
)
OPEN_TYPE = "struct<sort:string,path:string,v:variant,depth:int,graph_node:boolean>"


def _kind(v: Column) -> Column:
    """object / array / string / other, from the value's own schema."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT<"), "object")
        .when(s.startswith("ARRAY<"), "array")
        .when(s == "STRING", "string")
        .otherwise("other")
    )


def _member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f'$["{key}"]', "variant")


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "string", F.try_variant_get(v, "$", "string"))


def _array(v: Column) -> Column:
    return F.when(_kind(v) == "array", F.try_variant_get(v, "$", "array<variant>"))


def _object(v: Column) -> Column:
    return F.when(_kind(v) == "object", F.try_variant_get(v, "$", "map<string,variant>"))


def _context_status(v: Column) -> Column:
    """valid / missing / malformed for one @context value (NULL when not there)."""

    def usable(x: Column) -> Column:
        return (_kind(x) == "object") | (browser_trim(F.coalesce(_text(x), F.lit(""))) != "")

    items = _array(v)
    return (
        F.when(v.isNull(), "missing")
        .when(usable(v), "valid")
        .when((F.size(items) > 0) & F.forall(items, usable), "valid")
        .otherwise("malformed")
    )


def _types(v: Column, chars: int) -> Column:
    one = _text(v)
    many = F.filter(F.transform(_array(v), _text), lambda t: t.isNotNull())
    listed = F.when(one.isNotNull(), F.array(one)).otherwise(
        F.coalesce(many, F.array().cast("array<string>"))
    )
    return F.transform(listed, lambda t: clip(t, chars))


def _step(state: Column, limits: CaptureLimits) -> Column:
    """Open every frontier value once: record its node, queue its children."""

    def pad(i: Column) -> Column:
        return F.lpad(i.cast("string"), 10, "0")

    def children(item: Column) -> Column:
        of_array = F.transform(
            _array(item["v"]),
            lambda x, i: F.struct(
                F.concat(item["sort"], F.lit("."), pad(i)).alias("sort"),
                F.concat(item["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"),
                x.alias("v"),
                (item["depth"] + 1).alias("depth"),
                F.lit(False).alias("graph_node"),
            ),
        )
        entries = F.filter(
            F.map_entries(_object(item["v"])), lambda e: e["key"] != "@context"
        )
        of_object = F.transform(
            entries,
            lambda e, i: F.struct(
                F.concat(item["sort"], F.lit("."), pad(i)).alias("sort"),
                F.concat(item["path"], F.lit("."), e["key"]).alias("path"),
                e["value"].alias("v"),
                (item["depth"] + 1).alias("depth"),
                F.lit(False).alias("graph_node"),
            ),
        )
        return F.coalesce(of_array, of_object, F.array().cast(f"array<{OPEN_TYPE}>"))

    objects = F.filter(state["open"], lambda i: _kind(i["v"]) == "object")
    nodes = F.transform(
        objects,
        lambda i: F.struct(
            i["sort"].alias("sort"),
            i["path"].alias("path"),
            i["depth"].alias("depth"),
            _types(_member(i["v"], "@type"), limits.string_chars).alias("types"),
            clip(_text(_member(i["v"], "@id")), limits.string_chars).alias("id"),
            (
                (F.size(_object(i["v"])) == 1)
                & _member(i["v"], "@id").isNotNull()
            ).alias("id_only"),
            i["graph_node"].alias("graph_node"),
        ),
    )
    return F.struct(
        F.flatten(F.transform(state["open"], children)).alias("open"),
        F.concat(state["nodes"], nodes).alias("nodes"),
    )


@cached_columns
def _inventory_columns(limits: CaptureLimits) -> tuple[list[Column], ...]:
    value = json_value(browser_trim(F.col("raw")))
    staged = [F.when(F.col("parse_status") == "ok", value).alias("v"), F.col("raw")]

    v = F.col("v")
    graph = _member(v, "@graph")
    roots = (
        F.when(_kind(v) == "object", F.coalesce(_array(graph), F.array(v)))
        .when(_kind(v) == "array", _array(v))
        .otherwise(F.array().cast("array<variant>"))
    )
    members = F.filter(_array(v), lambda x: _kind(x) == "object")
    statuses = F.transform(members, lambda x: _context_status(_member(x, "@context")))
    combined = (
        F.when(F.array_contains(statuses, "malformed"), "malformed")
        .when((F.size(statuses) == 0) | F.array_contains(statuses, "missing"), "missing")
        .otherwise("valid")
    )
    top = (
        F.when(F.col("parse_status") != "ok", "unknown")
        .when(_kind(v).isin("object", "array"), _kind(v))
        .otherwise("scalar")
    )
    frontier = F.transform(
        roots,
        lambda x, i: F.struct(
            F.lpad(i.cast("string"), 10, "0").alias("sort"),
            F.concat(F.lit("$["), i.cast("string"), F.lit("]")).alias("path"),
            x.alias("v"),
            F.lit(0).alias("depth"),
            F.lit(True).alias("graph_node"),
        ),
    )
    start = F.struct(
        frontier.alias("open"), F.array().cast(f"array<{NODE_TYPE}>").alias("nodes")
    )
    # No value lies deeper than there are brackets; once the frontier is empty a step costs nothing.
    brackets = F.length("raw") - F.length(F.translate("raw", "{[", ""))
    walked = F.aggregate(
        F.sequence(F.lit(0), F.least(brackets, F.lit(limits.jsonld_depth))),
        start,
        lambda s, _d: F.when(F.size(s["open"]) == 0, s).otherwise(_step(s, limits)),
    )
    walk = [
        top.alias("top_level"),
        F.when(_kind(v) == "array", F.size(_array(v)) - F.size(members))
        .when(top == "scalar", 1)
        .otherwise(0)
        .alias("non_object_count"),
        F.when(_kind(v) == "object", _context_status(_member(v, "@context")))
        .when(_kind(v) == "array", combined)
        .alias("context"),
        F.when(
            top.isin("object", "array"),
            let(
                walked,
                lambda w: F.struct(
                    F.array_sort(w["nodes"]).alias("nodes"), (F.size(w["open"]) > 0).alias("deep")
                ),
            ),
        ).alias("w"),
    ]
    return staged, walk


def inventory(scripts: DataFrame, limits: CaptureLimits = DEFAULT_CAPTURE) -> DataFrame:
    """scripts(keys…, raw, parse_status) -> one inventory row per script.

    Adds top_level, non_object_count, context, nodes (first ``jsonld_nodes`` in
    document order), node_count, status (complete / limited / unevaluated) and
    duplicate_ids.  A node whose only member is ``@id`` is a reference, not a
    second definition."""
    keys = [c for c in scripts.columns if c not in ("raw",)]
    staged, walk = _inventory_columns(limits)
    walked = computed_once(
        scripts.select(*keys, *staged), keys, walk
    )
    kept = F.slice("w.nodes", 1, limits.jsonld_nodes)
    long_text = F.exists(
        kept,
        lambda n: (F.length(F.coalesce(n["id"], F.lit(""))) >= limits.string_chars)
        | F.exists(n["types"], lambda t: F.length(t) >= limits.string_chars),
    )
    defined = F.transform(
        F.filter(kept, lambda n: n["id"].isNotNull() & ~n["id_only"]), lambda n: n["id"]
    )
    repeated = let(
        F.array_sort(defined),
        lambda ids: F.array_distinct(
            F.filter(
                ids,
                lambda x, i: (i > 0)
                & (F.coalesce(F.try_element_at(ids, F.greatest(i, F.lit(1))), F.lit("")) == x),
            )
        ),
    )
    evaluated = F.col("parse_status") == "ok"
    limited = (F.size("w.nodes") > limits.jsonld_nodes) | F.col("w.deep") | long_text
    return walked.select(
        *keys,
        "top_level",
        "non_object_count",
        "context",
        F.when(~evaluated, "unevaluated")
        .when(F.coalesce(limited, F.lit(False)), "limited")
        .otherwise("complete")
        .alias("status"),
        kept.alias("nodes"),
        F.when(F.col("w").isNotNull(), F.size(kept)).alias("node_count"),
        repeated.alias("duplicate_ids"),
    )


def scripts_of(facts: DataFrame) -> DataFrame:
    """facts -> page_id, entry_index, parse_status, raw: one row per script."""
    keys = [c for c in ("page_id", "url") if c in facts.columns]
    return facts.select(*keys, F.explode("json_ld.value").alias("e")).select(
        *keys,
        F.col("e.index").alias("entry_index"),
        F.col("e.parse_status").alias("parse_status"),
        F.col("e.raw").alias("raw"),
    )


def nodes_of(inventories: DataFrame) -> DataFrame:
    """One row per node: page_id, entry_index, node_index, path, depth, types, id."""
    return inventories.select(
        "page_id", "entry_index", F.posexplode("nodes").alias("node_index", "n")
    ).select(
        "page_id",
        "entry_index",
        "node_index",
        "n.path",
        "n.depth",
        "n.types",
        "n.id",
        "n.id_only",
        "n.graph_node",
    )


FINDING_TYPE = "array<struct<entry:int,sub:string,rule_id:string,what:string>>"


def structural_findings(inventories: DataFrame) -> DataFrame:
    """Inventory rows -> entry, sub id, rule id, subject text: one row per finding."""
    graph = F.lit("0")
    label = F.concat(F.lit("JSON-LD script #"), (F.col("entry_index") + 1).cast("string"))

    def item(rule: str, sub: Column, what: Column) -> Column:
        return F.struct(
            F.col("entry_index").alias("entry"),
            sub.cast("string").alias("sub"),
            F.lit(rule).alias("rule_id"),
            what.alias("what"),
        )

    entry = F.col("entry_index").cast("string")
    evaluated = F.col("status") != "unevaluated"
    has_graph = F.col("top_level").isin("object", "array")
    untyped = F.filter(
        F.transform(
            "nodes",
            lambda n, i: F.struct(
                i.alias("i"), (n["graph_node"] & (F.size(n["types"]) == 0)).alias("bad")
            ),
        ),
        lambda x: x["bad"],
    )
    single = F.filter(
        F.array(
            F.when(F.col("parse_status") == "truncated", item("jsonld-unevaluated", entry, label)),
            F.when(
                evaluated & ((F.col("top_level") == "scalar") | (F.col("non_object_count") > 0)),
                item("jsonld-top-level-non-object", entry, label),
            ),
            F.when(F.col("status") == "limited", item("jsonld-inventory-limited", entry, label)),
            F.when(
                evaluated & has_graph & (F.col("context") == "missing"),
                item("jsonld-context-missing", F.concat(entry, F.lit("-"), graph), label),
            ),
            F.when(
                evaluated & has_graph & (F.col("context") == "malformed"),
                item("jsonld-context-malformed", F.concat(entry, F.lit("-"), graph), label),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    per_node = F.transform(
        untyped,
        lambda x: item(
            "jsonld-node-missing-type",
            F.concat(entry, F.lit("-0-"), x["i"].cast("string")),
            F.concat(label, F.lit(" node "), (x["i"] + 1).cast("string")),
        ),
    )
    per_id = F.transform(
        "duplicate_ids",
        lambda d, i: item(
            "jsonld-duplicate-id",
            F.concat(entry, F.lit("-0-"), i.cast("string")),
            F.concat(label, F.lit(" @id "), d),
        ),
    )
    none = F.array().cast(FINDING_TYPE)
    rows = F.concat(single, F.coalesce(per_node, none), F.coalesce(per_id, none))
    keys = [c for c in ("page_id", "url") if c in inventories.columns]
    return inventories.select(*keys, F.inline(rows))
