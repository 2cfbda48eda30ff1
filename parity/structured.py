"""Queries over JSON-LD."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity.registry import CTES, query
from sitelens.operators import jsonld as J

CTES["jok"] = "SELECT page_id, pos AS entry_index, raw, CAST(raw AS JSON) AS j, json_type(raw) AS jt FROM jsonld WHERE status = 'ok'"
# Every root of every script: members of @graph, of the top array, or the object itself.
CTES["jroot"] = """SELECT page_id, entry_index, unnest(range(len(l))) AS r, unnest(l) AS v FROM (SELECT page_id, entry_index, CASE WHEN jt = 'OBJECT' AND json_type(j, '$."@graph"') = 'ARRAY' THEN json_extract(j, '$."@graph"[*]')
  WHEN jt = 'OBJECT' THEN [j] WHEN jt = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [] END AS l FROM jok) x"""
CTES["jwalk"] = """SELECT page_id, entry_index, '$[' || r || ']' AS path, lpad(CAST(r AS VARCHAR), 6, '0') AS sort, v, 0 AS depth, true AS graph_node FROM jroot
 UNION ALL /*recursive*/ SELECT w.page_id, w.entry_index, w.path || CASE WHEN json_type(w.v) = 'ARRAY' THEN '[' || e.key || ']' ELSE '.' || e.key END,
  w.sort || '.' || lpad(CASE WHEN json_type(w.v) = 'ARRAY' THEN e.key ELSE CAST(list_position(list_sort(list_filter(json_keys(w.v), lambda k: k <> '@context')), e.key) - 1 AS VARCHAR) END, 6, '0'), e.value, w.depth + 1, false
  FROM jwalk w, json_each(w.v) e WHERE json_type(w.v) IN ('OBJECT','ARRAY') AND e.key <> '@context'"""
CTES["jnode"] = """SELECT page_id, entry_index, row_number() OVER (PARTITION BY page_id, entry_index ORDER BY sort) - 1 AS node_index, path, depth, graph_node,
  CASE json_type(v, '$."@type"') WHEN 'VARCHAR' THEN v->>'$."@type"' WHEN 'ARRAY' THEN array_to_string(list_transform(list_filter(json_extract(v, '$."@type"[*]'), lambda t: json_type(t) = 'VARCHAR'), lambda t: t->>'$'), '|') ELSE '' END AS types,
  CASE WHEN json_type(v, '$."@id"') = 'VARCHAR' THEN v->>'$."@id"' END AS id, json_keys(v) = ['@id'] AS id_only FROM jwalk WHERE json_type(v) = 'OBJECT'"""
CTES["jdup"] = "SELECT page_id, entry_index, id, row_number() OVER (PARTITION BY page_id, entry_index ORDER BY id) - 1 AS i FROM (SELECT page_id, entry_index, id FROM jnode WHERE id IS NOT NULL AND NOT id_only GROUP BY ALL HAVING count(*) > 1) d"


def _ctx(expr: str) -> str:
    good = f"(json_type({expr}) = 'OBJECT' OR (json_type({expr}) = 'VARCHAR' AND trim({expr}->>'$') <> ''))"
    item = "(json_type(x) = 'OBJECT' OR (json_type(x) = 'VARCHAR' AND trim(x->>'$') <> ''))"
    return f"CASE WHEN {expr} IS NULL THEN 'missing' WHEN {good} THEN 'valid' WHEN json_type({expr}) = 'ARRAY' AND json_array_length({expr}) > 0 AND len(list_filter(json_extract({expr}, '$[*]'), lambda x: NOT {item})) = 0 THEN 'valid' ELSE 'malformed' END"


CTES["jctxs"] = f"SELECT page_id, entry_index, list({_ctx('c')}) AS st FROM (SELECT page_id, entry_index, json_extract(x, '$.\"@context\"') AS c FROM (SELECT page_id, entry_index, unnest(json_extract(j, '$[*]')) AS x FROM jok WHERE jt = 'ARRAY') u WHERE json_type(x) = 'OBJECT') v GROUP BY ALL"
CTES["jinv"] = f"""SELECT s.page_id, s.pos AS entry_index, s.status AS parse_status, CASE WHEN s.status <> 'ok' THEN 'unevaluated' ELSE 'complete' END AS status,
  CASE WHEN s.status <> 'ok' THEN 'unknown' WHEN k.jt = 'OBJECT' THEN 'object' WHEN k.jt = 'ARRAY' THEN 'array' ELSE 'scalar' END AS top_level,
  CASE WHEN k.jt = 'ARRAY' THEN len(list_filter(json_extract(k.j, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) WHEN k.jt IS NULL OR k.jt = 'OBJECT' THEN 0 ELSE 1 END AS non_object_count,
  CASE WHEN k.jt = 'OBJECT' THEN {_ctx('''json_extract(k.j, '$."@context"')''')} WHEN k.jt = 'ARRAY' THEN CASE WHEN list_contains(c.st, 'malformed') THEN 'malformed' WHEN c.st IS NULL OR list_contains(c.st, 'missing') THEN 'missing' ELSE 'valid' END END AS context
  FROM jsonld s LEFT JOIN jok k ON k.page_id = s.page_id AND k.entry_index = s.pos LEFT JOIN jctxs c ON c.page_id = s.page_id AND c.entry_index = s.pos"""
CTES["jfind"] = """SELECT page_id, 'jsonld-unevaluated' AS rule_id, CAST(entry_index AS VARCHAR) AS sub FROM jinv WHERE parse_status = 'truncated'
 UNION ALL SELECT page_id, 'jsonld-top-level-non-object', CAST(entry_index AS VARCHAR) FROM jinv WHERE status <> 'unevaluated' AND (top_level = 'scalar' OR non_object_count > 0)
 UNION ALL SELECT page_id, 'jsonld-context-' || context, entry_index || '-0' FROM jinv WHERE context IN ('missing','malformed')
 UNION ALL SELECT page_id, 'jsonld-node-missing-type', entry_index || '-0-' || node_index FROM jnode WHERE graph_node AND types = ''
 UNION ALL SELECT page_id, 'jsonld-duplicate-id', entry_index || '-0-' || i FROM jdup"""


def inv(c):
    return J.inventory(J.scripts_of(c.facts))


@query("I3_jsonld_inventory", "SELECT page_id, entry_index, parse_status, status, top_level, non_object_count, context FROM jinv")
def inventory(c):
    return inv(c).select(
        "page_id", "entry_index", "parse_status", "status", "top_level", "non_object_count", "context"
    )


@query("I3_jsonld_nodes", "SELECT page_id, entry_index, node_index, path, depth, types, id, graph_node FROM jnode")
def nodes(c):
    return J.nodes_of(inv(c)).withColumn("types", F.array_join("types", "|")).drop("id_only")


@query("D10_jsonld_duplicate_ids", "SELECT page_id, entry_index, id FROM jdup")
def duplicate_ids(c):
    return inv(c).select("page_id", "entry_index", F.explode("duplicate_ids").alias("id"))


@query(
    "D11_jsonld_status_counts",
    "SELECT page_id, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'invalid-json') AS invalid, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'truncated') AS truncated FROM jsonld GROUP BY page_id",
)
def status_counts(c):
    def of(s):
        return F.size(F.filter("json_ld.value", lambda e: e["parse_status"] == s))

    return c.facts.filter("json_ld.state = 'present'").select(
        "page_id",
        F.size("json_ld.value").alias("n"),
        of("ok").alias("ok"),
        of("invalid-json").alias("invalid"),
        of("empty").alias("empty"),
        of("truncated").alias("truncated"),
    )


@query("J9_jsonld_structural", "SELECT page_id, rule_id, sub FROM jfind")
def structural(c):
    return J.structural_findings(inv(c)).select("page_id", "rule_id", "sub")
