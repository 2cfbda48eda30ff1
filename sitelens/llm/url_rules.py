"""URL filters: pattern rules indexed by their rarest literal token.

A URL's host labels and path segments are looked up in the index; only the rules
found there run their regular expression.  One map-side pass, no shuffle of pages;
the rarity of the rules' tokens is counted over all URLs first (one row per token
of a rule reaches the driver)."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import table

_HIT = "struct<long:int,host_long:int,first:int,rule:string,verdict:string,pattern:string>"


@dataclass(frozen=True)
class Rule:
    """Applies to ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"(?s)^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}" if self.host else rf"(?s)^[^/]*{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Literal tokens every URL that the rule fits has: host labels and closed path segments."""
        labels = [f"h:{x}" for x in self.host.split(".") if x]
        return labels + [f"p:{x}" for x in self.path.split("/")[1:-1] if x and self.path.startswith("/")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end; A-Z lower-cased; empty if there is none."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def _index(rules: Sequence[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by rarest token, and those without any token."""
    index: dict[str, list[int]] = {}
    rest: list[int] = []
    for n, rule in enumerate(rules):
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(n)
        else:
            rest.append(n)
    return index, rest


def judge(urls: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule and verdict (the longest fitting rule's, else ``default``).

    A null URL or one without ``://`` has an empty host and path and gets ``default``
    unless a rule without any host or path fits.  Of fitting rules of one length the
    longer host wins, then the one listed first.  Repeated rows are judged alike; input
    columns of the names host, path, rule or verdict are replaced.  An empty table
    gives an empty table.  ``rules`` is a list in the driver's code: its index is a
    literal of the plan, hashed into slots so that a look-up stays short."""
    df = urls.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    tokens = _tokens(F.col("host"), F.col("path"))
    wanted = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if wanted:
        seen = df.select(F.explode(F.filter(tokens, lambda t: t.isin(wanted))).alias("token"))
        counts = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}
    index, rest = _index(rules, counts)

    def literal(numbers: list[int]) -> Column:
        rows = [
            F.struct(
                F.lit(len(rules[n].text)).alias("long"),
                F.lit(len(rules[n].host)).alias("host_long"),
                F.lit(-n).alias("first"),
                F.lit(rules[n].text).alias("rule"),
                F.lit(rules[n].verdict).alias("verdict"),
                F.lit(rules[n].pattern).alias("pattern"),
            )
            for n in numbers
        ]
        return F.array(*rows).cast(f"array<{_HIT}>")

    n_slots = max(1, len(index))
    slots: list[list[str]] = [[] for _ in range(n_slots)]
    for token in index:
        slots[crc32(token.encode()) % n_slots].append(token)
    look_up = F.array(
        *(
            F.create_map(*(x for t in slot for x in (F.lit(t), literal(index[t])))).cast(f"map<string,array<{_HIT}>>")
            for slot in slots
        )
    )
    found = F.transform(
        tokens, lambda t: F.coalesce(look_up[(F.crc32(t.cast("binary")) % n_slots).cast("int")][t], literal([]))
    )
    candidates = F.concat(F.flatten(found), literal(rest))
    subject = F.concat("host", "path")
    best = F.array_max(F.filter(candidates, lambda r: F.regexp_like(subject, r["pattern"])))
    return df.withColumns({"rule": best["rule"], "verdict": F.coalesce(best["verdict"], F.lit(default))})


#: The rules of the contract (fixed values).
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS n
  FROM pages
), rules(verdict, rh, rp) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
         ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT n, arg_max(struct_pack(rule := rh || rp, verdict := rules.verdict), length(rh || rp)) AS best
  FROM parts JOIN rules
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY n
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (n)
"""
