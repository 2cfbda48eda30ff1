"""Registry that pairs every Spark query with its DuckDB text."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from parity import derive
from sitelens.schemas import PAGES
from sitelens.session import configure, cut_lineage, spread


class Inputs:
    """Tables a query reads: the driver's ``pages`` and what is derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configure(spark)
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def _pages(self) -> DataFrame:
        return spread(self.spark.read.schema(PAGES).parquet(f"{self.folder}/pages.parquet"))

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            if name == "pages":
                df = self._pages()
            else:
                text = derive.DERIVED[name](derive.SPARK)
                for other in ("pages", *derive.DERIVED):
                    if other != name and re.search(rf"\bFROM {other}\b", text):
                        self.table(other).createOrReplaceTempView(other)
                df = self.spark.sql(text)
            self._tables[name] = df
        return self._tables[name]

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = make()
        return self._tables[name]

    @cached_property
    def facts(self) -> DataFrame:
        """The facts table, materialised once as a job would store it."""
        from sitelens.operators.facts import page_facts

        return cut_lineage(page_facts(self.table("audit_pages")))


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: CTE library for the DuckDB texts, in dependency order of use.
CTES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn: Callable[[Inputs], DataFrame]):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return add


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the derived tables and library CTEs it mentions."""
    known = {**{n: f(derive.DUCK) for n, f in derive.DERIVED.items()}, **CTES}
    ordered: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in known and word != own and word not in ordered and re.search(
                rf"\b(?:FROM|JOIN)\s+{word}\b", text
            ):
                visit(known[word], word)
                if word not in ordered:
                    ordered.append(word)

    visit(sql)
    if not ordered:
        return sql
    recursive = "RECURSIVE " if any("UNION ALL /*recursive*/" in known[n] for n in ordered) else ""

    def define(name: str) -> str:
        # Shared by several readers; DuckDB might otherwise inline it into each.
        hint = "" if "/*recursive*/" in known[name] else "MATERIALIZED "
        return f"{name} AS {hint}({known[name]})"

    body = ",\n".join(define(name) for name in ordered)
    return f"WITH {recursive}{body}\n{sql}"
