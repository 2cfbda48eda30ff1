"""Queries the driver runs, each with the DuckDB text it must agree with."""

from importlib import import_module

from parity.registry import ORACLE, QUERIES, Inputs, with_ctes

for _module in ("duck", "pages", "references", "crawl", "structured", "rules", "network", "stored"):
    import_module(f"parity.{_module}")

__all__ = ["ORACLE", "QUERIES", "Inputs", "with_ctes"]
