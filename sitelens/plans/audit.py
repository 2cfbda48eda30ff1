"""The whole audit of a crawl as one plan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sitelens.limits import DEFAULT_CAPTURE, CaptureLimits
from sitelens.operators import checks as C
from sitelens.operators import robots as R
from sitelens.operators import sitemaps as M
from sitelens.operators.facts import page_facts
from sitelens.operators.signals import page_evidence
from sitelens.operators.summary import page_summary
from sitelens.session import cut_lineage


@dataclass
class Audit:
    evidence: DataFrame
    findings: DataFrame
    selection: DataFrame
    summary: DataFrame


def crawl_evidence(
    pages: DataFrame,
    navigations: DataFrame | None = None,
    hops: DataFrame | None = None,
    robots_files: DataFrame | None = None,
    sitemap_files: DataFrame | None = None,
    limits: CaptureLimits = DEFAULT_CAPTURE,
    compat: bool = False,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Facts of every page joined with whatever else was captured.

    ``facts`` may be a stored facts table; otherwise pages are lexed here."""
    located = pages.select("page_id", "url")
    robots = sitemaps = None
    if robots_files is not None:
        robots = R.page_blocks(R.page_verdicts(located, robots_files, compat=compat))
    if sitemap_files is not None:
        parsed = cut_lineage(M.parse_files(sitemap_files))
        sitemaps = M.membership(located, M.merged_entries(parsed), parsed)
    if facts is None:
        facts = page_facts(pages, limits)
    return page_evidence(
        facts, navigations, hops, robots, sitemaps, compat
    )


def audit(
    evidence: DataFrame,
    requested: Iterable[str] | None = None,
    catalogue: Sequence[C.Check] = C.CATALOGUE,
    capture_errors: DataFrame | None = None,
    store: str | None = None,
    stored: bool = False,
) -> Audit:
    """Evidence -> findings, check selection, page summaries.

    The evidence is read by several branches, so it is materialised once: as a
    table at ``store`` or in the checkpoint folder.  Pages are lexed once.
    ``stored`` says that it is such a table already."""
    if stored:
        pass
    elif store is not None:
        evidence.write.mode("overwrite").parquet(store)
        evidence = evidence.sparkSession.read.parquet(store)
    else:
        evidence = cut_lineage(evidence)
    found = C.findings(evidence, requested, catalogue)
    return Audit(
        evidence,
        found,
        C.selection(evidence, requested, catalogue),
        page_summary(evidence, found, capture_errors),
    )
