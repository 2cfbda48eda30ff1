"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query starts from the raw tables with nothing stored from another one.
Expressions are built once on the smallest data set first: that is driver work
which does not grow with the data."""

from __future__ import annotations

import json
import os
import sys
import time

from parity import QUERIES, Inputs
from sitelens.session import local_session

HEADLINE = {
    "facts": lambda c: c.facts,
    "full_audit": QUERIES["J25_full_audit"],
    "site_rollup": QUERIES["D13_site_rollup"],
    "robots_evaluation": QUERIES["C3_robots_evaluation"],
    "sitemap_membership": QUERIES["C4_sitemap_membership"],
    "jsonld_structure": QUERIES["J9_jsonld_structural"],
    "soft404": QUERIES["J21_soft404_observations"],
    "url_variants": QUERIES["H6_url_variants"],
    "variant_observations": QUERIES["J22_variant_observations"],
    "hreflang_clusters": QUERIES["J20_cluster_findings"],
    "redirect_chains": QUERIES["C13_redirect_chains"],
    "navigation_batch": QUERIES["K1_navigation_batch"],
}


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    warm = Inputs(spark, os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001"))
    timings: dict[str, float] = {}
    for fn in HEADLINE.values():
        fn(warm).write.format("noop").mode("overwrite").save()
    for name, fn in HEADLINE.items():
        start = time.time()
        fn(Inputs(spark, folder)).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 2)
        print(name, timings[name], file=sys.stderr, flush=True)
    pages = spark.read.parquet(f"{folder}/pages.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(timings.values()), 2),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "pages": pages,
                "facts_pages_per_second": round(pages / timings["facts"], 1),
                "cpus": cpus,
            }
        )
    )
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
