"""Time the headline queries: one JSON line on standard output.

Every query is written to a sink that keeps nothing, so all columns are computed. The first run of a
query is cold (plan and code generation included), ``queries`` holds the best of the warm runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "pages_to_markdown", "render_markdown", "page_blocks", "html_tokens", "content_root", "extract_title", "page_links",
    "subdocuments", "convert_corpus", "append_subpages", "asset_manifest", "rewrite_assets", "placeholders_html", "placeholders_text",
    "normalize_summary", "collapse_blank_runs", "selectable_chunks", "code_blocks", "dedup_chunks", "stable_round",
    "pick_attempt", "html_unescape", "stream_stable_pages",
]


def main() -> None:
    from catalog.queries import QUERIES
    from pagesheaf.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    spark = local_session("pagesheaf-bench", cores, partitions=int(cores))
    spark.conf.set("spark.sql.ui.explainMode", "simple")
    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    warm, cold = {}, {}
    for name in wanted.split(",") if wanted else HEADLINE:
        cold[name] = round(run(name), 3)
        warm[name] = round(min(run(name) for _ in range(2)), 3)
    total = round(sum(warm.values()), 3)
    flagship = warm.get("pages_to_markdown")
    print(json.dumps({
        "metric": "headline_queries_warm_total",
        "value": total,
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "pages": n_pages,
        "flagship_pages_per_sec": round(n_pages / flagship, 1) if flagship else None,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": int(cores),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
