"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagewright.plans import catalog, fixtures as fx  # noqa: E402
from pagewright.plans.reading_queries import kept  # noqa: E402
from pagewright.session import local_session  # noqa: E402

HEADLINE = [
    "a10_intake_report", "b4_otsu_threshold", "c2_connected_components", "c3_component_boxes",
    "d3_ctc_collapse", "d4_recognize", "e1_reading_order", "e2_assign_lines", "e5_page_results",
    "e8_summary_cube", "f1_txt_pages", "f2_json_pages", "f3_export_csv", "g3_usage_running_total",
    "g10_rate_limit", "h6_usage_sessions", "i1_detect_columns", "i2_detect_tables", "i6_search",
    "i7_merge_regions", "i8_dedupe_by_digest", "i10_ocr_accuracy",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "pagewright-bench")
    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    timed = lambda df_of: (lambda t: (drain(df_of()), time.perf_counter() - t)[1])(time.perf_counter())

    timed(lambda: catalog.flagship(spark, sf))  # start-up and code generation, not counted
    seconds = {"flagship": round(timed(lambda: catalog.flagship(spark, sf)), 3)}
    for name in chosen:
        seconds[name] = round(timed(lambda: catalog.QUERIES[name](spark, sf)), 3)
    regions, pages = kept(spark, sf).count(), fx.page_base_fx(spark, sf).count()
    print(json.dumps({
        "metric": "total_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus,
        "regions_per_sec": round(regions / seconds["flagship"]),
        "pages_per_sec": round(pages / seconds["flagship"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
