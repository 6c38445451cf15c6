"""Times the headline pipelines and prints one JSON line.

Each query runs once to warm the JVM and three times timed, from building the plan to the
last row of its result (written to Spark's ``noop`` sink); the median counts and every run
is reported.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from bindings import QUERIES
from haulmark.session import local_session

HEADLINE = [
    "catch_by_year_area_gear",
    "landings_by_year_area",
    "compare_sources",
    "splice_sources",
    "discrepancy_by_gear",
    "landings_with_areas",
    "bio_extract_clean",
    "bio_extract_lookup",
    "bio_coverage",
    "age_composition",
    "length_composition",
    "proportion_mature",
    "length_at_age",
    "weight_at_age",
    "effort_extract",
    "logbook_extract",
    "survey_npue_index",
    "fishery_wpue_index",
    "cpue_index",
    "rpn_index",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in HEADLINE:
        run(name)
    rounds = [{name: run(name) for name in HEADLINE} for _ in range(3)]
    seconds = {name: median(r[name] for r in rounds) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "runs": {name: [r[name] for r in rounds] for name in HEADLINE},
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
