"""Seconds per headline query, as one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores.
Every query runs to its last row without keeping the result.
"""

from __future__ import annotations

import json
import os
import sys
import time

from sitepanel.catalog import QUERIES
from sitepanel.session import build_session

HEADLINE = [
    "growth_panel", "season_cover_frame", "interaction_frame", "cover_growth_frame",
    "monthly_max", "monthly_summary", "season_precip", "winter_min", "water_year_sum",
    "annual_climate", "season_and_maxima", "site_climate_by_coordinate",
    "coordinate_join_readings", "coordinate_join_sites", "fanout_join", "monitoring_matrix",
    "min_monitored_years", "first_release_row", "cast_min", "complete_grid_lag", "observed_lag",
    "row_sum_min", "replicate_means", "lm_fit", "lm_multi_response", "lmm_fit_reml", "lmm_plots",
    "lmm_scored", "model_selection", "model_average", "residual_chain", "influence",
    "resid_hist", "resid_qq", "resid_kde", "trend_by_site", "season_cover_models",
    "month_cover_models", "wide_interaction_selection", "complete_grid_outside", "hist_given_breaks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    for warm_up in ("trend_line", "first_rows"):
        QUERIES[warm_up](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
