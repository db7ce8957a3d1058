"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Every query is run
in full (its rows go to the no-op sink), once, after one small warm-up query. The models that many
queries share are fitted first and reported apart, and so is attribution per case; the value is the total of all,
fits included, and `without_fits` the part that earlier rounds reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracewell.plans import model_queries as M  # noqa: E402
from tracewell.plans import registry  # noqa: E402
from tracewell.session import local_session  # noqa: E402

HEADLINES = [
    "log_overview",
    "column_cardinality",
    "categorical_profile",
    "numeric_summary",
    "order_events",
    "case_outcomes",
    "eligibility_funnel",
    "safe_prefix",
    "sparse_availability",
    "lifecycle_relationship",
    "case_features",
    "temporal_split",
    "temporal_windows",
    "encode_linear",
    "roc_auc",
    "window_metrics",
    "logistic_model",
    "forest_model",
    "global_importance",
    "stability_table",
]
# Added later, so reported beside the headline queries.
MORE = ["state_in_force", "events_after_purchase", "trailing_load", "case_cube", "sketch_quantiles", "auc_intervals", "linear_importance"]


def _models(spark, sf_dir: str) -> tuple[dict, dict]:
    """Seconds of each shared step, and attribution of all test cases by the full forest."""
    seconds = {}
    for name, step in (("logistic_fit", M._logistic), ("forest_fit", M._forest), ("explainer", M._explained)):
        start = time.perf_counter()
        step(spark, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    _, _, explainer, test = M._explained(spark, sf_dir)
    cases = test.count()
    start = time.perf_counter()
    M._both_classes(spark, sf_dir).count()
    spent = time.perf_counter() - start
    return seconds, {"seconds": round(spent, 3), "cases": cases, "seconds_per_case": round(spent / max(cases, 1), 5),
                     "leaves": explainer.forest.leaves().count(), "background_rows": len(explainer.background), "labels": 2}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("tracewell-bench", cpus, int(cpus))
    queries = registry.queries()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    shared, attribution = _models(spark, sf_dir)
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    more: dict[str, float] = {}
    for name in MORE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        more[name] = round(time.perf_counter() - start, 3)
    without = sum(seconds.values()) + attribution["seconds"]
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(without + sum(shared.values()), 3),
        "without_fits": round(without, 3),
        "unit": "sec",
        "queries": seconds,
        "more_queries": more,
        "shared_models": shared,
        "attribution": attribution,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": int(cpus),
        "shuffle_partitions": int(cpus),
    }))


if __name__ == "__main__":
    main()
