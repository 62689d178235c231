"""Times the headline queries and prints one JSON line.

Every query is written to the no-op sink, so all rows and columns are computed. Caches are cleared
between queries; a first small query takes the session start out of the times.
"""

from __future__ import annotations

import json
import os
import time

from anchorline.catalogue import QUERIES
from anchorline.catalogue.base import KEYS, long
from anchorline.operators.features import feature_stats_unfused
from anchorline.session import local_session
from anchorline.sources import hospital

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = [
    "cohort", "join_window", "feature_stats_all", "join_matrix", "sequence_number", "reject_outliers_vitals",
    "sweep_windows", "label_multi_target", "stratified_folds", "sample_class_ratio", "metric_auroc", "scores_wide",
    "column_profile", "impute_median", "impute_chained", "impute_em", "impute_knn", "fit_logistic", "select_forward",
    "prepare_scale_first", "impute_compare_constants",
]


def unfused(spark, sf_dir):
    """The features as twelve joined tables: what ``feature_stats_all`` has to beat."""
    families = {family: {n: n for n in names} for family, names in hospital.NAMES.items()}
    return feature_stats_unfused(long(spark, sf_dir), KEYS, families)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session("bench", cpus, **{"spark.sql.shuffle.partitions": cpus})
    timed = {**{name: QUERIES[name] for name in HEADLINE}, "feature_stats_unfused": unfused}
    QUERIES["cohort"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, run in timed.items():
        spark.catalog.clearCache()
        start = time.perf_counter()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(v for n, v in seconds.items() if n != "feature_stats_unfused"), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
