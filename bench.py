"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores.
"""

from __future__ import annotations

import json
import os
import time

from checks import inputs
from checks.queries import QUERIES
from dosegrid.session import build_session

HEADLINE = [
    "catalogue_alleles",
    "vcf_scan_fixed_columns",
    "rsid_refresh_inner",
    "sparse_default",
    "dense_to_coordinates",
    "sparse_recode",
    "gwas_recode",
    "variant_ids",
    "prs",
    "prs_coordinates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    # Deriving and storing the inputs, and with it the start of the JVM.
    start = time.perf_counter()
    inputs.panel(spark, sf_dir)
    inputs.packed_panel(spark, sf_dir)
    inputs.catalogue(spark, sf_dir)
    inputs.catalogue(spark, sf_dir, newer=True)
    inputs.associations(spark, sf_dir)
    seconds["load_inputs"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
