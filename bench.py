"""Headline queries, timed. Prints one JSON line, and each time as it ends to standard error.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from hustings import catalog
from hustings.session import session

HEADLINE = (
    "top_quarter_speaker_scores", "pool_chunks_max", "pool_documents_max", "pool_documents_weighted",
    "parent_filled_cells", "covered_cells", "clean_speeches", "standard_titles", "document_chunks",
    "html_texts", "matched_speeches", "roster_matches", "topic_names", "density_clusters", "topic_tree",
    "pairwise_agreement", "adjusted_mutual_information", "rank_shift_summary", "component_positions",
    "irt_positions", "scored_documents",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="20g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.load()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    took: dict[str, float] = {}
    for name in names:
        start = time.time()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
                "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
