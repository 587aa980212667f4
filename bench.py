"""Times the headline queries and prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from codeloom import catalog
from codeloom.sources import views

HEADLINE = (
    "scan_symbols", "resolved_edges", "unresolved_edges", "overview_hubs", "overview_kinds", "overview_top_files", "file_rollup", "edge_groups", "degree_in", "search_exact",
    "search_substring", "search_multi_token", "search_bm25", "search_negative", "symbol_incoming", "graph_depth1", "graph_depth2", "find_callers", "list_files", "file_outline",
    "get_source", "repository_status", "token_budget_projection", "incremental_merge", "verify_parity", "debounce_sessions",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
    run("overview_kinds")
    # What a commit leaves to its first readers is timed by itself, and counts.
    began = time.time()
    pack = views.pack(spark, sf)
    for table in ("relationships", "outgoing", "incoming", "symbols", "terms", "lexicon", "corpus", "files", "segments"):
        pack.table(table)
    took = {"pack_build": round(time.time() - began, 3)}
    for name in HEADLINE:
        began = time.time()
        run(name)
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
