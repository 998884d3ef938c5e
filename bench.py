"""Benchmark: headline code-graph queries at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

1. load: the code graph is projected from the test tables and written
   once as parquet (the analogue of importing a dump), timed apart;
2. each headline query runs over that parquet graph (documents for the
   text operators) and is executed in full with a ``noop`` write; the
   reported time is the median of ``BENCH_REPS`` runs (one global warm-up
   first).

Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "function_complexity", "function_complexity_all", "module_details", "code_statistics",
    "most_called_functions", "cross_module_calls", "cross_module_dependencies",
    "module_coupling", "complexity_metrics", "type_details", "type_usage", "class_details",
    "import_details", "suspicious_imports", "import_graph", "type_dependencies",
    "call_neighbours", "call_tree", "nested_types", "elements_at", "location_context",
    "function_context", "generate_imports_explicit", "similar_functions",
    "similarity_groups", "code_patterns", "entity_query_join", "custom_sql_named",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from codeweave.registry import graph_queries
    from codeweave.session import local_session
    from codeweave.sources.fixture import fixture_graph
    from codeweave.sources.ingest import write_graph

    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)),
                          app="codeweave-bench")
    scratch = tempfile.mkdtemp(prefix="codeweave-bench-", dir=os.environ.get("TMPDIR", "/tmp"))

    t0 = time.time()
    g = write_graph(fixture_graph(spark, sf_dir), f"{scratch}/graph")
    load_s = time.time() - t0

    fns = graph_queries()
    names = only or HEADLINE
    # One warm-up for the JVM and codegen paths; each query then reports
    # the median of its timed runs.
    for name in ("function_complexity", "module_details"):
        fns[name](g, spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        run = lambda: fns[name](g, spark, sf_dir).write.format("noop").mode("overwrite").save()
        try:
            samples = []
            for _ in range(reps):
                t = time.time()
                run()
                samples.append(time.time() - t)
        except Exception as e:  # noqa: BLE001 - report and keep the JSON line
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"# {name}: FAILED {failed[name]}", file=sys.stderr)
            continue
        times[name] = round(statistics.median(samples), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    try:
        sf = float(sf)
    except ValueError:
        pass
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "load_seconds": round(load_s, 3),
                      "sf": sf, "cpus": int(cpus), "reps": reps, "failed": failed}))


if __name__ == "__main__":
    main()
