"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.plans import catalog
from tidemark.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Joins, windows, folds, parsers and writers of the engine's own work.
HEADLINE = ("fit_timeline", "interval_join", "asof_prev_next", "longest_run", "cue_chunks", "quietest_point", "sentence_split", "word_forms", "parse_srt", "overlap_fix", "keep_longest_by_text", "write_srt")


def main() -> None:
    spark = local_session(CPUS, int(CPUS), "12g")
    spark.sparkContext.setLogLevel("ERROR")
    found, took = catalog.queries(), {}
    names = sys.argv[1:] or [n for n in HEADLINE if n in found]
    spark.read.parquet(f"{SF_DIR}/documents.parquet").count()  # start the executor
    for name in names:
        best = float("inf")
        for _ in range(3):
            begun = time.perf_counter()
            found[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - begun)
        took[name] = round(best, 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
