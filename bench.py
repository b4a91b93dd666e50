"""Runs the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from bundlewright.operators.index import build_index
from bundlewright.plans import catalogue
from bundlewright.plans.engine import Engine
from bundlewright.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINES = ("chunk_lines", "tokenize_tf", "term_df", "bm25_topn", "minhash_sig", "select_files", "greedy_select", "recall_mrr", "grep_counts", "language_detect")


def timed(action) -> float:
    began = time.perf_counter()
    action()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    spark = local_session(memory="16g")
    found: dict[str, float] = {}
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    run(catalogue.QUERIES["token_estimate"](spark, SF_DIR))  # starts the workers
    for name in HEADLINES:
        found[name] = timed(lambda: run(catalogue.QUERIES[name](spark, SF_DIR)))
    folder = tempfile.mkdtemp(prefix="bench-index-")
    try:
        found["index_build_save"] = timed(lambda: build_index(catalogue.documents(spark, SF_DIR), syntax=False).save(folder))
        engine = Engine.load(spark, folder)
        asked = catalogue.asked(spark, SF_DIR)
        found["search_batch"] = timed(lambda: run(engine.search(asked)))
        found["search_batch_again"] = timed(lambda: run(engine.search(asked)))
        n = asked.count()
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(
        json.dumps(
            {"metric": "headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(SF_DIR.rstrip("/")), "ms_per_query_in_batch": round(1000 * found["search_batch_again"] / max(1, n), 2)}
        )
    )


if __name__ == "__main__":
    main()
