"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; one JSON line.

Every query is evaluated in full into a sink that discards the rows. The models
are fitted inside the first query that needs them.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from corpusloom.catalog import QUERIES
from corpusloom.session import local_session

HEADLINE = (
    "tokenize",
    "term_freq",
    "contingency",
    "term_score",
    "selected_terms",
    "selected_terms_by_source",
    "top_terms",
    "doc_term_weight",
    "weights_minmax",
    "doc_vectors",
    "train_test_split",
    "split_vectors",
    "html_to_text",
    "page_vectors",
    "class_metrics",
    "report_lines",
    "svm_rbf_predict",
    "one_class_predict",
    "classify_pages",
    "classify_multi",
    "classify_pages_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS") or os.cpu_count() or 8)
    QUERIES["page_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
