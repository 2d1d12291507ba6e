"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1); BENCH_CPUS: local threads (default 8).
The given tables are single files with a single row group, which one task would read alone; they
are first rewritten as several files (untimed), as tables on a cluster are. Each query runs once to
warm up the JVM, then the timed run builds its plan again and writes every row to the no-op sink;
the time that building alone took is given too.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from promptloom.plans.queries import QUERIES
from promptloom.session import build_session

HEADLINE = {
    "p1_redact": "texts",
    "p4_estimate_tokens": "texts",
    "p21_classify": "texts",
    "p24_optimize_conservative": "prompts",
    "p24_optimize_moderate": "prompts",
    "p24_optimize_aggressive": "prompts",
    "a7_compare_levels": "prompts",
    "t2_dedupe_clauses_aggressive": "texts",
    "t3_dedupe_sentences": "texts",
    "a8_output_savings": "outputs",
    "j1_complete_events": "events",
    "k1_top_commands": "events",
    "a3_prompt_patterns": "prompts",
    "a6_history_bonus": "prompts",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            # the bench files are small: one task per file, not one for all of them
            "spark.sql.files.openCostInBytes": "64m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    name = os.path.basename(sf_dir.rstrip("/"))
    split_dir = tempfile.mkdtemp(prefix="bench-")
    for table in ("conversations", "documents", "events", "labels"):
        whole = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        whole.repartition(2 * int(cpus)).write.parquet(f"{split_dir}/{table}.parquet")
    sf_dir = split_dir
    rows = {
        "prompts": spark.read.parquet(f"{sf_dir}/conversations.parquet").count(),
        "outputs": spark.read.parquet(f"{sf_dir}/documents.parquet").count(),
        "events": spark.read.parquet(f"{sf_dir}/events.parquet").count(),
    }
    rows["texts"] = rows["prompts"] + rows["outputs"]

    def run(query: str) -> tuple[float, float]:
        """Seconds to build the frame, and in all."""
        begin = time.perf_counter()
        frame = QUERIES[query](spark, sf_dir)
        built = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        return built - begin, time.perf_counter() - begin

    seconds, build = {}, {}
    for query in HEADLINE:
        run(query)
        build[query], seconds[query] = (round(x, 3) for x in run(query))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "build_sec": build,
                "rows_per_sec": {n: round(rows[t] / seconds[n]) for n, t in HEADLINE.items()},
                "sf": name,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
