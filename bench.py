"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: tables (default sf0.1). BENCH_CPUS: local cores. BENCH_RUNS: timed
runs per query after one warm-up; the median counts. Results go to the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_conversation_report", "sco1_normalise_answer", "sco2_token_prf", "sco5_rouge_l",
    "sco6_keyword_hit_rate", "agg2_strict_mean", "agg3_strict_mean_by_category", "agg8_leaderboard",
    "led1_scene_in_range", "led4_top_scenes", "led5_busiest_dates", "led7_scene_on_date", "led9_rollups",
    "mem7_apply_operations", "mem10_running_ledger", "ret3_bm25_topk", "ret5_semantic_topk", "ret6_rrf",
    "ret9_grep", "ret14_hit_scope", "jn5_visible_extent", "txt1_render_session", "txt2_parse_turns",
    "txt4_pack_lines", "txt8_estimate_tokens", "txt11_semantic_chunks", "nrm12_dedupe_documents",
    "pro3_gap_stats", "smp3_stratified",
]


def main() -> None:
    from convoeval.plans import QUERIES
    from convoeval.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
