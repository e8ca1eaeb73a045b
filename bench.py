"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from arcline.session import build_session  # noqa: E402
from workloads.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "clean_shots",
    "clean_player_logs",
    "game_dimension",
    "base_features",
    "player_form",
    "team_form",
    "opponent_form",
    "gold_features",
    "score_margin",
    "sequence_slots",
    "pressure_features",
    "time_split",
    "edge_backtest",
    "summary_players",
    "summary_player_months",
    "findings",
    "rule_report",
    "classification_metrics",
    "calibration",
    "feature_auc_audit",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["summary_teams"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
