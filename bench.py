"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F

from kelvingrid.operators import climate, correlation, evaluate, expanding, grid, rollout, samples, unitroot
from kelvingrid.plans import stages
from kelvingrid.registry.base import dim_of, g35, suppliers
from kelvingrid.session import get_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df) -> None:
    """Compute every column of every row without collecting."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = get_session(
        "bench",
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    daily = g35(1)
    sup = suppliers(7)
    w, h = 6, 18

    def search():
        obs = daily.obs(spark, SF_DIR).persist()
        lo, hi = obs.agg(F.min("slot"), F.max("slot")).first()
        cut = lo + int((hi - lo + 1) * 0.7)
        fit, val = obs.filter(F.col("slot") <= cut), obs.filter(F.col("slot") > cut)
        stages.search_windows(fit, val, daily.axis, ["linear"], range(1, 9), h).collect()
        obs.unpersist()

    def evaluation(fx):
        frames = samples.rollout_frames(fx.obs(spark, SF_DIR), w, h)
        steps = {"persistence": rollout.persistence(), "window_mean": rollout.window_mean()}
        rolled = rollout.rollout_many(frames, steps, h, fx.axis, 0.05)
        run(evaluate.summarize_by_step(rollout.detail_rows(rolled, F.col("model"), fx.axis)))

    def grid_and_samples():
        obs = daily.obs(spark, SF_DIR)
        dim = dim_of(obs)
        run(samples.window_dataset(grid.dense_grid(obs, dim), w, daily.axis, dim))

    jobs = {
        "grid_and_samples": grid_and_samples,
        "rollout_and_summary": lambda: evaluation(daily),
        "rollout_and_summary_suppliers": lambda: evaluation(sup),
        "expanding_samples": lambda: run(expanding.expanding_samples(daily.obs(spark, SF_DIR), daily.axis)),
        "onset_events": lambda: run(climate.onset_events(daily.obs(spark, SF_DIR))),
        "pixel_correlation": lambda: run(correlation.pixel_correlation(sup.obs(spark, SF_DIR), mirror=False)),
        "acf_pacf": lambda: run(climate.acf_pacf(daily.obs(spark, SF_DIR))),
        "unit_root": lambda: run(unitroot.unit_root(daily.obs(spark, SF_DIR))),
        "kfold_closed_form": lambda: run(
            stages.blocked_kfold_closed_form(
                daily.obs(spark, SF_DIR), daily.axis, ["persistence", "window_mean", "ar1"], w, h
            )
        ),
        "linear_window_search_8": search,
    }
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    only = sys.argv[1:]
    seconds = {}
    for name, job in jobs.items():
        if only and name not in only:
            continue
        begin = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
