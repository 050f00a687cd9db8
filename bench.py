"""Time the headline queries on one machine; prints one JSON line.

The sample tables are first derived from the driver's data and written as a store, which is timed
on its own. Queries then read the store. Each runs once to warm up and then ``BENCH_RUNS`` times;
the median counts. Results are consumed in full by a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from checks import testbed  # noqa: E402
from odolake.plans import bundle, engine, insight, power, registry, repair, summaries, trips, trusted, wifi  # noqa: E402
from odolake.session import local_session  # noqa: E402
from odolake.sources import sinks  # noqa: E402
from odolake.sources.tables import Tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def fresh_telemetry(t: Tables) -> DataFrame:
    return engine.v_telemetry(t).where("boost_age_ms < 1000")


QUERIES = {
    "scan_agg": lambda t: t.obd.agg(F.count(F.lit(1)), F.avg("rpm"), F.max("speed_kph")),
    "filter_range": lambda t: t.obd.where("boot_id = 'veh1-b0' AND mono_ms BETWEEN 10000 AND 90000").agg(F.count(F.lit(1))),
    "group_rpm_bins": lambda t: t.obd.groupBy(F.expr("rpm div 500")).agg(F.count(F.lit(1)), F.avg("load_pct")),
    "asof_view_agg": lambda t: fresh_telemetry(t).agg(F.count(F.lit(1)), F.max("boost_psi"), F.avg("stft_pct")),
    "asof_group": lambda t: fresh_telemetry(t).groupBy(F.expr("rpm div 500")).agg(F.count(F.lit(1)), F.max("boost_psi")),
    "v_telemetry": engine.v_telemetry,
    "v_drive_summary": summaries.v_drive_summary,
    "v_trim_map": engine.v_trim_map,
    "v_boost_curve": engine.v_boost_curve,
    "v_speed_agreement": engine.v_speed_agreement,
    "v_pulls": engine.v_pulls,
    "v_position_trusted": trusted.v_position_trusted,
    "v_trip_leg": trips.v_trip_leg,
    "v_trip_summary": trips.v_trip_summary,
    "v_metric_samples": insight.v_metric_samples,
    "v_tune_effect": insight.v_tune_effect,
    "v_health_stats": insight.v_health_stats,
    "v_wifi_ap_learned": wifi.v_wifi_ap_learned,
    "power_summary": power.power_summary,
    "bundle_trips": bundle.bundle_trips,
    "trip_segments": bundle.trip_segments,
    "sample_events": bundle.sample_events,
    "jump_gate": lambda t: repair.jump_gate(t.position, t.gap),
    "basis_repairs": repair.basis_repairs,
}


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, int(CPUS), os.environ.get("BENCH_MEMORY", "12g"))
    root = tempfile.mkdtemp(prefix="odolake-bench-")
    spark.sparkContext.setCheckpointDir(f"{root}/checkpoints")
    derived = testbed.telemetry(spark, SF_DIR)
    names = [n for n in derived if n not in ("raw_position", "marker")]
    store = timed(lambda: sinks.write_store(Tables({n: derived[n] for n in names}), f"{root}/store"))
    stored = Tables({n: spark.read.parquet(f"{root}/store/{n}") for n in names})
    offers = testbed.offers(spark, SF_DIR).selectExpr("device_id", "counter", "content_root", "o_orderkey AS arrival")
    sinks.write_ordered(offers, f"{root}/store/offers", order=("device_id", "arrival"))
    offers = spark.read.parquet(f"{root}/store/offers")
    wanted = {**QUERIES, "counter_verdicts": lambda t: registry.counter_verdicts(offers)}
    picked = sys.argv[1:] or list(wanted)
    took = {}
    for name in picked:
        query = wanted[name]
        runs = [timed(lambda q=query: consume(q(stored))) for _ in range(RUNS + 1)]
        took[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "median seconds per query, summed",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "store_build_sec": round(store, 3),
                "cpus": int(CPUS),
                "runs": RUNS,
            }
        )
    )


if __name__ == "__main__":
    main()
