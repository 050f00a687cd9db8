"""Telemetry tables derived from the driver's ``events`` and ``orders``, once for Spark and once for DuckDB.

Both sides share the select lists below. ``//`` is integer division and ``TS(x)`` a timestamp
``x`` milliseconds after 2024-01-01; both are rewritten per dialect.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odolake.operators.slices import row_numbers
from odolake.session import tune
from odolake.sources.tables import Tables

BASE_MS = 1704067200000
ROWS_PER_SLICE = 65_536
KEYS = "vehicle_id, content_root, boot_id, mono_ms, seq, observed_at"

# name -> (select list, filter)
FROM_TICKS: dict[str, tuple[list[str], str]] = {
    "obd": (
        [
            "CASE WHEN event_id % 41 = 0 THEN 255 ELSE cast(floor(value) AS INT) % 130 END AS speed_kph",
            "cast(CASE WHEN event_id % 41 = 0 THEN 0 ELSE 800 + (event_id*137) % 5200 END AS INT) AS rpm",
            "cast((event_id*13) % 101 AS INT) AS throttle_pct",
            "cast((event_id*7) % 101 AS INT) AS load_pct",
            "cast(60 + event_id % 50 AS INT) AS coolant_c",
            "cast(20 + event_id % 30 AS INT) AS intake_c",
            "cast(event_id % 40 - 10 AS INT) AS timing_advance_deg",
        ],
        "event_type = 'view' OR (event_type = 'signup' AND event_id % 2 = 0)",
    ),
    "boost": (
        [
            "cast(100 + event_id % 160 AS INT) AS map_kpa",
            "100 AS baro_kpa",
            "cast(event_id % 5000 AS INT) AS maf_cgps",
            "cast(8500 + event_id % 2500 AS INT) AS lambda_e4",
            "cast(event_id % 700 AS INT) AS abs_load_raw",
            "cast(event_id % 160 AS DOUBLE) * cast(0.1450377 AS DOUBLE) AS boost_psi",
            "cast(8500 + event_id % 2500 AS DOUBLE) / cast(10000 AS DOUBLE) AS lambda_ratio",
            "cast(event_id % 21 - 10 AS INT) AS stft_pct",
            "cast(event_id % 17 - 8 AS INT) AS ltft_pct",
            "cast(event_id % 3 AS INT) AS pids_answered",
        ],
        "event_type = 'click'",
    ),
    "position": (
        [
            "CASE WHEN event_id % 37 <> 0 THEN cast(36 AS DOUBLE) + cast(k AS DOUBLE) / cast(10000 AS DOUBLE) END AS lat",
            "CASE WHEN event_id % 53 <> 0 THEN cast(-121 AS DOUBLE) - cast(k AS DOUBLE) / cast(5000 AS DOUBLE) END AS lon",
            "cast(floor(value) AS DOUBLE) / cast(10 AS DOUBLE) AS speed_mps",
            "cast(CASE WHEN event_id % 9 = 0 THEN 0 ELSE 3 END AS INT) AS fix_type",
            "cast(4 + event_id % 12 AS INT) AS sats_used",
            "cast(event_id % 30 AS DOUBLE) / cast(10 AS DOUBLE) AS h_acc_m",
            "CASE WHEN event_id % 7 = 0 THEN 32 ELSE 0 END AS source_flags",
        ],
        "event_type = 'purchase'",
    ),
    "imu": (
        [
            "cast(floor(value) AS INT) * 3 % 200 AS accel_rms_mg",
            "cast(event_id % 16 AS INT) AS event_flags",
        ],
        "event_type = 'error'",
    ),
    "status": (
        [
            "cast(CASE WHEN event_id % 11 = 0 THEN NULL ELSE 12000 + event_id % 900 END AS INT) AS battery_mv",
            "cast(event_id % 400 AS INT) AS sd_free_mib",
            "cast(event_id % 13 % 2 AS INT) AS sd_write_errors",
            "cast(event_id % 256 AS INT) AS health_state",
        ],
        "event_type = 'error' AND event_id % 5 = 0",
    ),
    "transition": (
        [
            "4 AS region",
            "cast(event_id % 2 AS INT) AS from_state",
            "cast(1 - event_id % 2 AS INT) AS to_state",
            "4 AS trigger_event",
            "cast(event_id % 5 AS INT) AS reason_code",
        ],
        "event_type = 'error' AND event_id % 3 = 0",
    ),
    "gap": (
        [
            "observed_at AS started_at",
            "cast(2000 + event_id % 20000 AS BIGINT) AS duration_ms",
            "cast(1 + event_id % 5 AS INT) AS cause",
        ],
        "event_type = 'purchase' AND event_id % 29 = 0",
    ),
    "wifi_scan": (
        ["cast(event_id % 4 AS INT) AS flags", "3 AS ap_count"],
        "event_type = 'signup' AND event_id % 2 = 1",
    ),
    "raw_position": (
        [
            "cast(CASE WHEN event_id % 23 = 0 THEN 0 ELSE 360000000 + k * 1000 END AS BIGINT) AS lat_e7",
            "cast(CASE WHEN event_id % 23 = 0 THEN 0 ELSE -1210000000 - k * 2000 END AS BIGINT) AS lon_e7",
            "cast(event_id % 9000 - 100 AS INT) AS alt_cm",
            "cast(event_id * 7 % 6000 AS INT) AS speed_cmps",
            "cast(event_id * 11 % 36100 AS INT) AS heading_cdeg",
            "cast(event_id % 9 AS INT) AS fix_type",
            "cast(CASE WHEN event_id % 17 = 0 THEN 255 ELSE event_id % 20 END AS INT) AS sats_used",
            "cast(CASE WHEN event_id % 19 = 0 THEN 65535 ELSE event_id % 500 END AS INT) AS hdop_e2",
            "cast(CASE WHEN event_id % 13 = 0 THEN 65535 ELSE event_id % 3000 END AS INT) AS h_acc_cm",
            "cast(event_id % 5 - 2 AS INT) AS utc_offset_ms",
            "0 AS source_flags",
        ],
        "event_type = 'purchase'",
    ),
    "marker": (
        [
            "cast(event_id % 11 AS INT) AS event_type",
            "cast(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 360000000 + k * 1000 END AS BIGINT) AS lat_e7",
            "cast(CASE WHEN event_id % 3 = 0 THEN 0 ELSE -1210000000 - k * 2000 END AS BIGINT) AS lon_e7",
            "concat('note-', cast(event_id % 5 AS VARCHAR(20))) AS note",
        ],
        "event_type = 'view' AND event_id % 7 = 0",
    ),
    "time_obs": (
        [
            f"{BASE_MS} + boot_off + mono_ms + event_id % 7 AS utc_ms",
            "cast(event_id % 6 AS INT) AS source_code",
        ],
        "event_type = 'signup' AND event_id % 4 = 0",
    ),
}

# Raw record fields, some of them at the "no reading" value of their width.
RAW_TICKS: dict[str, tuple[list[str], str]] = {
    "raw_obd": (
        [
            "cast(CASE WHEN event_id % 7 = 0 THEN -32768 ELSE event_id % 130 END AS INT) AS speed_kph",
            "cast(CASE WHEN event_id % 11 = 0 THEN -32768 ELSE event_id * 137 % 6000 END AS INT) AS rpm",
            "cast(CASE WHEN event_id % 5 = 0 THEN 65535 ELSE event_id % 700 END AS INT) AS fuel_pressure_kpa",
            "cast(event_id % 256 AS INT) AS throttle_pct",
            "cast(event_id * 3 % 256 AS INT) AS load_pct",
            "cast(event_id % 256 - 128 AS INT) AS coolant_c",
            "cast(event_id * 5 % 256 - 128 AS INT) AS intake_c",
            "cast(event_id * 7 % 256 - 128 AS INT) AS timing_advance_deg",
            "cast(event_id % 4 * 100 AS INT) AS poll_cadence_ms",
        ],
        "event_type = 'view'",
    ),
    "raw_boost": (
        [
            "cast(CASE WHEN event_id % 9 = 0 THEN 65535 ELSE 20 + event_id % 240 END AS INT) AS map_kpa",
            "cast(CASE WHEN event_id % 8 = 0 THEN 255 ELSE 90 + event_id % 12 END AS INT) AS baro_kpa",
            "cast(CASE WHEN event_id % 6 = 0 THEN 65535 ELSE 8500 + event_id % 2500 END AS INT) AS lambda_e4",
            "cast(CASE WHEN event_id % 5 = 0 THEN 65535 ELSE event_id % 700 END AS INT) AS abs_load_raw",
            "cast(event_id % 256 - 128 AS INT) AS stft_pct",
            "cast(event_id % 256 AS INT) AS pedal_pct",
            "cast(1 + event_id % 3 AS INT) AS schema_version",
        ],
        "event_type = 'click'",
    ),
    "raw_status": (
        [
            "cast(CASE WHEN event_id % 11 = 0 THEN 65535 ELSE 12000 + event_id % 900 END AS INT) AS battery_mv",
            "cast(CASE WHEN event_id % 13 = 0 THEN 65535 ELSE event_id % 2 END AS INT) AS sd_write_errors",
            "cast(event_id % 256 - 128 AS INT) AS device_temp_c",
            "cast(event_id * 3 % 256 - 128 AS INT) AS rssi_dbm",
            "cast(event_id % 256 AS INT) AS health_state",
        ],
        "event_type = 'error'",
    ),
    "raw_imu": (
        [
            "cast(event_id % 200 AS INT) AS accel_rms_mg",
            "cast(event_id * 31 % 65536 - 32768 AS INT) AS gyro_peak_dps_e1",
            "cast(event_id % 16 AS INT) AS event_flags",
        ],
        "event_type = 'error'",
    ),
    "raw_transition": (
        [
            "cast(1 + event_id % 4 AS INT) AS region",
            "cast(event_id * 7 % 65536 AS INT) AS start_score_e2",
            "cast(event_id * 11 % 65536 AS INT) AS stop_score_e2",
            "cast(4294967295 - event_id AS BIGINT) AS wake_cause",
        ],
        "event_type = 'signup'",
    ),
    "raw_gap": (
        [
            "cast(2000 + event_id % 20000 AS BIGINT) AS duration_ms",
            "cast(event_id % 60 AS INT) AS expected_samples",
            "cast(event_id % 8 AS INT) AS cause",
        ],
        "event_type = 'purchase'",
    ),
    "raw_time_obs": (
        [
            f"CASE WHEN event_id % 10 = 0 THEN 100 ELSE {BASE_MS} + boot_off + mono_ms END AS utc_ms",
            "CASE WHEN event_id % 3 = 0 THEN 4294967295 ELSE cast(event_id % 900 AS BIGINT) END AS accuracy_ms",
            "cast(event_id % 6 AS INT) AS source_code",
            "cast(event_id % 4 AS INT) AS flags",
        ],
        "event_type = 'signup'",
    ),
}

TICK_COLUMNS = [
    "event_id",
    "vehicle_id",
    "event_type",
    "value",
    "idx % 300 AS k",
    "(idx) // 300 AS boot_no",
    "(idx) // 60 AS bundle_no",
    "concat(vehicle_id, '-b', cast((idx) // 300 AS VARCHAR(20))) AS boot_id",
    "concat(vehicle_id, '-r', cast((idx) // 60 AS VARCHAR(20))) AS content_root",
    "(idx % 300) * 400 + (event_id * 37) % 300 + CASE WHEN idx % 300 >= 150 THEN 90000 ELSE 0 END AS mono_ms",
    "((idx) // 300) // 2 * 432000000 + ((idx) // 300) % 2 * 1500000 AS boot_off",
]

AP_COLUMNS = [
    "concat('ap-', cast((k) // 8 + i AS VARCHAR(20))) AS bssid",
    "cast(-40 - (event_id + i * 7) % 50 AS INT) AS rssi_dbm",
]

BUNDLE_COLUMNS = [
    "content_root",
    "min(vehicle_id) AS vehicle_id",
    "min(boot_id) AS boot_id",
    "content_root AS bundle_id",
    "concat('dev-', min(vehicle_id)) AS device_id",
    "'server' AS origin",
    "4 AS decoder_ver",
    "concat('d', cast(min(event_id) AS VARCHAR(20))) AS output_digest",
    "min(event_id) % 10 <> 3 AS reproduced",
    "CASE WHEN min(event_id) % 3 = 0 THEN concat('w', cast(min(event_id) % 4 AS VARCHAR(20))) ELSE '' END AS warnings",
    f"{BASE_MS} + min(boot_off) AS utc_basis_ms",
    "cast(count(CASE WHEN event_type = 'purchase' THEN 1 END) + CASE WHEN min(event_id) % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_position",
    "cast(count(CASE WHEN event_type = 'error' THEN 1 END) AS BIGINT) AS n_imu",
    "cast(count(CASE WHEN event_type = 'view' OR (event_type = 'signup' AND event_id % 2 = 0) THEN 1 END) AS BIGINT) AS n_obd",
    "cast(count(CASE WHEN event_type = 'click' THEN 1 END) AS BIGINT) AS n_boost",
    "cast(count(CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 END) AS BIGINT) AS n_status",
    "cast(count(CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 1 END) AS BIGINT) AS n_transition",
    "cast(count(CASE WHEN event_type = 'purchase' AND event_id % 29 = 0 THEN 1 END) AS BIGINT) AS n_gap",
    "min(event_id) AS first_seq",
    "max(event_id) AS last_seq",
]

LEDGER_COLUMNS = [
    "event_id",
    "ts AS at_ts",
    "concat('bundle-', cast((event_id) // 8 AS VARCHAR(20))) AS content_root",
    "concat('bid-', cast((event_id) // 8 AS VARCHAR(20))) AS bundle_id",
    "concat('dev-', cast((event_id) // 8 % 20 AS VARCHAR(20))) AS device_id",
    "CASE event_type WHEN 'view' THEN 'offered' WHEN 'click' THEN 'chunk_accepted' WHEN 'purchase' THEN 'committed' "
    "WHEN 'signup' THEN 'receipt_issued' ELSE 'offer_rejected' END AS event",
    "cast(floor(value * 100) AS BIGINT) AS bytes",
    "CASE (event_id) // 8 % 4 WHEN 0 THEN 'ble-relay' WHEN 1 THEN 'wifi-direct' WHEN 2 THEN 'lte' ELSE NULL END AS path",
    "CASE WHEN event_type = 'error' AND event_id % 6 <> 0 THEN 'refused' ELSE '' END AS reason",
]

OFFER_COLUMNS = [
    "o_orderkey",
    "o_custkey % 50 AS device_id",
    "rn + (rn) // 16 - CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS counter",
    "concat('root-', cast(o_orderkey AS VARCHAR(20))) AS content_root",
]

TUNE_ROWS = [("t1", "2024-01-06 00:00:00"), ("t2", "2024-01-16 00:00:00")]
VEHICLES = ["veh0", "veh1", "veh2", "veh3"]

_DIV = re.compile(r"\s//\s")
_TS = re.compile(r"\bTS\(([^()]*(?:\([^()]*\)[^()]*)*)\)")


def spark_text(sql: str) -> str:
    sql = _TS.sub(rf"CAST(timestamp_millis({BASE_MS} + \1) AS TIMESTAMP_NTZ)", sql)
    return _DIV.sub(" div ", sql).replace("VARCHAR(20)", "STRING")


def duck_text(sql: str) -> str:
    return _TS.sub(r"(TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(\1))", sql)


def bundle_tables() -> dict[str, list[str]]:
    """name -> columns of every table whose rows come from bundles."""
    keys = KEYS.split(", ")
    missing = {"gap": {"mono_ms", "observed_at"}, "time_obs": {"observed_at"}}
    lists = {name: cols for name, (cols, _) in FROM_TICKS.items()} | {"wifi_ap_obs": AP_COLUMNS}
    return {n: [k for k in keys if k not in missing.get(n, ())] + [c.rsplit(" AS ", 1)[1] for c in cols] for n, cols in lists.items()}


# --- Spark side -------------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    base = events.selectExpr(
        "event_id", "user_id % 4 AS veh", "concat('veh', cast(user_id % 4 AS STRING)) AS vehicle_id", "event_type", "value"
    )
    numbered = row_numbers(base, ["vehicle_id"], ["event_id"], "event_id", ROWS_PER_SLICE, "idx")
    shifted = numbered.withColumn("idx", F.col("idx") - 1)
    tk = shifted.selectExpr(*[spark_text(c) for c in TICK_COLUMNS])
    return tk.selectExpr("*", "event_id AS seq", spark_text("TS(boot_off + mono_ms) AS observed_at"))


def _tick_table(tk: DataFrame, name: str) -> DataFrame:
    cols, cond = {**FROM_TICKS, **RAW_TICKS}[name]
    keys = ["vehicle_id", "content_root", "boot_id", "seq"] if name == "gap" else KEYS.split(", ")
    if name == "time_obs":
        keys = [k for k in keys if k != "observed_at"]
    return tk.where(cond).selectExpr(*keys, *[spark_text(c) for c in cols])


def telemetry(spark: SparkSession, sf_dir: str) -> Tables:
    """All sample tables over the whole of ``events``."""
    tk = ticks(spark, sf_dir)

    def access_points() -> DataFrame:
        heard = tk.where("event_type = 'signup' AND event_id % 2 = 1")
        each = heard.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        return each.selectExpr(*KEYS.split(", "), *[spark_text(c) for c in AP_COLUMNS])

    def bundles() -> DataFrame:
        aggs = [F.expr(spark_text(c)) for c in BUNDLE_COLUMNS if not c.startswith("content_root")]
        return tk.groupBy("content_root").agg(*aggs).withColumn("bundle_id", F.col("content_root"))

    def tunes() -> DataFrame:
        values = ", ".join(f"('{v}', '{t}', TIMESTAMP_NTZ '{at}', '')" for v in VEHICLES for t, at in TUNE_ROWS)
        return spark.sql(f"SELECT * FROM VALUES {values} AS x(vehicle_id, tune_id, tuned_at, note)")

    frames = {name: (lambda name=name: _tick_table(tk, name)) for name in (*FROM_TICKS, *RAW_TICKS)}
    return Tables({**frames, "wifi_ap_obs": access_points, "bundles": bundles, "tune": tunes})


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*[spark_text(c) for c in LEDGER_COLUMNS])


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "o_custkey % 50 AS dev")
    numbered = row_numbers(orders, ["dev"], ["o_orderkey"], "o_orderkey", ROWS_PER_SLICE, "rn")
    return numbered.selectExpr(*[spark_text(c) for c in OFFER_COLUMNS])


# --- DuckDB side ------------------------------------------------------------------------------


@cache
def _ctes() -> dict[str, tuple[str, list[str]]]:
    """name -> (body, names it reads)."""
    out: dict[str, tuple[str, list[str]]] = {
        "base": (
            "SELECT event_id, concat('veh', cast(user_id % 4 AS VARCHAR)) AS vehicle_id, event_type, value, "
            "row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS idx FROM events",
            [],
        ),
        "tk0": (f"SELECT {', '.join(TICK_COLUMNS)} FROM base", ["base"]),
        "tk": (duck_text("SELECT *, event_id AS seq, TS(boot_off + mono_ms) AS observed_at FROM tk0"), ["tk0"]),
        "tune": (
            "SELECT v AS vehicle_id, t AS tune_id, CAST(d AS TIMESTAMP) AS tuned_at, '' AS note FROM (VALUES "
            + ", ".join(f"('{v}', '{t}', '{d}')" for v in VEHICLES for t, d in TUNE_ROWS)
            + ") x(v, t, d)",
            [],
        ),
        "wifi_ap_obs": (
            f"SELECT {KEYS}, {', '.join(AP_COLUMNS)} FROM tk CROSS JOIN (VALUES (0), (1), (2)) a(i) "
            "WHERE event_type = 'signup' AND event_id % 2 = 1",
            ["tk"],
        ),
        "bundles": (f"SELECT {', '.join(BUNDLE_COLUMNS)} FROM tk GROUP BY content_root", ["tk"]),
        "ledger": (f"SELECT {', '.join(LEDGER_COLUMNS)} FROM events", []),
        "offer_rows": (
            f"SELECT {', '.join(OFFER_COLUMNS)} FROM (SELECT *, row_number() OVER "
            "(PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS rn FROM orders) x",
            [],
        ),
    }
    for name, (cols, cond) in {**FROM_TICKS, **RAW_TICKS}.items():
        keys = KEYS
        if name == "gap":
            keys = "vehicle_id, content_root, boot_id, seq"
        if name == "time_obs":
            keys = KEYS.replace(", observed_at", "")
        out[name] = (f"SELECT {keys}, {', '.join(cols)} FROM tk WHERE {cond}", ["tk"])
    return out


def with_tables(sql: str, extra: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """Prefix a DuckDB query with the definitions of every table it names."""
    known = {**_ctes(), **(extra or {})}
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        body, reads = known[name]
        for r in reads or []:
            need(r)
        for other in known:
            if other != name and other not in (reads or []) and re.search(rf"\b(FROM|JOIN)\s+{other}\b", body):
                need(other)
        order.append(name)

    for name in known:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    defs = ",\n".join(f"{n} AS ({known[n][0]})" for n in order)
    if not defs:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {defs},\n{sql.lstrip()[14:]}"
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {defs},\n{sql.lstrip()[5:]}"
    return f"WITH {defs}\n{sql}"
