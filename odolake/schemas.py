"""Column types of the sample tables.

Only keys are set on every row; any other value may be NULL, which means "not measured".
Unsigned 32-bit clocks and counters are held as long.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "timestamp": T.TimestampType(),
}


def struct(columns: str) -> T.StructType:
    """``"name type, .."`` as a StructType, without needing a running session."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


_KEYS = "vehicle_id string, content_root string, boot_id string, mono_ms bigint, seq bigint, observed_at timestamp_ntz"

_DDL = {
    "bundles": (
        "content_root string, vehicle_id string, bundle_id string, device_id string, boot_id string, origin string, "
        "decoder_ver int, output_digest string, reproduced boolean, decode_ms int, n_position bigint, n_imu bigint, "
        "n_obd bigint, n_boost bigint, n_status bigint, n_transition bigint, n_gap bigint, unknown_records int, "
        "warnings string, path string, size_bytes bigint, duration_ms bigint, received_at timestamp_ntz"
    ),
    "position": (
        f"{_KEYS}, lat double, lon double, alt_m double, speed_mps double, heading_deg double, fix_type int, "
        "sats_used int, sats_visible int, hdop double, h_acc_m double, v_acc_m double, utc_acc_ms int, "
        "source_flags int, frame_flags int"
    ),
    "imu": (
        f"{_KEYS}, window_ms int, accel_rms_mg int, accel_peak_x_mg int, accel_peak_y_mg int, accel_peak_z_mg int, "
        "gyro_peak_dps double, variance int, sample_count int, event_flags int, frame_flags int"
    ),
    "obd": (
        f"{_KEYS}, speed_kph int, rpm int, throttle_pct int, load_pct int, coolant_c int, intake_c int, "
        "fuel_pressure_kpa int, timing_advance_deg int, pid_error_count int, pids_requested bigint, "
        "pids_answered bigint, poll_cadence_ms int, frame_flags int"
    ),
    "boost": (
        f"{_KEYS}, map_kpa int, baro_kpa int, maf_cgps int, lambda_e4 int, abs_load_raw int, ambient_c int, "
        "stft_pct int, ltft_pct int, fuel_level_pct int, pedal_pct int, boost_psi double, lambda_ratio double, "
        "pids_requested bigint, pids_answered bigint, poll_cadence_ms int"
    ),
    "status": (
        f"{_KEYS}, battery_mv int, sd_write_errors int, sd_free_mib int, device_temp_c int, rssi_dbm int, "
        "ext_sensor1 int, ext_sensor2 int, health_state int, reboot_count int"
    ),
    "transition": (
        f"{_KEYS}, region int, from_state int, to_state int, trigger_event int, reason_code int, policy_version int, "
        "start_score double, stop_score double, wake_cause bigint"
    ),
    "gap": (
        "vehicle_id string, content_root string, boot_id string, seq bigint, started_at timestamp_ntz, "
        "duration_ms bigint, expected_samples int, cause int"
    ),
    "time_obs": (
        "vehicle_id string, content_root string, boot_id string, seq bigint, mono_ms bigint, utc_ms bigint, "
        "implied_basis_ms bigint, accuracy_ms bigint, source string, adopted boolean"
    ),
    "wifi_scan": f"{_KEYS}, flags int, scan_ms int, ap_count int",
    "wifi_ap_obs": f"{_KEYS}, bssid string, rssi_dbm int, channel int",
    "tune": "vehicle_id string, tune_id string, tuned_at timestamp_ntz, note string",
}

SAMPLE_TABLES: dict[str, T.StructType] = {name: struct(ddl) for name, ddl in _DDL.items()}

# Wall-clock column per table that has one, and the tables filed under a vehicle.
TIME_COLUMN = {
    "position": "observed_at",
    "imu": "observed_at",
    "obd": "observed_at",
    "boost": "observed_at",
    "status": "observed_at",
    "transition": "observed_at",
    "gap": "started_at",
    "wifi_scan": "observed_at",
    "wifi_ap_obs": "observed_at",
}
VEHICLE_TABLES = [t for t in SAMPLE_TABLES if t != "tune"]
COUNTED_TABLES = ["position", "imu", "obd", "boost", "status", "transition", "gap"]

LEDGER = struct(
    "utc_ms bigint, event string, bundle_id string, device_id string, content_root string, reason string, "
    "bytes bigint, chunk bigint, path string"
)
AUDIT = struct(
    "ts timestamp, actor_type string, actor_id string, transport string, client_id string, device_id string, "
    "target_id string, method string, route string, body_sha256 string, status int, reason string"
)
