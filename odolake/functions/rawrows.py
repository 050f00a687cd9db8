"""Raw record fields to typed rows of every sample table, and what the records state that the format does not define.

A raw table has the keys (vehicle_id, content_root, boot_id, mono_ms, seq) and its record's fields as plain integers. A field
that an input lacks is NULL, so tables written before the field was defined still read. Each table is one projection and one
join with its bundles' clock basis; nothing is grouped.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolake.functions import names
from odolake.functions.normalise import (
    boost_columns, fix_warnings, gap_warnings, implied_basis, measured, observed_at, scaled, valid_fix,
)
from odolake.schemas import SAMPLE_TABLES
from odolake.sources.tables import Tables


class Field(NamedTuple):
    """A typed column's raw field, the width whose "no reading" value is NULL there, and the unit of its steps."""

    raw: str
    width: str | None = None
    unit: str | None = None


# Fixed values of the record format: the fields of each record, by typed column.
FIELDS: dict[str, dict[str, Field]] = {
    "position": {
        "lat": Field("lat_e7", None, "e7"),
        "lon": Field("lon_e7", None, "e7"),
        "alt_m": Field("alt_cm", None, "cm"),
        "speed_mps": Field("speed_cmps", None, "cm_per_s"),
        "heading_deg": Field("heading_cdeg", None, "cdeg"),
        "fix_type": Field("fix_type"),
        "sats_used": Field("sats_used", "u8"),
        "sats_visible": Field("sats_visible", "u8"),
        "hdop": Field("hdop_e2", "u16", "e2"),
        "h_acc_m": Field("h_acc_cm", "u16", "cm"),
        "v_acc_m": Field("v_acc_cm", "u16", "cm"),
        "utc_acc_ms": Field("utc_acc_ms", "u16"),
        "source_flags": Field("source_flags"),
        "frame_flags": Field("frame_flags"),
    },
    "imu": {
        "window_ms": Field("window_ms"),
        "accel_rms_mg": Field("accel_rms_mg"),
        "accel_peak_x_mg": Field("accel_peak_x_mg"),
        "accel_peak_y_mg": Field("accel_peak_y_mg"),
        "accel_peak_z_mg": Field("accel_peak_z_mg"),
        "gyro_peak_dps": Field("gyro_peak_dps_e1", None, "e1"),
        "variance": Field("variance"),
        "sample_count": Field("sample_count"),
        "event_flags": Field("event_flags"),
        "frame_flags": Field("frame_flags"),
    },
    "obd": {
        "speed_kph": Field("speed_kph", "i16"),
        "rpm": Field("rpm", "i16"),
        "throttle_pct": Field("throttle_pct", "u8"),
        "load_pct": Field("load_pct", "u8"),
        "coolant_c": Field("coolant_c", "i8"),
        "intake_c": Field("intake_c", "i8"),
        "fuel_pressure_kpa": Field("fuel_pressure_kpa", "u16"),
        "timing_advance_deg": Field("timing_advance_deg", "i8"),
        "pid_error_count": Field("pid_error_count"),
        "pids_requested": Field("pids_requested"),
        "pids_answered": Field("pids_answered"),
        "poll_cadence_ms": Field("poll_cadence_ms"),
        "frame_flags": Field("frame_flags"),
    },
    "boost": {
        "map_kpa": Field("map_kpa", "u16"),
        "baro_kpa": Field("baro_kpa", "u8"),
        "maf_cgps": Field("maf_cgps", "u16"),
        "lambda_e4": Field("lambda_e4", "u16"),
        "abs_load_raw": Field("abs_load_raw", "u16"),
        "ambient_c": Field("ambient_c", "i8"),
        "stft_pct": Field("stft_pct", "i8"),
        "ltft_pct": Field("ltft_pct", "i8"),
        "fuel_level_pct": Field("fuel_level_pct", "u8"),
        "pedal_pct": Field("pedal_pct", "u8"),
        "pids_requested": Field("pids_requested"),
        "pids_answered": Field("pids_answered"),
        "poll_cadence_ms": Field("poll_cadence_ms"),
    },
    "status": {
        "battery_mv": Field("battery_mv", "u16"),
        "sd_write_errors": Field("sd_write_errors", "u16"),
        "sd_free_mib": Field("sd_free_mib", "u16"),
        "device_temp_c": Field("device_temp_c", "i8"),
        "rssi_dbm": Field("rssi_dbm", "i8"),
        "ext_sensor1": Field("ext_sensor1", "u16"),
        "ext_sensor2": Field("ext_sensor2", "u16"),
        "health_state": Field("health_state"),
        "reboot_count": Field("reboot_count"),
    },
    "transition": {
        "region": Field("region"),
        "from_state": Field("from_state"),
        "to_state": Field("to_state"),
        "trigger_event": Field("trigger_event"),
        "reason_code": Field("reason_code"),
        "policy_version": Field("policy_version"),
        "start_score": Field("start_score_e2", None, "e2"),
        "stop_score": Field("stop_score_e2", None, "e2"),
        "wake_cause": Field("wake_cause"),
    },
    "gap": {
        "duration_ms": Field("duration_ms"),
        "expected_samples": Field("expected_samples"),
        "cause": Field("cause"),
    },
    "time_obs": {
        "utc_ms": Field("utc_ms"),
        "accuracy_ms": Field("accuracy_ms", "u32"),
    },
}
#: Fixed value of the record format: from this schema_version on a boost record has a pedal position.
PEDAL_SCHEMA = 2
#: Fixed value of the record format: the bit of a clock reading that the device adopted.
ADOPTED = 1
WARNINGS = {"position": fix_warnings, "gap": gap_warnings}
_KEYS = ("vehicle_id", "content_root", "boot_id", "mono_ms", "seq")


def _raw(raw: DataFrame, name: str) -> Column:
    return F.col(name) if name in raw.columns else F.lit(None).cast("long")


def _value(raw: DataFrame, field: Field) -> Column:
    value = _raw(raw, field.raw)
    if field.width:
        value = measured(value, field.width)
    return scaled(value, field.unit) if field.unit else value


def flaws(table: str, raw: DataFrame) -> DataFrame:
    """content_root, seq, kind, warning of raw rows with values that the format does not define."""
    if table in WARNINGS:
        rows = raw.select("content_root", "seq", F.explode(WARNINGS[table]()).alias("warning"))
    else:
        rows = raw.select("content_root", "seq", F.lit("").alias("warning")).where(F.lit(False))
    return rows.select("content_root", "seq", F.lit(table).alias("kind"), "warning")


def typed(table: str, raw: DataFrame, basis: DataFrame) -> DataFrame:
    """The rows of one sample table in its schema.

    ``basis`` gives utc_basis_ms, one row per content_root; a row of another bundle keeps its values and has no wall clock.
    Rows with ``flaws`` are left out, and positions that are no fix (``valid_fix``). A field at its "no reading" value is NULL,
    never a number; zero is a reading. A poll cadence of 0 was not measured, a boost record's pedal position counts only from
    ``PEDAL_SCHEMA`` on, and gauge boost and mixture are unknown where an input is.
    """
    rows = raw
    if table in WARNINGS:
        rows = rows.where(F.size(WARNINGS[table]()) == 0)
    if table == "position":
        rows = rows.where(valid_fix())
    values = {c: _value(raw, f) for c, f in FIELDS[table].items()}
    if table == "obd":
        values["poll_cadence_ms"] = F.nullif(values["poll_cadence_ms"], F.lit(0))
    if table == "boost":
        values["pedal_pct"] = F.when(_raw(raw, "schema_version") >= PEDAL_SCHEMA, values["pedal_pct"])
    if table == "time_obs":
        values["implied_basis_ms"] = implied_basis("utc_ms", "mono_ms")
        values["source"] = names.time_source(F.col("source_code"))
        values["adopted"] = _raw(raw, "flags").bitwiseAND(F.lit(ADOPTED)) != 0
    offset = _raw(raw, "utc_offset_ms") if table == "position" else None
    clock = observed_at("_basis", "mono_ms", offset).alias("started_at" if table == "gap" else "observed_at")
    if table != "time_obs":
        known = basis.select("content_root", F.col("utc_basis_ms").alias("_basis"))
        rows = rows.join(known, "content_root", "left")
    rows = rows.select(*_KEYS, *([] if table == "time_obs" else [clock]), *[v.alias(c) for c, v in values.items()])
    if table == "boost":
        rows = boost_columns(rows)
    schema = SAMPLE_TABLES[table]
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def typed_tables(raw: Mapping[str, DataFrame], basis: DataFrame) -> tuple[Tables, DataFrame]:
    """All sample tables from their raw ones, and the flaws of all; tables of other names are handed on as they are."""
    known = [n for n in FIELDS if n in raw]
    frames = {**{n: raw[n] for n in raw if n not in FIELDS}, **{n: typed(n, raw[n], basis) for n in known}}
    return Tables(frames), reduce(DataFrame.unionByName, [flaws(n, raw[n]) for n in known])
