"""Bundle trips, segments, events, rollups, summaries; normalisation of raw fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import on_tables
from checks.sql import SHARED
from odolake.functions import names, normalise, rawrows
from odolake.plans import bundle, catalog

METRES = (
    "12742000.0 * asin(sqrt(sin(radians(lat - lag(lat) OVER s) / 2) ** 2 + cos(radians(lat)) * cos(radians(lag(lat) OVER s)) "
    "* sin(radians(lon - lag(lon) OVER s) / 2) ** 2))"
)
SHARED["route_step"] = (
    f"SELECT content_root, seq, lat, lon, speed_mps, observed_at, coalesce(speed_mps, 9) >= 1 AS moving, "
    f"CASE WHEN epoch_ms(observed_at) - epoch_ms(lag(observed_at) OVER s) <= 5000 THEN {METRES} ELSE 0 END AS step_m "
    "FROM position WHERE fix_type > 0 WINDOW s AS (PARTITION BY content_root ORDER BY seq)",
    ["position"],
)
SHARED["bundle_trip"] = (
    """
    SELECT substr(sha256(concat('trip-v1|', content_root)), 1, 32) AS trip_id, content_root, b.vehicle_id, b.device_id, o.started_at, o.ended_at,
        (epoch_ms(o.ended_at) - epoch_ms(o.started_at)) // 1000 AS duration_s, coalesce(r.distance_m, 0) AS distance_m,
        r.start_lat, r.start_lon, r.end_lat, r.end_lon, r.max_speed_mps, r.avg_speed_mps,
        (SELECT count(*) FROM position p WHERE p.content_root = b.content_root) AS sample_count,
        (SELECT count(*) FROM gap p WHERE p.content_root = b.content_root) AS gap_count,
        (SELECT coalesce(sum(duration_ms // 1000), 0) FROM gap p WHERE p.content_root = b.content_root) AS gap_duration_s
    FROM bundles b
    JOIN (SELECT content_root, min(observed_at) AS started_at, max(observed_at) AS ended_at FROM (
            SELECT content_root, observed_at FROM stamped UNION ALL SELECT content_root, observed_at FROM status) GROUP BY ALL) o
        USING (content_root)
    LEFT JOIN (SELECT content_root, sum(step_m) AS distance_m, first(lat ORDER BY seq) AS start_lat, first(lon ORDER BY seq) AS start_lon,
                   last(lat ORDER BY seq) AS end_lat, last(lon ORDER BY seq) AS end_lon, max(speed_mps) AS max_speed_mps,
                   avg(speed_mps) AS avg_speed_mps FROM route_step GROUP BY ALL) r USING (content_root)
    """,
    ["bundles", "stamped", "status", "route_step", "position", "gap"],
)
TRIP_SPEC = (
    "trip_id:s content_root:s vehicle_id:s device_id:s started_at:t ended_at:t duration_s:i distance_m:d start_lat:d start_lon:d "
    "end_lat:d end_lon:d max_speed_mps:d avg_speed_mps:d sample_count:i gap_count:i gap_duration_s:i"
)
on_tables("trp_bundle_trips", TRIP_SPEC, "SELECT * FROM bundle_trip", bundle.bundle_trips)
on_tables(
    "trp_routes",
    "content_root:s trip_id:s route_wkt:s start_wkt:s end_wkt:s points:i",
    """
    SELECT content_root, substr(sha256(concat('trip-v1|', content_root)), 1, 32) AS trip_id,
        CASE WHEN count(*) > 1 THEN concat('LINESTRING(', string_agg(xy, ',' ORDER BY seq), ')') END AS route_wkt,
        concat('POINT(', first(xy ORDER BY seq), ')') AS start_wkt, concat('POINT(', last(xy ORDER BY seq), ')') AS end_wkt, count(*) AS points
    FROM (SELECT content_root, seq, printf('%.7f %.7f', lon, lat) AS xy FROM position WHERE fix_type > 0 AND lat IS NOT NULL AND lon IS NOT NULL) GROUP BY content_root
    """,
    bundle.bundle_routes,
)
SHARED["segments"] = (
    """
    SELECT *, row_number() OVER (PARTITION BY content_root ORDER BY started_at, kind, seq) - 1 AS segment_index FROM (
        SELECT content_root, CASE WHEN NOT moving AND took >= 30 THEN 'stop' ELSE 'drive' END AS kind, a AS started_at, b AS ended_at,
            took AS duration_s, CASE WHEN NOT moving AND took >= 30 THEN 0 ELSE m END AS distance_m, seq
        FROM (SELECT content_root, run, any_value(moving) AS moving, first(observed_at ORDER BY seq) AS a, last(observed_at ORDER BY seq) AS b,
                  (epoch_ms(last(observed_at ORDER BY seq)) - epoch_ms(first(observed_at ORDER BY seq))) // 1000 AS took,
                  sum(CASE WHEN turn THEN 0 ELSE step_m END) AS m, min(seq) AS seq
              FROM (SELECT *, sum(turn::INTEGER) OVER (PARTITION BY content_root ORDER BY seq) AS run
                    FROM (SELECT *, moving IS DISTINCT FROM lag(moving) OVER (PARTITION BY content_root ORDER BY seq) AS turn FROM route_step))
              GROUP BY content_root, run)
        UNION ALL
        SELECT content_root, 'gap', started_at, started_at + to_milliseconds(duration_ms), duration_ms // 1000, 0, seq FROM gap
        WHERE content_root IN (SELECT content_root FROM route_step))
    """,
    ["route_step", "gap"],
)
on_tables(
    "trp_segments",
    "trip_id:s content_root:s segment_index:i kind:s started_at:t ended_at:t duration_s:i distance_m:d",
    "SELECT *, substr(sha256(concat('trip-v1|', content_root)), 1, 32) AS trip_id FROM segments",
    bundle.trip_segments,
)


def _rule(table: str, kind: str, cond: str, at: str, detail: str, seq: str = "seq", lat: str = "NULL", lon: str = "NULL") -> str:
    return (
        f"SELECT substr(sha256(concat('event-v1|', content_root, '|{kind}|', {seq})), 1, 32) AS event_id, content_root, vehicle_id, "
        f"'{kind}' AS kind, {at} AS occurred_at, {seq} AS seq, {lat} AS lat, {lon} AS lon, {detail} AS note FROM {table} WHERE {cond}"
    )


SHARED["sample_event"] = (
    " UNION ALL ".join(
        [
            _rule("imu", "hard_braking_detected", "(event_flags & 2) > 0 OR accel_rms_mg >= 800", "observed_at", "concat('accel_rms_mg=', accel_rms_mg)"),
            _rule("imu", "impact_detected", "event_flags % 2 = 1 OR accel_rms_mg >= 3000", "observed_at", "concat('accel_rms_mg=', accel_rms_mg)"),
            _rule("imu", "pothole_detected", "(event_flags & 8) > 0", "observed_at", "''"),
            _rule("status", "storage_attention_required", "sd_free_mib < 256", "observed_at", "concat('sd_free_mib=', sd_free_mib)"),
            _rule("status", "storage_errors_observed", "sd_write_errors >= 1", "observed_at", "concat('sd_write_errors=', sd_write_errors)"),
            _rule("gap", "gnss_gap_observed", "duration_ms >= 10000", "started_at", "concat('cause=', cause, ';duration_ms=', duration_ms)"),
        ]
    ),
    ["imu", "status", "gap"],
)
SHARED["trip_event"] = (
    _rule("bundle_trip", "trip.started", "true", "started_at", "concat('trip_id=', trip_id)", "0", "start_lat", "start_lon")
    + " UNION ALL "
    + _rule(
        "bundle_trip", "trip.ended", "true", "ended_at", "concat('duration_s=', duration_s, ';trip_id=', trip_id)",
        "greatest(sample_count, 1)", "end_lat", "end_lon",
    ),
    ["bundle_trip"],
)
EVENT_SPEC = "event_id:s content_root:s vehicle_id:s kind:s occurred_at:t seq:i lat:d lon:d note:s"


def noted(events):
    """The detail map as text, without the distance, whose digits depend on summation order."""
    entries = F.filter(F.array_sort(F.map_entries("detail")), lambda e: e["key"] != "distance_m")
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return events.withColumn("note", text)


on_tables(
    "evt_detected",
    EVENT_SPEC,
    "SELECT * FROM sample_event UNION ALL SELECT * FROM trip_event",
    lambda t: noted(bundle.bundle_events(t)),
)
EVENT_NAMES = "map {" + ", ".join(f"{k}: '{v}'" for k, v in names.TRIP_EVENTS.items()) + "}"
NAMED_EVENT = f"coalesce({EVENT_NAMES}[event_type], concat('UNKNOWN_EVENT(', event_type, ')'))"
on_tables(
    "evt_markers",
    EVENT_SPEC,
    _rule(
        "marker", "device.marker", "true", "observed_at",
        f"concat('detail=', note, ';event_type=', event_type, ';event_type_name=', {NAMED_EVENT})", "seq",
        "CASE WHEN lat_e7 <> 0 OR lon_e7 <> 0 THEN lat_e7 / 1e7 END", "CASE WHEN lat_e7 <> 0 OR lon_e7 <> 0 THEN lon_e7 / 1e7 END",
    ),
    lambda t: noted(bundle.marker_events(t.marker)),
)


def _old_and_new(t):
    events = noted(bundle.sample_events(t)).drop("detail")
    old = events.where("seq % 3 <> 0").withColumns(
        {
            "published_at": F.when(F.col("seq") % 2 == 0, F.col("occurred_at")),
            "occurred_at": F.col("occurred_at") - F.expr("INTERVAL '1' SECOND"),
        }
    )
    return bundle.merge_events(old, events.where("seq % 5 <> 0"))


on_tables(
    "evt_upsert",
    "event_id:s kind:s occurred_at:t seq:i published_at:t",
    "SELECT event_id, kind, seq, CASE WHEN seq % 5 <> 0 THEN occurred_at ELSE occurred_at - INTERVAL 1 SECOND END AS occurred_at, "
    "CASE WHEN seq % 3 <> 0 AND seq % 2 = 0 THEN occurred_at END AS published_at FROM sample_event WHERE seq % 3 <> 0 OR seq % 5 <> 0",
    _old_and_new,
)
on_tables(
    "trp_gap_rows",
    "content_root:s seq:i vehicle_id:s trip_id:s started_at:t duration_ms:i cause_name:s",
    "SELECT g.content_root, seq, g.vehicle_id, trip_id, g.started_at, duration_ms, map {1: 'no_fix', 2: 'receiver_reset', "
    "3: 'powered_down', 4: 'obstruction', 5: 'time_jump'}[cause] AS cause_name FROM gap g LEFT JOIN bundle_trip USING (content_root)",
    lambda t: bundle.gap_rows(t, bundle.bundle_trips(t)),
)
SHARED["daily"] = (
    """
    SELECT d.*, (SELECT count(*) FROM (SELECT * FROM sample_event UNION ALL SELECT * FROM trip_event) e
                 WHERE e.vehicle_id = d.vehicle_id AND CAST(e.occurred_at AS DATE) = d.day) AS event_count
    FROM (SELECT vehicle_id, device_id, CAST(started_at AS DATE) AS day, count(*) AS trip_count, sum(distance_m) AS distance_m,
              sum(duration_s) AS duration_s, max(max_speed_mps) AS max_speed_mps, sum(gap_duration_s) AS gap_duration_s
          FROM bundle_trip GROUP BY ALL) d
    """,
    ["bundle_trip", "sample_event", "trip_event"],
)
DAILY_SPEC = (
    "vehicle_id:s device_id:s day:s trip_count:i distance_m:d duration_s:i max_speed_mps:d gap_duration_s:i event_count:i"
)


def _trips_and_events(t):
    from odolake.session import settle

    trips = settle(bundle.bundle_trips(t))
    owner = t.bundles.select("content_root", "device_id")
    return trips, bundle.bundle_events(t, trips).join(owner, "content_root")


on_tables(
    "agg_daily_rollup",
    DAILY_SPEC,
    "SELECT * FROM daily",
    lambda t: bundle.daily_rollups(*_trips_and_events(t)),
)


def _refreshed(t):
    """Rollups made before the last bundles arrived, refreshed for the days those touch."""
    trips, events = _trips_and_events(t)
    late = F.expr("cast(regexp_extract(content_root, 'r([0-9]+)$', 1) AS INT)") % 7 == 3
    before = bundle.daily_rollups(trips.where(~late), events.where(~late))
    return bundle.refresh_rollups(before, bundle.merge_trips(trips.where(~late), trips.where(late)), events, trips.where(late))


on_tables(
    "trp_rollup_refresh",
    DAILY_SPEC,
    # Days without a late bundle hold no late events either, so a refreshed table equals a full one.
    "SELECT * FROM daily",
    _refreshed,
)

HEALTH = [(bit, name) for bit, name in names.HEALTH_BITS.items()]
HEALTH_TEXT = (
    "CASE WHEN {0} = 0 THEN 'OK' ELSE concat_ws('|', "
    + ", ".join(f"CASE WHEN ({{0}} & {bit}) > 0 THEN '{name}' END" for bit, name in HEALTH)
    + ", CASE WHEN ({0} & 128) > 0 THEN '0x80' END) END"
)
on_tables(
    "agg_health_states",
    "content_root:s health_records:i degraded:i states:i state_names:s",
    f"SELECT *, {HEALTH_TEXT.format('states')} AS state_names FROM (SELECT content_root, count(*) AS health_records, "
    "count(*) FILTER (WHERE health_state > 0) AS degraded, bit_or(health_state) AS states FROM status GROUP BY ALL)",
    lambda t: bundle.health_summary(t.status),
)
on_tables(
    "agg_event_tally",
    "content_root:s event_name:s n:i",
    f"SELECT content_root, {NAMED_EVENT} AS event_name, count(*) AS n FROM marker GROUP BY ALL",
    lambda t: bundle.event_tally(t.marker),
)
on_tables(
    "agg_boost_summary",
    "content_root:s peak_boost_psi:d lambda_at_peak:d stft_pct_min:i stft_pct_max:i ltft_pct_min:i ltft_pct_max:i answered:i total:i",
    "SELECT content_root, max(boost_psi) AS peak_boost_psi, first(lambda_ratio ORDER BY boost_psi DESC, seq) AS lambda_at_peak, "
    "min(stft_pct) AS stft_pct_min, max(stft_pct) AS stft_pct_max, min(ltft_pct) AS ltft_pct_min, max(ltft_pct) AS ltft_pct_max, "
    "count(*) FILTER (WHERE pids_answered > 0) AS answered, count(*) AS total FROM boost GROUP BY content_root",
    lambda t: bundle.boost_summary(t.boost),
)

on_tables(
    "nrm_positions",
    "vehicle_id:s content_root:s boot_id:s mono_ms:i seq:i observed_at:t lat:d lon:d alt_m:d speed_mps:d heading_deg:d fix_type:i "
    "sats_used:i hdop:d h_acc_m:d source_flags:i",
    "SELECT r.* EXCLUDE (observed_at, sats_used), make_timestamp_ms(b.utc_basis_ms + mono_ms + utc_offset_ms) AS observed_at, "
    "lat_e7 / 1e7 AS lat, lon_e7 / 1e7 AS lon, alt_cm / 100.0 AS alt_m, speed_cmps / 100.0 AS speed_mps, "
    "heading_cdeg / 100.0 AS heading_deg, CASE WHEN sats_used < 255 THEN sats_used END AS sats_used, "
    "CASE WHEN hdop_e2 < 65535 THEN hdop_e2 / 100.0 END AS hdop, CASE WHEN h_acc_cm < 65535 THEN h_acc_cm / 100.0 END AS h_acc_m "
    "FROM raw_position r JOIN (SELECT content_root, utc_basis_ms FROM bundles) b USING (content_root) "
    "WHERE fix_type > 0 AND (lat_e7 <> 0 OR lon_e7 <> 0) AND speed_cmps <= 5000",
    lambda t: normalise.positions(t.raw_position, t.bundles),
)
on_tables(
    "nrm_warnings",
    "content_root:s seq:i warnings:s",
    "SELECT content_root, seq, concat_ws(';', CASE WHEN fix_type > 5 THEN concat('fix_type ', fix_type) END, "
    "CASE WHEN heading_cdeg >= 36000 THEN concat('heading ', heading_cdeg) END) AS warnings FROM raw_position "
    "WHERE fix_type > 5 OR heading_cdeg >= 36000 UNION ALL SELECT content_root, seq, concat('cause ', cause + 2) FROM gap WHERE cause >= 4",
    lambda t: normalise.quarantine(t.raw_position, normalise.fix_warnings())[1]
    .select("content_root", "seq", "warnings")
    .unionByName(
        normalise.quarantine(t.gap.withColumn("cause", F.col("cause") + 2), normalise.gap_warnings())[1].select(
            "content_root", "seq", "warnings"
        )
    )
    .withColumn("warnings", F.array_join("warnings", ";")),
)
on_tables(
    "nrm_boost",
    "content_root:s seq:i boost_psi:d lambda_ratio:d abs_load_pct:d map_saturated:b",
    "SELECT content_root, seq, CASE WHEN seq % 10 > 0 THEN (map_kpa - 100) * 0.1450377::DOUBLE END AS boost_psi, lambda_e4 / 10000.0::DOUBLE AS lambda_ratio, "
    "abs_load_raw * 100.0::DOUBLE / 255.0::DOUBLE AS abs_load_pct, map_kpa > 254 AS map_saturated FROM boost",
    lambda t: normalise.boost_columns(
        t.boost.withColumn("baro_kpa", F.when(F.col("seq") % 10 > 0, F.col("baro_kpa")))
    ),
)
on_tables(
    "nrm_time_obs",
    "content_root:s seq:i implied_basis_ms:i source:s",
    "SELECT content_root, seq, CASE WHEN utc - mono_ms >= 0 THEN utc - mono_ms END AS implied_basis_ms, CASE source_code WHEN 1 THEN 'gnss' "
    "WHEN 2 THEN 'phone' WHEN 3 THEN 'modem_network' WHEN 4 THEN 'rtc' ELSE concat('unknown(', source_code, ')') END AS source "
    "FROM (SELECT *, CASE WHEN seq % 5 = 0 THEN 100 ELSE utc_ms END AS utc FROM time_obs)",
    lambda t: t.time_obs.withColumn("utc_ms", F.when(F.col("seq") % 5 == 0, 100).otherwise(F.col("utc_ms"))).select(
        "content_root",
        "seq",
        normalise.implied_basis("utc_ms", "mono_ms").alias("implied_basis_ms"),
        names.time_source(F.col("source_code")).alias("source"),
    ),
)
on_tables(
    "nrm_names",
    "seq:i cause_name:s wake_name:s health_name:s",
    f"SELECT seq, CASE WHEN code BETWEEN 1 AND 5 THEN map {{1: 'no_fix', 2: 'receiver_reset', 3: 'powered_down', 4: 'obstruction', "
    f"5: 'time_jump'}}[code] ELSE concat('unknown(', code, ')') END AS cause_name, CASE code WHEN 0 THEN 'none' WHEN 1 THEN 'motion' "
    f"WHEN 2 THEN 'engine voltage' WHEN 3 THEN 'periodic health' ELSE 'unknown' END AS wake_name, {HEALTH_TEXT.format('health_state')} AS health_name "
    "FROM (SELECT *, seq % 8 AS code FROM status)",
    lambda t: t.status.withColumn("code", F.col("seq") % 8).select(
        "seq",
        names.gap_cause(F.col("code")).alias("cause_name"),
        names.named(F.col("code"), names.WAKE_REASONS, "unknown").alias("wake_name"),
        names.health_names(F.col("health_state")).alias("health_name"),
    ),
)


# The same through the catalogue, as SQL users meet them.
on_tables("cat_daily_rollups", DAILY_SPEC, "SELECT * FROM daily", lambda t: catalog.views(t)["daily_rollups"])
on_tables("cat_bundle_trips", TRIP_SPEC, "SELECT * FROM bundle_trip", lambda t: catalog.views(t)["bundle_trips"])


def _typed(name: str, kind: str, spec: str, values: str, where: str = "true") -> None:
    """A sample table from its raw fields; the wall clock comes from the bundle."""
    clock = "started_at" if kind == "gap" else "observed_at"
    on_tables(
        name,
        f"vehicle_id:s content_root:s boot_id:s seq:i {clock}:t {spec}",
        f"SELECT vehicle_id, content_root, boot_id, seq, make_timestamp_ms(utc_basis_ms + mono_ms) AS {clock}, {values} "
        f"FROM raw_{kind} JOIN (SELECT content_root, utc_basis_ms FROM bundles) b USING (content_root) WHERE {where}",
        lambda t: rawrows.typed(kind, t[f"raw_{kind}"], t.bundles),
    )


_typed(
    "nrm_obd",
    "obd",
    "speed_kph:i rpm:i fuel_pressure_kpa:i throttle_pct:i load_pct:i coolant_c:i intake_c:i timing_advance_deg:i poll_cadence_ms:i pids_requested:i",
    "CASE WHEN speed_kph > -32768 THEN speed_kph END AS speed_kph, CASE WHEN rpm > -32768 THEN rpm END AS rpm, "
    "CASE WHEN fuel_pressure_kpa < 65535 THEN fuel_pressure_kpa END AS fuel_pressure_kpa, CASE WHEN throttle_pct < 255 THEN throttle_pct END AS throttle_pct, "
    "CASE WHEN load_pct < 255 THEN load_pct END AS load_pct, CASE WHEN coolant_c > -128 THEN coolant_c END AS coolant_c, "
    "CASE WHEN intake_c > -128 THEN intake_c END AS intake_c, CASE WHEN timing_advance_deg > -128 THEN timing_advance_deg END AS timing_advance_deg, "
    "CASE WHEN poll_cadence_ms > 0 THEN poll_cadence_ms END AS poll_cadence_ms, NULL AS pids_requested",
)
_typed(
    "nrm_boost_raw",
    "boost",
    "map_kpa:i baro_kpa:i lambda_e4:i abs_load_raw:i stft_pct:i pedal_pct:i boost_psi:d lambda_ratio:d",
    "CASE WHEN map_kpa < 65535 THEN map_kpa END AS map_kpa, CASE WHEN baro_kpa < 255 THEN baro_kpa END AS baro_kpa, "
    "CASE WHEN lambda_e4 < 65535 THEN lambda_e4 END AS lambda_e4, CASE WHEN abs_load_raw < 65535 THEN abs_load_raw END AS abs_load_raw, "
    "CASE WHEN stft_pct > -128 THEN stft_pct END AS stft_pct, CASE WHEN pedal_pct < 255 AND schema_version >= 2 THEN pedal_pct END AS pedal_pct, "
    "CASE WHEN map_kpa < 65535 AND baro_kpa < 255 THEN (map_kpa - baro_kpa) * 0.1450377::DOUBLE END AS boost_psi, "
    "CASE WHEN lambda_e4 < 65535 THEN lambda_e4 / 10000.0::DOUBLE END AS lambda_ratio",
)
_typed(
    "nrm_status",
    "status",
    "battery_mv:i sd_write_errors:i device_temp_c:i rssi_dbm:i health_state:i",
    "CASE WHEN battery_mv < 65535 THEN battery_mv END AS battery_mv, CASE WHEN sd_write_errors < 65535 THEN sd_write_errors END AS sd_write_errors, "
    "CASE WHEN device_temp_c > -128 THEN device_temp_c END AS device_temp_c, CASE WHEN rssi_dbm > -128 THEN rssi_dbm END AS rssi_dbm, health_state",
)
_typed("nrm_imu", "imu", "accel_rms_mg:i gyro_peak_dps:d event_flags:i", "accel_rms_mg, gyro_peak_dps_e1 / 10.0::DOUBLE AS gyro_peak_dps, event_flags")
_typed(
    "nrm_transition",
    "transition",
    "region:i start_score:d stop_score:d wake_cause:i",
    "region, start_score_e2 / 100.0::DOUBLE AS start_score, stop_score_e2 / 100.0::DOUBLE AS stop_score, wake_cause",
)
_typed("nrm_gap", "gap", "duration_ms:i expected_samples:i cause:i", "duration_ms, expected_samples, cause", "cause BETWEEN 1 AND 5")
on_tables(
    "nrm_clock_readings",
    "vehicle_id:s content_root:s boot_id:s seq:i utc_ms:i implied_basis_ms:i accuracy_ms:i source:s adopted:b",
    "SELECT vehicle_id, content_root, boot_id, seq, utc_ms, CASE WHEN utc_ms >= mono_ms THEN utc_ms - mono_ms END AS implied_basis_ms, "
    "CASE WHEN accuracy_ms < 4294967295 THEN accuracy_ms END AS accuracy_ms, CASE source_code WHEN 1 THEN 'gnss' WHEN 2 THEN 'phone' "
    "WHEN 3 THEN 'modem_network' WHEN 4 THEN 'rtc' ELSE concat('unknown(', source_code, ')') END AS source, flags % 2 = 1 AS adopted FROM raw_time_obs",
    lambda t: rawrows.typed("time_obs", t.raw_time_obs, t.bundles),
)
on_tables(
    "nrm_flaws",
    "content_root:s seq:i kind:s warning:s",
    "SELECT content_root, seq, 'position' AS kind, concat('fix_type ', fix_type) AS warning FROM raw_position WHERE fix_type > 5 UNION ALL "
    "SELECT content_root, seq, 'position', concat('heading ', heading_cdeg) FROM raw_position WHERE heading_cdeg > 35999 UNION ALL "
    "SELECT content_root, seq, 'gap', concat('cause ', cause) FROM raw_gap WHERE cause NOT BETWEEN 1 AND 5",
    lambda t: rawrows.typed_tables(
        {n: t[f"raw_{n}"] for n in ("position", "obd", "boost", "status", "imu", "transition", "gap", "time_obs")}, t.bundles
    )[1],
)
