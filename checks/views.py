"""Analysis views over the derived tables."""

from __future__ import annotations

from checks.registry import on_tables
from checks.sql import DEVICE, PHONE
from odolake.plans import engine, summaries, trusted

KEY = "vehicle_id:s boot_id:s mono_ms:i"

on_tables(
    "v_telemetry",
    f"{KEY} observed_at:t speed_kph:i rpm:i throttle_pct:i load_pct:i coolant_c:i intake_c:i timing_advance_deg:i "
    "boost_psi:d map_kpa:i baro_kpa:i lambda_ratio:d stft_pct:i ltft_pct:i maf_cgps:i boost_age_ms:i gnss_speed_kph:d "
    "lat:d lon:d fix_type:i gnss_age_ms:i",
    "SELECT q.*, q.mono_ms - q.reading_ms AS boost_age_ms, d.speed_mps * 3.6 AS gnss_speed_kph, d.lat, d.lon, "
    "d.fix_type, q.mono_ms - d.mono_ms AS gnss_age_ms FROM poll_boost q ASOF LEFT JOIN device_fix d "
    "ON (q.vehicle_id, q.boot_id) = (d.vehicle_id, d.boot_id) AND d.mono_ms <= q.mono_ms",
    engine.v_telemetry,
)
on_tables(
    "v_reproducibility",
    "vehicle_id:s content_root:s origin:s decoder_ver:i output_digest:s reproduced:b n_position:i n_imu:i n_obd:i "
    "n_boost:i n_status:i n_transition:i n_gap:i warnings:s",
    "SELECT * FROM bundles",
    summaries.v_reproducibility,
)
on_tables(
    "v_vehicles",
    "vehicle_id:s bundles:i boots:i first_observed_at:t last_observed_at:t",
    "SELECT vehicle_id, any_value(n) AS bundles, any_value(b) AS boots, min(observed_at) AS first_observed_at, "
    "max(observed_at) AS last_observed_at FROM (SELECT vehicle_id, count(*) AS n, count(DISTINCT boot_id) AS b "
    "FROM bundles GROUP BY vehicle_id) LEFT JOIN (SELECT vehicle_id, observed_at FROM position UNION ALL "
    "SELECT vehicle_id, observed_at FROM obd UNION ALL SELECT vehicle_id, observed_at FROM imu UNION ALL "
    "SELECT vehicle_id, observed_at FROM status) USING (vehicle_id) GROUP BY vehicle_id",
    summaries.v_vehicles,
)
on_tables(
    "v_drive_summary",
    "vehicle_id:s boot_id:s duration_s:d max_speed_kph:i max_rpm:i obd_samples:i gnss_samples:i fix_samples:i "
    "phone_samples:i gap_count:i gap_duration_ms:i max_gap_ms:i warnings:s",
    f"""
    SELECT k.vehicle_id, k.boot_id, (hi - lo) / 1000.0 AS duration_s, max_speed_kph, max_rpm, obd_samples,
        (SELECT count(*) FROM position p WHERE p.boot_id = k.boot_id AND p.vehicle_id = k.vehicle_id AND {DEVICE}) AS gnss_samples,
        (SELECT count(*) FROM position p WHERE p.boot_id = k.boot_id AND p.vehicle_id = k.vehicle_id AND {DEVICE} AND fix_type > 0) AS fix_samples,
        (SELECT count(*) FROM position p WHERE p.boot_id = k.boot_id AND p.vehicle_id = k.vehicle_id AND {PHONE}) AS phone_samples,
        coalesce(g.n, 0) AS gap_count, coalesce(g.total, 0) AS gap_duration_ms, coalesce(g.longest, 0) AS max_gap_ms, w.warnings
    FROM (SELECT vehicle_id, boot_id, min(mono_ms) AS lo, max(mono_ms) AS hi, max(speed_kph) AS max_speed_kph,
                 max(rpm) AS max_rpm, count(*) AS obd_samples FROM obd GROUP BY ALL) k
    LEFT JOIN (SELECT vehicle_id, boot_id, count(*) AS n, sum(duration_ms) AS total, max(duration_ms) AS longest
               FROM gap GROUP BY ALL) g USING (vehicle_id, boot_id)
    LEFT JOIN (SELECT vehicle_id, boot_id, string_agg(warnings, '; ' ORDER BY warnings) AS warnings
               FROM (SELECT DISTINCT vehicle_id, boot_id, warnings FROM bundles WHERE warnings <> '') GROUP BY ALL) w
        USING (vehicle_id, boot_id)
    """,
    summaries.v_drive_summary,
)
on_tables(
    "v_boot_start",
    "vehicle_id:s boot_id:s started_at:t",
    "SELECT vehicle_id, boot_id, least(min(b.observed_at), min(o.observed_at)) AS started_at "
    "FROM (SELECT vehicle_id, boot_id, min(observed_at) AS observed_at FROM boost GROUP BY ALL) b "
    "FULL JOIN (SELECT vehicle_id, boot_id, min(observed_at) AS observed_at FROM obd GROUP BY ALL) o "
    "USING (vehicle_id, boot_id) GROUP BY ALL",
    summaries.v_boot_start,
)
on_tables(
    "v_trim_map",
    "vehicle_id:s boot_id:s rpm_bin:i load_bin:i avg_stft:d avg_ltft:d samples:i",
    "SELECT vehicle_id, boot_id, rpm - rpm % 500 AS rpm_bin, load_pct - load_pct % 10 AS load_bin, "
    "avg(stft_pct) AS avg_stft, avg(ltft_pct) AS avg_ltft, count(stft_pct) AS samples FROM poll_boost "
    "WHERE mono_ms < reading_ms + 2000 AND stft_pct IS NOT NULL AND rpm >= 0 AND load_pct >= 0 GROUP BY ALL",
    engine.v_trim_map,
)
on_tables(
    "v_boost_curve",
    f"{KEY} rpm:i boost_psi:d map_kpa:i baro_kpa:i boost_age_ms:i",
    "SELECT *, mono_ms - reading_ms AS boost_age_ms FROM poll_boost WHERE mono_ms < reading_ms + 2000 "
    "AND coalesce(map_kpa, 0) < 255 AND boost_psi IS NOT NULL AND rpm IS NOT NULL",
    engine.v_boost_curve,
)
on_tables(
    "v_speed_agreement",
    f"{KEY} obd_speed_kph:i gnss_speed_kph:d ratio:d gnss_age_ms:i",
    "SELECT w.vehicle_id, w.boot_id, w.mono_ms, w.speed_kph AS obd_speed_kph, d.speed_mps * 3.6 AS gnss_speed_kph, "
    "CASE WHEN least(w.speed_kph, d.speed_mps * 3.6) > 5 THEN w.speed_kph / (d.speed_mps * 3.6) END AS ratio, "
    "w.mono_ms - d.mono_ms AS gnss_age_ms FROM wheel w ASOF JOIN device_fix d ON (w.vehicle_id, w.boot_id) = "
    "(d.vehicle_id, d.boot_id) AND d.mono_ms <= w.mono_ms WHERE d.speed_mps IS NOT NULL AND d.fix_type > 0 "
    "AND w.mono_ms < d.mono_ms + 5000",
    engine.v_speed_agreement,
)
on_tables(
    "v_gnss_sources",
    f"{KEY} internal_lat:d internal_lon:d internal_fix:i internal_hacc:d internal_speed:d phone_lat:d phone_lon:d "
    "phone_fix:i phone_hacc:d phone_speed:d time_offset_ms:i",
    "SELECT d.vehicle_id, d.boot_id, d.mono_ms, d.lat AS internal_lat, d.lon AS internal_lon, d.fix_type AS internal_fix, "
    "d.h_acc_m AS internal_hacc, d.speed_mps AS internal_speed, f.lat AS phone_lat, f.lon AS phone_lon, "
    "f.fix_type AS phone_fix, f.h_acc_m AS phone_hacc, f.speed_mps AS phone_speed, d.mono_ms - f.mono_ms AS time_offset_ms "
    "FROM device_fix d ASOF JOIN phone_fix f ON (d.vehicle_id, d.boot_id) = (f.vehicle_id, f.boot_id) "
    "AND f.mono_ms <= d.mono_ms WHERE d.fix_type > 0 AND f.fix_type > 0 AND d.mono_ms < f.mono_ms + 500",
    engine.v_gnss_sources,
)
PULLS = """
    SELECT r.*, (r.end_ms - r.start_ms) / 1000.0 AS duration_s,
        (SELECT max(boost_psi) FROM boost b WHERE b.boot_id = r.boot_id AND b.vehicle_id = r.vehicle_id
            AND b.mono_ms >= r.start_ms AND b.mono_ms <= r.end_ms AND coalesce(map_kpa, 0) < 255) AS peak_boost_psi,
        (SELECT avg(lambda_ratio) FROM boost b WHERE b.boot_id = r.boot_id AND b.vehicle_id = r.vehicle_id
            AND b.mono_ms >= r.start_ms AND b.mono_ms <= r.end_ms AND coalesce(map_kpa, 0) < 255) AS avg_lambda,
        (SELECT avg(stft_pct) FROM boost b WHERE b.boot_id = r.boot_id AND b.vehicle_id = r.vehicle_id
            AND b.mono_ms >= r.start_ms AND b.mono_ms <= r.end_ms AND coalesce(map_kpa, 0) < 255) AS avg_stft,
        (SELECT avg(ltft_pct) FROM boost b WHERE b.boot_id = r.boot_id AND b.vehicle_id = r.vehicle_id
            AND b.mono_ms >= r.start_ms AND b.mono_ms <= r.end_ms AND coalesce(map_kpa, 0) < 255) AS avg_ltft
    FROM (SELECT vehicle_id, boot_id, min(mono_ms) AS start_ms, max(mono_ms) AS end_ms, min(rpm) AS min_rpm,
                 max(rpm) AS max_rpm, max(speed_kph) AS max_speed_kph, avg(load_pct) AS avg_load, count(*) AS obd_samples
          FROM (SELECT *, count(*) FILTER (WHERE throttle_pct < 70) OVER (PARTITION BY vehicle_id, boot_id
                    ORDER BY mono_ms, seq ROWS UNBOUNDED PRECEDING) AS breaks_before
                FROM obd WHERE throttle_pct IS NOT NULL AND rpm IS NOT NULL)
          WHERE throttle_pct >= 70 GROUP BY vehicle_id, boot_id, breaks_before
          HAVING count(*) > 1 AND max(rpm) - min(rpm) > 500) r
"""
on_tables(
    "v_pulls",
    "vehicle_id:s boot_id:s start_ms:i end_ms:i duration_s:d min_rpm:i max_rpm:i max_speed_kph:i avg_load:d obd_samples:i "
    "peak_boost_psi:d avg_lambda:d avg_stft:d avg_ltft:d",
    PULLS,
    engine.v_pulls,
)
on_tables(
    "v_position_trusted",
    f"{KEY} content_root:s seq:i observed_at:t lat:d lon:d speed_mps:d fix_type:i sats_used:i source_flags:i trusted:b",
    "SELECT * FROM trusted_fix",
    trusted.v_position_trusted,
)
