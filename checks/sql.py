"""DuckDB definitions shared by several oracle queries."""

from __future__ import annotations

DEVICE = "(coalesce(source_flags, 0) & 32) = 0"
PHONE = "(coalesce(source_flags, 0) & 32) <> 0"

SHARED: dict[str, tuple[str, list[str]]] = {
    "device_fix": (f"SELECT * FROM position WHERE {DEVICE}", []),
    "phone_fix": (f"SELECT * FROM position WHERE {PHONE}", []),
    "poll_boost": (
        "SELECT obd.*, boost.mono_ms AS reading_ms, boost.boost_psi, boost.map_kpa, boost.baro_kpa, boost.maf_cgps, "
        "boost.lambda_ratio, boost.stft_pct, boost.ltft_pct FROM obd ASOF LEFT JOIN boost "
        "ON (obd.vehicle_id, obd.boot_id) = (boost.vehicle_id, boost.boot_id) AND boost.mono_ms <= obd.mono_ms",
        [],
    ),
    "wheel": ("SELECT vehicle_id, boot_id, mono_ms, speed_kph FROM obd WHERE speed_kph IS NOT NULL", []),
    "shaking": (
        "SELECT vehicle_id, boot_id, mono_ms // 1000 AS sec, avg(accel_rms_mg) AS level FROM imu GROUP BY ALL",
        [],
    ),
    "trusted_fix": (
        """
        SELECT f.*, coalesce(
            (f.speed_mps < 8 OR NOT EXISTS (SELECT 1 FROM shaking own WHERE own.vehicle_id = f.vehicle_id
                AND own.boot_id = f.boot_id AND own.sec = f.mono_ms // 1000)
             OR (SELECT min(level) FROM shaking m WHERE m.vehicle_id = f.vehicle_id AND m.boot_id = f.boot_id
                AND abs(m.sec - f.mono_ms // 1000) <= 3) >= 35)
            AND f.sats_used >= 6
            AND (coalesce(f.mono_ms - b.mono_ms, 9999) > 2000 OR coalesce(a.mono_ms - f.mono_ms, 9999) > 2000
                OR f.speed_mps <= CASE WHEN a.speed_kph > b.speed_kph THEN a.speed_kph ELSE b.speed_kph END / 3.6 + 4)
            AND (coalesce(f.mono_ms - f.p_ms, 0) NOT BETWEEN 1 AND 2000
                OR abs(f.speed_mps - f.p_speed) * 1000.0 / (f.mono_ms - f.p_ms) <= 10)
            AND (coalesce(f.n_ms - f.mono_ms, 0) NOT BETWEEN 1 AND 2000
                OR abs(f.n_speed - f.speed_mps) * 1000.0 / (f.n_ms - f.mono_ms) <= 10), true) AS trusted
        FROM (SELECT *, lag(mono_ms) OVER same AS p_ms, lag(speed_mps) OVER same AS p_speed,
                     lead(mono_ms) OVER same AS n_ms, lead(speed_mps) OVER same AS n_speed
              FROM position
              WINDOW same AS (PARTITION BY vehicle_id, boot_id, coalesce(source_flags, 0) & 32 ORDER BY mono_ms, seq)) f
        ASOF LEFT JOIN wheel b ON b.vehicle_id = f.vehicle_id AND b.boot_id = f.boot_id AND b.mono_ms <= f.mono_ms
        ASOF LEFT JOIN wheel a ON a.vehicle_id = f.vehicle_id AND a.boot_id = f.boot_id AND a.mono_ms >= f.mono_ms
        """,
        ["position", "wheel", "shaking"],
    ),
}
