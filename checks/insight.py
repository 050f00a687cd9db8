"""Metric samples, tune effect, health, Wi-Fi places, standby power."""

from __future__ import annotations

from checks.registry import on_tables
from checks.sql import SHARED
from checks.views import PULLS
from odolake.functions.sentences import (
    ADVICE, CAUSE, DRIFT_LESS, DRIFT_MORE, HIGH, LOW, METRIC_NAMES, NORMAL, OUTSIDE, STEADY,
)
from odolake.plans import insight, power, wifi
from odolake.sources.profiles import catalogue, limit_rows, limits_for

SHARED["pulls"] = (PULLS, ["obd", "boost"])
SHARED["boot_start"] = (
    "SELECT vehicle_id, boot_id, min(observed_at) AS started_at FROM (SELECT vehicle_id, boot_id, observed_at FROM boost "
    "UNION ALL SELECT vehicle_id, boot_id, observed_at FROM obd) GROUP BY ALL",
    ["boost", "obd"],
)
SHARED["metric_rows"] = (
    """
    SELECT vehicle_id, boot_id, metric, value, started_at FROM (
        UNPIVOT (SELECT vehicle_id, boot_id, start_ms, peak_boost_psi AS boost_psi, avg_lambda AS "lambda" FROM pulls)
        ON boost_psi, "lambda" INTO NAME metric VALUE value
    ) JOIN boot_start USING (vehicle_id, boot_id)
    UNION ALL
    SELECT vehicle_id, boot_id, metric, median(pct), started_at FROM (
        UNPIVOT (SELECT vehicle_id, boot_id, seq, stft_pct, ltft_pct FROM boost) ON stft_pct, ltft_pct INTO NAME metric VALUE pct
    ) JOIN boot_start USING (vehicle_id, boot_id) GROUP BY vehicle_id, boot_id, metric, started_at HAVING count(pct) >= 20
    """,
    ["pulls", "boot_start", "boost"],
)
on_tables(
    "v_metric_samples",
    "vehicle_id:s boot_id:s metric:s value:d started_at:t",
    "SELECT * FROM metric_rows",
    insight.v_metric_samples,
)
on_tables(
    "v_tune_effect",
    "vehicle_id:s tune_id:s metric:s before_median:d after_median:d before_n:i after_n:i",
    """
    SELECT w.vehicle_id, w.tune_id, k.metric,
        (SELECT median(value) FROM metric_rows r WHERE r.vehicle_id = w.vehicle_id AND r.metric = k.metric
            AND r.started_at < w.tuned_at AND (w.earlier IS NULL OR r.started_at >= w.earlier)) AS before_median,
        (SELECT median(value) FROM metric_rows r WHERE r.vehicle_id = w.vehicle_id AND r.metric = k.metric
            AND r.started_at >= w.tuned_at AND (w.later IS NULL OR r.started_at < w.later)) AS after_median,
        (SELECT count(value) FROM metric_rows r WHERE r.vehicle_id = w.vehicle_id AND r.metric = k.metric
            AND r.started_at < w.tuned_at AND (w.earlier IS NULL OR r.started_at >= w.earlier)) AS before_n,
        (SELECT count(value) FROM metric_rows r WHERE r.vehicle_id = w.vehicle_id AND r.metric = k.metric
            AND r.started_at >= w.tuned_at AND (w.later IS NULL OR r.started_at < w.later)) AS after_n
    FROM (SELECT *, lag(tuned_at) OVER (PARTITION BY vehicle_id ORDER BY tuned_at, tune_id) AS earlier,
                 lead(tuned_at) OVER (PARTITION BY vehicle_id ORDER BY tuned_at, tune_id) AS later FROM tune) w,
         (VALUES ('boost_psi'), ('lambda'), ('ltft_pct'), ('stft_pct')) k(metric)
    """,
    insight.v_tune_effect,
)
SHARED["health"] = (
    """
    SELECT vehicle_id, metric, median(CASE WHEN age = 'recent' THEN value END) AS recent_median,
        count(*) FILTER (WHERE age = 'recent') AS recent_n, median(CASE WHEN age = 'baseline' THEN value END) AS baseline_median,
        count(*) FILTER (WHERE age = 'baseline') AS baseline_n, any_value(last_at) AS last_observed_at, any_value(tuned) AS tuned_at
    FROM (SELECT *, CASE WHEN started_at > last_at - INTERVAL 14 DAY THEN 'recent'
                         WHEN tuned IS NULL OR started_at >= tuned THEN 'baseline' END AS age
          FROM (SELECT *, max(started_at) OVER (PARTITION BY vehicle_id) AS last_at,
                    (SELECT max(tuned_at) FROM tune WHERE tune.vehicle_id = metric_rows.vehicle_id) AS tuned FROM metric_rows))
    GROUP BY vehicle_id, metric
    """,
    ["metric_rows", "tune"],
)
on_tables(
    "v_health_stats",
    "vehicle_id:s metric:s recent_median:d recent_n:i baseline_median:d baseline_n:i last_observed_at:t tuned_at:t",
    "SELECT * FROM health",
    insight.v_health_stats,
)

CODES = {"veh0": " n20", "veh1": "N20", "veh2": "B58", "veh3": ""}


def _findings(t):
    stats = insight.v_health_stats(t)
    spark = stats.sparkSession
    rows = ", ".join(f"('{v}', '{c}')" for v, c in CODES.items())
    named = spark.sql(f"SELECT * FROM VALUES {rows} AS x(vehicle_id, engine_code)")
    # Only vehicles with data, so that the limits follow the tables.
    vehicles = t.bundles.select("vehicle_id").distinct().join(named, "vehicle_id")
    return insight.health_findings(stats, limits_for(vehicles, limit_rows(spark, catalogue())))


def _text(template: str, value: str, limit: str, advice: str, cause: str) -> str:
    parts = {"value": value, "limit": limit, "base": "base_text", "since": "since", "name": "name", "advice": advice, "cause": cause}
    out = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            out.append("'" + head.replace("'", "''") + "'")
        if not brace:
            break
        word, _, rest = tail.partition("}")
        out.append(parts[word])
    return "concat(" + ", ".join(out) + ")"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SHOW = "CASE metric WHEN 'boost_psi' THEN printf('%.1f psi', {0}) WHEN 'lambda' THEN printf('%.2f', {0}) ELSE printf('%+.0f%%', {0}) END"
_W, _C = _quoted(ADVICE[1]), _quoted(ADVICE[2])
_CW, _CC = _quoted(CAUSE[1]), _quoted(CAUSE[2])


def _by_metric(texts: dict[str, str], limit: str, check: bool) -> str:
    a, c = (_C, _CC) if check else (_W, _CW)
    return "CASE metric " + " ".join(
        f"WHEN '{m}' THEN {_text(texts[m], 'value_text', SHOW.format(limit), a, c)}" for m in ("boost_psi", "lambda")
    ) + f" ELSE {_text(texts['trim'], 'value_text', SHOW.format(limit), a, c)} END"


NAMES = "CASE metric " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in METRIC_NAMES.items()) + " END"
LIMITS = ", ".join(
    f"('{v}', '{m}', {lo}, {hi}, {wl}, {wh}, {cl}, {ch})"
    for v, m, lo, hi, wl, wh, cl, ch in [
        row
        for v in ("veh0", "veh1")
        for row in (
            (v, "boost_psi", 0, 30, "NULL", 20, "NULL", "NULL"),
            (v, "lambda", 0.5, 2, "NULL", 1.1, "NULL", "NULL"),
            (v, "ltft_pct", -25, 25, -10, 10, -20, 20),
            (v, "stft_pct", -25, 25, "NULL", "NULL", "NULL", "NULL"),
        )
    ]
    + [
        ("veh2", m, lo, hi, "NULL", "NULL", "NULL", "NULL")
        for m, lo, hi in (("boost_psi", 0, 30), ("lambda", 0.5, 2), ("ltft_pct", -25, 25), ("stft_pct", -25, 25))
    ]
    + [("veh3", "ltft_pct", -25, 25, -10, 10, -20, 20), ("veh3", "stft_pct", -25, 25, "NULL", "NULL", "NULL", "NULL")]
)
on_tables(
    "health_findings",
    "vehicle_id:s metric:s status:s sentence:s",
    f"""
    SELECT vehicle_id, metric, status, sentence FROM (
        SELECT *, CASE
            WHEN state = 2 AND recent_median NOT BETWEEN lo AND hi THEN 'check'
            WHEN state = 2 THEN 'check' WHEN moved >= 6 THEN 'check' WHEN state = 1 THEN 'watch' WHEN moved >= 3 THEN 'watch'
            WHEN state = 0 OR moved IS NOT NULL THEN 'ok' END AS status,
          CASE
            WHEN state = 2 AND recent_median NOT BETWEEN lo AND hi THEN {_text(OUTSIDE, "value_text", "''", _C, _CC)}
            WHEN state = 2 AND recent_median > ch THEN {_by_metric(HIGH, "ch", True)}
            WHEN state = 2 THEN {_by_metric(LOW, "cl", True)}
            WHEN moved >= 6 AND recent_median < baseline_median THEN {_text(DRIFT_LESS, "value_text", "''", _C, _CC)}
            WHEN moved >= 6 THEN {_text(DRIFT_MORE, "value_text", "''", _C, _CC)}
            WHEN state = 1 AND recent_median > wh THEN {_by_metric(HIGH, "wh", False)}
            WHEN state = 1 THEN {_by_metric(LOW, "wl", False)}
            WHEN moved >= 3 AND recent_median < baseline_median THEN {_text(DRIFT_LESS, "value_text", "''", _W, _CW)}
            WHEN moved >= 3 THEN {_text(DRIFT_MORE, "value_text", "''", _W, _CW)}
            WHEN state = 0 THEN {_by_metric(NORMAL, "0", False)}
            WHEN moved IS NOT NULL THEN {_text(STEADY, "value_text", "''", _W, _CW)} END AS sentence
        FROM (SELECT h.*, l.lo, l.hi, l.wl, l.wh, l.cl, l.ch,
                CASE WHEN recent_median NOT BETWEEN lo AND hi OR recent_median > ch OR recent_median < cl THEN 2
                     WHEN recent_median > wh OR recent_median < wl THEN 1
                     WHEN coalesce(wl, wh, cl, ch) IS NOT NULL THEN 0 END AS state,
                CASE WHEN ends_with(h.metric, '_pct') AND baseline_n >= 3 THEN abs(recent_median - baseline_median) END AS moved,
                {SHOW.format("recent_median")} AS value_text, {SHOW.format("baseline_median")} AS base_text, {NAMES} AS name,
                CASE WHEN tuned_at IS NULL THEN 'before' ELSE 'since the last tune' END AS since
              FROM (SELECT * FROM health WHERE recent_n >= 3) h
              LEFT JOIN (VALUES {LIMITS}) l(v, m, lo, hi, wl, wh, cl, ch) ON l.v = h.vehicle_id AND l.m = h.metric))
    WHERE status IS NOT NULL
    """,
    _findings,
)

SHARED["placed"] = (
    "SELECT o.vehicle_id, o.bssid, o.rssi_dbm, o.observed_at, f.lat, f.lon, 10 ** (o.rssi_dbm / 20.0) AS strength "
    "FROM (SELECT a.* FROM wifi_ap_obs a WHERE EXISTS (SELECT 1 FROM wifi_scan s WHERE s.seq = a.seq AND s.boot_id = a.boot_id "
    "AND s.vehicle_id = a.vehicle_id AND s.flags % 2 = 1)) o ASOF JOIN (SELECT * FROM trusted_fix WHERE trusted AND "
    "(coalesce(source_flags, 0) & 32) = 0) f ON (o.vehicle_id, o.boot_id) = (f.vehicle_id, f.boot_id) AND f.mono_ms <= o.mono_ms "
    "WHERE o.mono_ms <= f.mono_ms + 2000 AND (f.speed_mps < 20 OR f.speed_mps IS NULL)",
    ["wifi_ap_obs", "wifi_scan", "trusted_fix"],
)
SHARED["learned"] = (
    """
    SELECT * FROM (
        SELECT c.*, (SELECT sqrt(avg(((p.lat - c.lat) * 111320.0) ** 2 + ((p.lon - c.lon) * 111320.0 * cos(radians(c.lat))) ** 2))
                     FROM placed p WHERE p.vehicle_id = c.vehicle_id AND p.bssid = c.bssid) AS spread_m
        FROM (SELECT vehicle_id, bssid, sum(lat * strength) / sum(strength) AS lat, sum(lon * strength) / sum(strength) AS lon,
                  count(*) AS observations, max(rssi_dbm) AS max_rssi_dbm, min(observed_at) AS first_seen,
                  max(observed_at) AS last_seen FROM placed GROUP BY ALL) c
        WHERE observations > 1)
    WHERE spread_m <= 300
    """,
    ["placed"],
)
on_tables(
    "v_wifi_ap_learned",
    "vehicle_id:s bssid:s lat:d lon:d observations:i spread_m:d max_rssi_dbm:i first_seen:t last_seen:t",
    "SELECT * FROM learned",
    wifi.v_wifi_ap_learned,
)
on_tables(
    "v_wifi_scan_unfixed",
    "vehicle_id:s boot_id:s mono_ms:i seq:i observed_at:t ap_count:i est_lat:d est_lon:d est_accuracy_m:d est_aps:i",
    """
    SELECT s.*, e.* EXCLUDE (vehicle_id, boot_id, seq)
    FROM wifi_scan s LEFT JOIN (
        SELECT o.vehicle_id, o.boot_id, o.seq, sum(l.lat * 10 ** (o.rssi_dbm / 20.0)) / sum(10 ** (o.rssi_dbm / 20.0)) AS est_lat,
            sum(l.lon * 10 ** (o.rssi_dbm / 20.0)) / sum(10 ** (o.rssi_dbm / 20.0)) AS est_lon,
            avg(l.spread_m) + 25 AS est_accuracy_m, count(*) AS est_aps
        FROM wifi_ap_obs o JOIN learned l USING (vehicle_id, bssid) GROUP BY ALL) e
        ON e.vehicle_id = s.vehicle_id AND e.boot_id = s.boot_id AND e.seq = s.seq
    WHERE NOT EXISTS (SELECT 1 FROM trusted_fix f WHERE f.trusted AND f.vehicle_id = s.vehicle_id AND f.boot_id = s.boot_id
                      AND abs(f.mono_ms - s.mono_ms) <= 5000)
    """,
    wifi.v_wifi_scan_unfixed,
)


def _anchors(t, limit=None):
    from pyspark.sql import functions as F

    n = F.substring_index("bssid", "-", -1).cast("int")
    address = F.format_string("02:00:00:00:%02x:%02x", (n / 256).cast("int") , n % 256)
    learned = wifi.v_wifi_ap_learned(t).withColumn("bssid", address)
    fitted = t.bundles.select(
        F.concat(F.lit("dongle-"), (F.substring("vehicle_id", 4, 1).cast("int") % 2).cast("string")).alias("device_id"),
        "vehicle_id",
    )
    return wifi.wifi_anchors(learned, fitted, limit)


SHARED["anchor"] = (
    """
    SELECT *, greatest(25, least(500, ceil(spread_m + 25))) AS accuracy_m
    FROM (SELECT *, row_number() OVER (PARTITION BY device_id, bssid
                    ORDER BY observations DESC, max_rssi_dbm DESC, spread_m) AS nth
                FROM (SELECT * REPLACE (printf('02:00:00:00:%02x:%02x', CAST(substr(bssid, 4) AS INTEGER) // 256,
                              CAST(substr(bssid, 4) AS INTEGER) % 256) AS bssid),
                          concat('dongle-', CAST(substr(vehicle_id, 4) AS INTEGER) % 2) AS device_id FROM learned))
    WHERE nth = 1
    """,
    ["learned"],
)
ANCHOR = "device_id:s bssid:s lat:d lon:d observations:i spread_m:d max_rssi_dbm:i last_seen:t accuracy_m:i"
on_tables("wifi_anchors", ANCHOR, "SELECT * FROM anchor", _anchors)
# The limit is the feature: what a device may carry.
on_tables(
    "wifi_anchors_limited",
    ANCHOR,
    "SELECT * FROM anchor QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY observations DESC, max_rssi_dbm DESC, spread_m, bssid) <= 12",
    lambda t: _anchors(t, 12),
)

SHARED["standby"] = (
    """
    SELECT * FROM (
        SELECT vehicle_id, content_root, boot_id, seq, mono_ms AS enter_ms, to_state, observed_at AS enter_at,
            CASE WHEN lead(to_state) OVER steps = 0 THEN lead(mono_ms) OVER steps END AS exit_ms,
            CASE WHEN lead(to_state) OVER steps = 0 THEN lead(observed_at) OVER steps END AS exit_at,
            CASE WHEN lead(to_state) OVER steps = 0 THEN lead(reason_code) OVER steps END AS wake_reason
        FROM transition WHERE region = 4 AND trigger_event = 4 AND from_state + to_state = 1
        WINDOW steps AS (PARTITION BY content_root ORDER BY seq))
    WHERE to_state = 1
    """,
    ["transition"],
)
on_tables(
    "power_windows",
    "vehicle_id:s content_root:s boot_id:s seq:i enter_ms:i exit_ms:i duration_ms:i wake_reason:i wake_reason_name:s "
    "unmatched:b enter_at:t exit_at:t",
    "SELECT *, coalesce(exit_ms - enter_ms, 0) AS duration_ms, exit_ms IS NULL AS unmatched, CASE WHEN wake_reason IS NULL THEN NULL "
    "ELSE coalesce(map {0: 'none', 1: 'motion', 2: 'engine voltage', 3: 'periodic health'}[wake_reason], 'unknown') END "
    "AS wake_reason_name FROM standby",
    power.power_windows,
)
on_tables(
    "power_summary",
    "content_root:s standby_ms:i observed_span_ms:i standby_fraction:d windows:i unmatched_windows:i voltage_samples:i "
    "first_mv:i last_mv:i drop_mv:i drain_span_ms:i drain_mv_per_hour:d",
    """
    SELECT content_root, hi - lo AS observed_span_ms, coalesce(w.total, 0) AS standby_ms, coalesce(w.n, 0) AS windows,
        coalesce(w.lone, 0) AS unmatched_windows, coalesce(v.n, 0) AS voltage_samples, v.first_mv, v.last_mv,
        v.first_mv - v.last_mv AS drop_mv, CASE WHEN hi > lo THEN coalesce(w.total, 0) / (hi - lo) ELSE 0 END AS standby_fraction,
        CASE WHEN v.took >= 600000 THEN v.took END AS drain_span_ms,
        CASE WHEN v.took >= 600000 THEN (v.last_mv - v.first_mv) / (v.took / 3600000.0) END AS drain_mv_per_hour
    FROM (SELECT content_root, min(mono_ms) AS lo, max(mono_ms) AS hi FROM (SELECT content_root, mono_ms FROM transition
              UNION ALL SELECT content_root, mono_ms FROM status) GROUP BY ALL)
    LEFT JOIN (SELECT content_root, sum(coalesce(exit_ms - enter_ms, 0)) AS total, count(*) AS n,
                   count(*) FILTER (WHERE exit_ms IS NULL) AS lone FROM standby GROUP BY ALL) w USING (content_root)
    LEFT JOIN (SELECT content_root, count(*) AS n, first(battery_mv ORDER BY seq) AS first_mv, last(battery_mv ORDER BY seq) AS last_mv,
                   max(mono_ms) - min(mono_ms) AS took FROM status WHERE battery_mv IS NOT NULL GROUP BY ALL) v USING (content_root)
    """,
    power.power_summary,
)
