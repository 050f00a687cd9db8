"""Legs, outings, periods, tracks."""

from __future__ import annotations

from checks.registry import on_tables
from checks.sql import SHARED
from odolake.plans import tracks, trips
from odolake.plans.trusted import v_position_trusted

SHARED["legs"] = (
    """
    SELECT vehicle_id, min(observed_at) AS started_at, max(observed_at) AS closed_at,
           first(boot_id ORDER BY observed_at, boot_id) AS boot_id
    FROM (SELECT *, count(*) FILTER (WHERE since > 60000) OVER (PARTITION BY vehicle_id ORDER BY observed_at) AS leg
          FROM (SELECT *, epoch_ms(observed_at) - epoch_ms(lag(observed_at) OVER (PARTITION BY vehicle_id ORDER BY observed_at)) AS since
                FROM (SELECT vehicle_id, boot_id, observed_at FROM obd WHERE speed_kph > 3
                      UNION ALL
                      SELECT vehicle_id, boot_id, observed_at FROM trusted_fix
                      WHERE trusted AND speed_mps * 3.6 > 3 AND (coalesce(source_flags, 0) & 32) = 0)
                WHERE year(observed_at) >= 2000))
    GROUP BY vehicle_id, leg
    """,
    ["obd", "trusted_fix"],
)
SHARED["stamped"] = (
    "SELECT vehicle_id, content_root, observed_at FROM position UNION ALL "
    "SELECT vehicle_id, content_root, observed_at FROM obd UNION ALL SELECT vehicle_id, content_root, observed_at FROM imu",
    ["position", "obd", "imu"],
)
SHARED["trip_span"] = (
    """
    SELECT vehicle_id, trip, min(observed_at) AS started_at, max(observed_at) AS ended_at
    FROM (SELECT *, count(*) FILTER (WHERE since > 3600000) OVER (PARTITION BY vehicle_id ORDER BY observed_at) AS trip
          FROM (SELECT *, epoch_ms(observed_at) - epoch_ms(lag(observed_at) OVER (PARTITION BY vehicle_id ORDER BY observed_at)) AS since
                FROM stamped))
    GROUP BY vehicle_id, trip
    """,
    ["stamped"],
)
SHARED["trip_steps"] = (
    """
    SELECT vehicle_id, trip, speed_mps,
           CASE WHEN mono_ms - lag(mono_ms) OVER route <= 5000 THEN
               12742000.0 * asin(sqrt(sin(radians(lat - lag(lat) OVER route) / 2) ** 2
                   + cos(radians(lat)) * cos(radians(lag(lat) OVER route)) * sin(radians(lon - lag(lon) OVER route) / 2) ** 2))
           ELSE 0 END AS step_m
    FROM (SELECT p.*, s.trip FROM trusted_fix p JOIN trip_span s ON s.vehicle_id = p.vehicle_id
              AND p.observed_at >= s.started_at AND p.observed_at <= s.ended_at
          WHERE p.trusted AND p.fix_type > 0 AND (coalesce(p.source_flags, 0) & 32) = 0)
    WINDOW route AS (PARTITION BY vehicle_id, trip, boot_id ORDER BY mono_ms, seq)
    """,
    ["trusted_fix", "trip_span"],
)
SHARED["trips"] = (
    """
    SELECT s.vehicle_id, s.started_at, s.ended_at, epoch_ms(s.ended_at) - epoch_ms(s.started_at) AS duration_ms,
        concat(s.vehicle_id, ':', epoch_ms(s.started_at)) AS trip_id,
        (SELECT first(boot_id ORDER BY observed_at, boot_id) FROM obd o WHERE o.vehicle_id = s.vehicle_id
            AND o.observed_at >= s.started_at AND o.observed_at <= s.ended_at) AS boot_id,
        l.driving_ms, coalesce(l.leg_count, 0) AS leg_count,
        g.distance_m, g.max_gnss_speed_mps, coalesce(g.fix_samples, 0) AS fix_samples,
        e.max_obd_speed_kph, e.max_rpm, coalesce(e.obd_samples, 0) AS obd_samples,
        (SELECT count(*) FROM device_fix d WHERE d.vehicle_id = s.vehicle_id AND d.observed_at >= s.started_at
            AND d.observed_at <= s.ended_at) AS gnss_samples,
        (SELECT count(*) FROM boost d WHERE d.vehicle_id = s.vehicle_id AND d.observed_at >= s.started_at
            AND d.observed_at <= s.ended_at) AS boost_samples,
        coalesce(h.gap_count, 0) AS gap_count, coalesce(h.gap_duration_ms, 0) AS gap_duration_ms,
        coalesce(h.max_gap_ms, 0) AS max_gap_ms,
        b.bundle_ids, coalesce(b.bundle_count, 0) AS bundle_count, b.device_id, b.decoder_version
    FROM trip_span s
    LEFT JOIN (SELECT s2.vehicle_id, s2.trip, count(*) AS leg_count, sum(epoch_ms(closed_at) - epoch_ms(legs.started_at)) AS driving_ms
               FROM trip_span s2 JOIN legs ON legs.vehicle_id = s2.vehicle_id AND legs.started_at >= s2.started_at
                   AND legs.started_at <= s2.ended_at GROUP BY ALL) l ON l.vehicle_id = s.vehicle_id AND l.trip = s.trip
    LEFT JOIN (SELECT vehicle_id, trip, sum(step_m) AS distance_m, max(speed_mps) AS max_gnss_speed_mps,
                      count(*) AS fix_samples FROM trip_steps GROUP BY ALL) g ON g.vehicle_id = s.vehicle_id AND g.trip = s.trip
    LEFT JOIN (SELECT s2.vehicle_id, s2.trip, max(speed_kph) AS max_obd_speed_kph, max(rpm) AS max_rpm, count(*) AS obd_samples
               FROM trip_span s2 JOIN obd o ON o.vehicle_id = s2.vehicle_id AND o.observed_at >= s2.started_at
                   AND o.observed_at <= s2.ended_at GROUP BY ALL) e ON e.vehicle_id = s.vehicle_id AND e.trip = s.trip
    LEFT JOIN (SELECT s2.vehicle_id, s2.trip, count(*) AS gap_count, sum(duration_ms) AS gap_duration_ms,
                      max(duration_ms) AS max_gap_ms
               FROM trip_span s2 JOIN gap o ON o.vehicle_id = s2.vehicle_id AND o.started_at >= s2.started_at
                   AND o.started_at <= s2.ended_at GROUP BY ALL) h ON h.vehicle_id = s.vehicle_id AND h.trip = s.trip
    LEFT JOIN (SELECT s2.vehicle_id, s2.trip, string_agg(DISTINCT bundle_id, ',' ORDER BY bundle_id) AS bundle_ids,
                      count(DISTINCT bundle_id) AS bundle_count, min(device_id) AS device_id, max(decoder_ver) AS decoder_version
               FROM trip_span s2 JOIN bundles u ON u.vehicle_id = s2.vehicle_id
               JOIN (SELECT content_root, min(observed_at) AS lo, max(observed_at) AS hi FROM stamped GROUP BY ALL) x
                   ON x.content_root = u.content_root AND x.lo <= s2.ended_at AND x.hi >= s2.started_at
               GROUP BY ALL) b ON b.vehicle_id = s.vehicle_id AND b.trip = s.trip
    """,
    ["trip_span", "legs", "trip_steps", "device_fix", "bundles", "stamped", "obd", "gap", "boost"],
)

on_tables(
    "v_trip_leg",
    "vehicle_id:s started_at:t closed_at:t boot_id:s",
    "SELECT * FROM legs",
    trips.v_trip_leg,
)
on_tables(
    "v_trip_summary",
    "vehicle_id:s boot_id:s device_id:s trip_id:s started_at:t ended_at:t duration_ms:i driving_ms:i leg_count:i "
    "distance_m:d max_gnss_speed_mps:d max_obd_speed_kph:i max_rpm:i obd_samples:i gnss_samples:i fix_samples:i "
    "boost_samples:i gap_count:i gap_duration_ms:i max_gap_ms:i bundle_ids:s bundle_count:i decoder_version:i",
    "SELECT * FROM trips",
    trips.v_trip_summary,
)
on_tables(
    "v_trip_period",
    "vehicle_id:s boot_id:s started_at:t ended_at:t started_on:s week_start:s month_start:s quarter_start:s year_start:s "
    "duration_ms:i distance_m:d max_obd_speed_kph:i max_gnss_speed_kph:d",
    "SELECT *, CAST(started_at AS DATE) AS started_on, CAST(started_at AS DATE) - (isodow(started_at) - 1)::INTEGER AS week_start, "
    "make_date(year(started_at), month(started_at), 1) AS month_start, "
    "make_date(year(started_at), quarter(started_at) * 3 - 2, 1) AS quarter_start, "
    "make_date(year(started_at), 1, 1) AS year_start, max_gnss_speed_mps * 3.6 AS max_gnss_speed_kph FROM trips",
    lambda t: trips.v_trip_period(trips.v_trip_summary(t)),
)
on_tables(
    "period_summary",
    "vehicle_id:s trips:i duration_ms:i distance_m:d max_obd_speed_kph:i max_gnss_speed_kph:d",
    "SELECT vehicle_id, count(*) AS trips, sum(duration_ms) AS duration_ms, coalesce(sum(distance_m), 0) AS distance_m, "
    "max(max_obd_speed_kph) AS max_obd_speed_kph, max(max_gnss_speed_mps) * 3.6 AS max_gnss_speed_kph FROM trips "
    "WHERE CAST(started_at AS DATE) BETWEEN DATE '2024-01-06' AND DATE '2024-01-15' GROUP BY vehicle_id",
    lambda t: trips.period_summary(trips.v_trip_period(trips.v_trip_summary(t)), "2024-01-06", "2024-01-16"),
)
PUBLISH = """
    SELECT lower(vehicle_id) AS vehicle_id, trip_id AS entity_id, coalesce(boot_id, '') AS boot_id,
        coalesce(device_id, '') AS device_id, epoch_ms(started_at) AS started_ms, epoch_ms(ended_at) AS ended_ms,
        floor(coalesce(distance_m, 0) + 0.5) AS distance_m, floor(coalesce(max_gnss_speed_mps, 0) * 100 + 0.5) AS max_gnss_speed_cmps,
        floor(coalesce(max_obd_speed_kph, 0) * 100 / 3.6 + 0.5) AS max_obd_speed_cmps, coalesce(driving_ms, 0) AS driving_ms,
        leg_count, duration_ms, coalesce(max_rpm, 0) AS max_rpm, obd_samples, gnss_samples, boost_samples, gap_count,
        gap_duration_ms, bundle_count, coalesce(decoder_version, 0) AS decoder_version
    FROM trips WHERE epoch_ms(started_at) <> 0
"""
on_tables(
    "trip_publish",
    "vehicle_id:s entity_id:s boot_id:s device_id:s started_ms:i ended_ms:i distance_m:i max_gnss_speed_cmps:i "
    "max_obd_speed_cmps:i driving_ms:i leg_count:i duration_ms:i max_rpm:i obd_samples:i gnss_samples:i boost_samples:i "
    "gap_count:i gap_duration_ms:i bundle_count:i decoder_version:i",
    PUBLISH,
    lambda t: trips.trip_publish(trips.v_trip_summary(t)),
)


def _spans(t):
    found = trips.outings(t).trips
    from odolake.functions.timecols import from_millis

    return found.selectExpr("vehicle_id", "concat_ws(':', vehicle_id, cast(lo AS STRING)) AS trip_id", "lo", "hi").select(
        "vehicle_id", "trip_id", from_millis("lo").alias("started_at"), from_millis("hi").alias("ended_at")
    )


# A small point budget, so that thinning has something to do on the small data sets.
POINT_BUDGET = 20
SHARED["placed_point"] = (
    """
    SELECT s.vehicle_id, concat(s.vehicle_id, ':', epoch_ms(s.started_at)) AS trip_id, epoch_ms(p.observed_at) AS at_ms,
        p.lat, p.lon, row_number() OVER (PARTITION BY s.vehicle_id, s.started_at ORDER BY p.observed_at, p.mono_ms, p.seq) AS n,
        count(*) OVER (PARTITION BY s.vehicle_id, s.started_at) AS total
    FROM trip_span s JOIN trusted_fix p ON p.vehicle_id = s.vehicle_id AND p.observed_at >= s.started_at
        AND p.observed_at <= s.ended_at
    WHERE (p.source_flags & 32) = 0 AND p.lat IS NOT NULL AND p.lon IS NOT NULL
    """,
    ["trip_span", "trusted_fix"],
)
RUNS = """
    SELECT *, count(*) FILTER (WHERE at_ms - prev_at_ms > 30000) OVER (PARTITION BY vehicle_id, trip_id ORDER BY n) AS run_no
    FROM (SELECT *, lag(at_ms) OVER (PARTITION BY vehicle_id, trip_id ORDER BY n) AS prev_at_ms FROM ({0}))
"""
SHARED["track_point"] = (RUNS.format("SELECT *, false AS thinned FROM placed_point"), ["placed_point"])
SHARED["thin_point"] = (
    RUNS.format(
        f"SELECT *, total > {POINT_BUDGET} AS thinned FROM placed_point "
        f"WHERE (n - 1) % ((total + {POINT_BUDGET} - 1) // {POINT_BUDGET}) = 0 OR n = total"
    ),
    ["placed_point"],
)


def _points(t, most=None):
    return tracks.track_points(v_position_trusted(t), _spans(t), most)


POINT = "vehicle_id:s trip_id:s n:i at_ms:i lat:d lon:d run_no:i thinned:b"
on_tables("trip_track", POINT, "SELECT * FROM track_point", _points)
on_tables("trip_track_thinned", POINT, "SELECT * FROM thin_point", lambda t: _points(t, POINT_BUDGET))
on_tables(
    "trip_track_gaps",
    "vehicle_id:s trip_id:s after_ms:i before_ms:i duration_ms:i",
    "SELECT vehicle_id, trip_id, prev_at_ms AS after_ms, at_ms AS before_ms, at_ms - prev_at_ms AS duration_ms "
    "FROM track_point WHERE at_ms - prev_at_ms > 30000",
    lambda t: tracks.track_gaps(_points(t)),
)
ZIGZAG = "CASE WHEN {0} < 0 THEN (-2 * {0} - 1) ELSE 2 * {0} END"
CHARS = (
    "list_aggregate(list_transform(list_filter(range(0, 7), lambda g: g = 0 OR (z >> (5 * g)) > 0), "
    "lambda g: chr(CAST(((z >> (5 * g)) & 31) + (CASE WHEN (z >> (5 * (g + 1))) > 0 THEN 32 ELSE 0 END) + 63 AS INTEGER))), "
    "'string_agg', '')"
)
on_tables(
    "trip_polyline",
    "vehicle_id:s trip_id:s run_no:i started_ms:i ended_ms:i points:i polyline:s",
    f"""
    SELECT vehicle_id, trip_id, run_no, min(at_ms) AS started_ms, max(at_ms) AS ended_ms, count(DISTINCT n) AS points,
           string_agg({CHARS}, '' ORDER BY n, axis) AS polyline
    FROM (SELECT *, {ZIGZAG.format("move")} AS z
          FROM (SELECT vehicle_id, trip_id, run_no, n, at_ms, axis,
                       place - coalesce(lag(place) OVER (PARTITION BY vehicle_id, trip_id, run_no, axis ORDER BY n), 0) AS move
                FROM (SELECT *, 0 AS axis, CAST(round(lat * 1e5) AS BIGINT) AS place FROM track_point
                      UNION ALL SELECT *, 1, CAST(round(lon * 1e5) AS BIGINT) FROM track_point)))
    GROUP BY vehicle_id, trip_id, run_no
    """,
    lambda t: tracks.track_runs(_points(t)),
)
