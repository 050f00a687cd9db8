"""The operators on their own: joins, aggregates, windows, unions, scalar functions, modules and the scan benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import on_tables
from checks.sql import SHARED
from odolake.functions import ids
from odolake.functions.flags import BOOT, from_device
from odolake.functions.geo import great_circle_m
from odolake.functions.timecols import millis
from odolake.operators import slices
from odolake.operators.asof import MINUTE_MS, Side, asof, asof_join
from odolake.operators.medians import medians
from odolake.operators.spans import overlapping, points_in_spans
from odolake.plans import catalog, engine, insight, modules, summaries, trips
from odolake.plans.trips import DAY_MS, HOUR_MS

KEY = "vehicle_id:s boot_id:s mono_ms:i"

# --- joins ------------------------------------------------------------------------------------

on_tables(
    "join_asof_backward",
    f"{KEY} r_speed_mps:d age_ms:i",
    "SELECT o.vehicle_id, o.boot_id, o.mono_ms, p.speed_mps AS r_speed_mps, o.mono_ms - p.mono_ms AS age_ms FROM obd o "
    "ASOF LEFT JOIN position p ON (o.vehicle_id, o.boot_id) = (p.vehicle_id, p.boot_id) AND p.mono_ms <= o.mono_ms",
    lambda t: asof_join(t.obd, t.position, BOOT, ["speed_mps"], prefix="r_"),
)
on_tables(
    "join_asof_forward",
    f"{KEY} r_rpm:i age_ms:i",
    "SELECT p.vehicle_id, p.boot_id, p.mono_ms, o.rpm AS r_rpm, o.mono_ms - p.mono_ms AS age_ms FROM position p "
    "ASOF LEFT JOIN obd o ON (o.vehicle_id, o.boot_id) = (p.vehicle_id, p.boot_id) AND o.mono_ms >= p.mono_ms",
    lambda t: asof_join(t.position, t.obd, BOOT, ["rpm"], forward=True, prefix="r_"),
)
on_tables(
    "join_asof_inner_fresh",
    f"{KEY} r_boost_psi:d age_ms:i",
    "SELECT o.vehicle_id, o.boot_id, o.mono_ms, p.boost_psi AS r_boost_psi, o.mono_ms - p.mono_ms AS age_ms FROM imu o "
    "ASOF JOIN boost p ON (o.vehicle_id, o.boot_id) = (p.vehicle_id, p.boot_id) AND p.mono_ms <= o.mono_ms WHERE o.mono_ms - p.mono_ms <= 1500",
    lambda t: asof_join(t.imu, t.boost, BOOT, ["boost_psi"], within=1500, how="inner", prefix="r_"),
)
on_tables(
    "join_asof_filtered_right",
    f"{KEY} r_lat:d age_ms:i",
    "SELECT o.vehicle_id, o.boot_id, o.mono_ms, p.lat AS r_lat, o.mono_ms - p.mono_ms AS age_ms FROM obd o "
    "ASOF LEFT JOIN device_fix p ON (o.vehicle_id, o.boot_id) = (p.vehicle_id, p.boot_id) AND p.mono_ms <= o.mono_ms",
    lambda t: asof_join(t.obd, t.position, BOOT, ["lat"], where=from_device(), prefix="r_"),
)
on_tables(
    "join_band",
    f"{KEY} seq:i started_seq:i",
    "SELECT o.vehicle_id, o.boot_id, o.mono_ms, o.seq, s.seq AS started_seq FROM transition s JOIN obd o ON o.vehicle_id = s.vehicle_id "
    "AND o.boot_id = s.boot_id AND o.mono_ms - s.mono_ms BETWEEN 0 AND 3000",
    lambda t: points_in_spans(
        t.obd.select(*BOOT, "mono_ms", "seq"),
        "mono_ms",
        t.transition.select(*BOOT, F.col("seq").alias("started_seq"), F.col("mono_ms").alias("a"), (F.col("mono_ms") + 3000).alias("b")),
        "a",
        "b",
        BOOT,
        MINUTE_MS,
    ),
)


def _trip_spans(t):
    return trips.outings(t).trips.select("vehicle_id", "lo", "hi")


on_tables(
    "join_sample_in_span",
    "vehicle_id:s seq:i lo:i",
    "SELECT s.vehicle_id, s.seq, epoch_ms(started_at) AS lo FROM status s JOIN trip_span t ON t.vehicle_id = s.vehicle_id "
    "AND s.observed_at >= started_at AND s.observed_at <= ended_at",
    lambda t: points_in_spans(
        t.status.select("vehicle_id", "seq", millis("observed_at").alias("at")), "at", _trip_spans(t), "lo", "hi", ["vehicle_id"], HOUR_MS
    ),
)


def _bundle_spans(t):
    return t.status.groupBy("vehicle_id", "content_root").agg(
        F.min(millis("observed_at")).alias("b_lo"), F.max(millis("observed_at")).alias("b_hi")
    )


on_tables(
    "join_overlap",
    "vehicle_id:s content_root:s lo:i",
    "SELECT b.vehicle_id, content_root, epoch_ms(started_at) AS lo FROM (SELECT vehicle_id, content_root, min(observed_at) AS a, "
    "max(observed_at) AS z FROM status GROUP BY ALL) b JOIN trip_span t ON t.vehicle_id = b.vehicle_id AND a <= ended_at AND z >= started_at",
    lambda t: overlapping(_bundle_spans(t), ("b_lo", "b_hi"), _trip_spans(t), ("lo", "hi"), ["vehicle_id"], DAY_MS),
)
on_tables(
    "join_equi_left",
    "content_root:s seq:i flags:i n:i",
    "SELECT s.content_root, s.seq, s.flags, (SELECT count(*) FROM wifi_ap_obs a WHERE a.content_root = s.content_root AND a.seq = s.seq "
    "AND rssi_dbm > -60) AS n FROM wifi_scan s",
    lambda t: t.wifi_scan.select("content_root", "seq", "flags")
    .join(
        t.wifi_ap_obs.where("rssi_dbm > -60").groupBy("content_root", "seq").agg(F.count(F.lit(1)).alias("n")),
        ["content_root", "seq"],
        "left",
    )
    .withColumn("n", F.coalesce("n", F.lit(0))),
)
on_tables(
    "join_anti_range",
    f"{KEY} seq:i",
    "SELECT vehicle_id, boot_id, mono_ms, seq FROM transition s WHERE NOT EXISTS (SELECT 1 FROM status u WHERE u.vehicle_id = s.vehicle_id "
    "AND u.boot_id = s.boot_id AND s.mono_ms BETWEEN u.mono_ms - 2000 AND u.mono_ms + 2000)",
    lambda t: points_in_spans(
        t.transition.select(*BOOT, "mono_ms", "seq"),
        "mono_ms",
        t.status.select(*BOOT, (F.col("mono_ms") - 2000).alias("a"), (F.col("mono_ms") + 2000).alias("b")),
        "a",
        "b",
        BOOT,
        MINUTE_MS,
        how="left_anti",
    ),
)
on_tables(
    "join_listed_keys",
    "vehicle_id:s metric:s n:i",
    "SELECT v.vehicle_id, k.metric, count(m.value) AS n FROM (SELECT DISTINCT vehicle_id FROM bundles) v CROSS JOIN "
    "(VALUES ('lambda'), ('maf')) k(metric) LEFT JOIN metric_rows m USING (vehicle_id, metric) GROUP BY ALL",
    lambda t: t.bundles.select("vehicle_id")
    .distinct()
    .select("vehicle_id", F.explode(F.array(F.lit("lambda"), F.lit("maf"))).alias("metric"))
    .join(
        insight.v_metric_samples(t).groupBy("vehicle_id", "metric").agg(F.count("value").alias("n")), ["vehicle_id", "metric"], "left"
    )
    .withColumn("n", F.coalesce("n", F.lit(0))),
)
on_tables(
    "join_null_safe",
    "content_root:s kind:s n:i",
    "SELECT content_root, 'status' AS kind, count(*) AS n FROM (SELECT content_root, CASE WHEN seq % 2 = 0 THEN 'veh0' END AS claimed FROM status) s "
    "JOIN (SELECT content_root, nullif(vehicle_id, 'veh1') AS owner FROM bundles) b USING (content_root) WHERE claimed IS DISTINCT FROM owner GROUP BY ALL",
    lambda t: t.status.select("content_root", F.when(F.col("seq") % 2 == 0, "veh0").alias("claimed"))
    .groupBy("content_root", "claimed")
    .agg(F.count(F.lit(1)).alias("n"))
    .join(t.bundles.select("content_root", F.nullif("vehicle_id", F.lit("veh1")).alias("owner")), "content_root")
    .where(~F.col("claimed").eqNullSafe(F.col("owner")))
    .groupBy("content_root")
    .agg(F.sum("n").alias("n"))
    .withColumn("kind", F.lit("status")),
)

# --- aggregates -------------------------------------------------------------------------------

on_tables(
    "agg_by_boot",
    "vehicle_id:s boot_id:s n:i total:i mean:d low:i high:i distinct_rpm:i fast:i fast_mean:d mid:d mid_fast:d all_fed:b top_rpm_ms:i calm_rpm_ms:i",
    "SELECT vehicle_id, boot_id, count(*) AS n, sum(load_pct) AS total, avg(load_pct) AS mean, min(load_pct) AS low, max(load_pct) AS high, "
    "count(DISTINCT rpm) AS distinct_rpm, count(*) FILTER (WHERE speed_kph > 30) AS fast, avg(rpm) FILTER (WHERE speed_kph > 30) AS fast_mean, "
    "median(load_pct) AS mid, median(load_pct) FILTER (WHERE speed_kph > 30) AS mid_fast, bool_and(load_pct > 0) AS all_fed, "
    "first(mono_ms ORDER BY rpm DESC, seq DESC) AS top_rpm_ms, first(mono_ms ORDER BY rpm, seq) AS calm_rpm_ms FROM obd GROUP BY ALL",
    lambda t: t.obd.groupBy(*BOOT).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("load_pct").alias("total"),
        F.avg("load_pct").alias("mean"),
        F.min("load_pct").alias("low"),
        F.max("load_pct").alias("high"),
        F.count_distinct("rpm").alias("distinct_rpm"),
        F.count_if(F.col("speed_kph") > 30).alias("fast"),
        F.avg(F.when(F.col("speed_kph") > 30, F.col("rpm"))).alias("fast_mean"),
        F.median("load_pct").alias("mid"),
        F.median(F.when(F.col("speed_kph") > 30, F.col("load_pct"))).alias("mid_fast"),
        F.bool_and(F.col("load_pct") > 0).alias("all_fed"),
        F.max_by("mono_ms", F.struct("rpm", "seq")).alias("top_rpm_ms"),
        F.min_by("mono_ms", F.struct("rpm", "seq")).alias("calm_rpm_ms"),
    ),
)
on_tables(
    "agg_distinct_text",
    "vehicle_id:s warnings:s bundles:i",
    "SELECT vehicle_id, string_agg(DISTINCT warnings, '; ' ORDER BY warnings) FILTER (WHERE warnings <> '') AS warnings, count(*) AS bundles "
    "FROM bundles GROUP BY vehicle_id",
    lambda t: t.bundles.groupBy("vehicle_id").agg(
        summaries.joined_distinct(F.when(F.col("warnings") != "", F.col("warnings")), "; ").alias("warnings"),
        F.count(F.lit(1)).alias("bundles"),
    ),
)
on_tables(
    "agg_median_any_size",
    "vehicle_id:s mid:d n:i",
    "SELECT vehicle_id, median(speed_mps * 1.7 + lat) AS mid, count(speed_mps * 1.7 + lat) AS n FROM position GROUP BY vehicle_id",
    lambda t: medians(t.position.withColumn("x", F.col("speed_mps") * 1.7 + F.col("lat")), ["vehicle_id"], "x", "mid"),
)
on_tables(
    "agg_having",
    "content_root:s n:i spread:i",
    "SELECT content_root, count(*) AS n, max(rpm) - min(rpm) AS spread FROM obd GROUP BY content_root HAVING count(*) >= 15 AND max(rpm) > min(rpm) + 4000",
    lambda t: t.obd.groupBy("content_root")
    .agg(F.count(F.lit(1)).alias("n"), (F.max("rpm") - F.min("rpm")).alias("spread"))
    .where("n >= 15 AND spread > 4000"),
)

# --- windows ----------------------------------------------------------------------------------

on_tables(
    "win_lag_lead",
    "vehicle_id:s boot_id:s seq:i prev_ms:i next_speed:d",
    "SELECT vehicle_id, boot_id, seq, lag(mono_ms) OVER w AS prev_ms, lead(speed_mps) OVER w AS next_speed FROM position "
    "WINDOW w AS (PARTITION BY vehicle_id, boot_id, coalesce(source_flags, 0) & 32 ORDER BY mono_ms, seq)",
    lambda t: (
        lambda by: slices.neighbour(
            slices.neighbour(
                t.position.withColumn("phone", ~from_device()), by, ["mono_ms", "seq"], "mono_ms", MINUTE_MS, ["mono_ms"], "p"
            ),
            by, ["mono_ms", "seq"], "mono_ms", MINUTE_MS, ["speed_mps"], "n", following=True,
        ).withColumns({"prev_ms": F.col("p.mono_ms"), "next_speed": F.col("n.speed_mps")})
    )([*BOOT, "phone"]),
)
on_tables(
    "win_sessions",
    "vehicle_id:s session:i lo:i hi:i n:i",
    "SELECT vehicle_id, session, min(epoch_ms(observed_at)) AS lo, max(epoch_ms(observed_at)) AS hi, count(*) AS n FROM ("
    "SELECT *, 1 + sum(CASE WHEN since > 120000 THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY observed_at) AS session FROM ("
    "SELECT *, epoch_ms(observed_at) - epoch_ms(lag(observed_at) OVER (PARTITION BY vehicle_id ORDER BY observed_at)) AS since FROM status)) GROUP BY ALL",
    lambda t: slices.number_sessions(
        t.status.withColumn("at", millis("observed_at"))
        .groupBy("vehicle_id", slices.slice_of("at", 120_000).alias(slices.SLICE))
        .agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n")),
        ["vehicle_id"],
        "lo",
        "hi",
        120_000,
        "session",
    )
    .groupBy("vehicle_id", "session")
    .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")),
)


def _islands(t):
    rows = t.obd.select(*BOOT, "mono_ms", "seq", "load_pct")
    high, low = rows.where("load_pct >= 60"), rows.where("load_pct < 60")
    placed = asof(high, [Side("b", low, ["seq"])], BOOT, strict_order=True)
    return placed.groupBy(*BOOT, F.col("b.seq").alias("_b")).agg(
        F.min("mono_ms").alias("lo"), F.max("mono_ms").alias("hi"), F.count(F.lit(1)).alias("n")
    )


on_tables(
    "win_islands",
    "vehicle_id:s boot_id:s lo:i hi:i n:i",
    "SELECT vehicle_id, boot_id, min(mono_ms) AS lo, max(mono_ms) AS hi, count(*) AS n FROM (SELECT *, nth - row_number() OVER ("
    "PARTITION BY vehicle_id, boot_id ORDER BY mono_ms) AS island FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, boot_id ORDER BY mono_ms) "
    "AS nth FROM obd) WHERE load_pct >= 60) GROUP BY vehicle_id, boot_id, island",
    _islands,
)
on_tables(
    "win_value_range",
    "vehicle_id:s boot_id:s sec:i quiet:d",
    "SELECT vehicle_id, boot_id, sec, min(level) OVER (PARTITION BY vehicle_id, boot_id ORDER BY sec RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS quiet FROM shaking",
    lambda t: slices.with_edge_copies(
        t.imu.groupBy(*BOOT, F.floor(F.col("mono_ms") / 1000).alias("sec")).agg(F.avg("accel_rms_mg").alias("level")), "sec", 60, 3, 3
    )
    .withColumn("quiet", F.min("level").over(Window.partitionBy(*BOOT, slices.SLICE).orderBy("sec").rangeBetween(-3, 3)))
    .where(F.col(slices.SLICE) == slices.slice_of("sec", 60)),
)
on_tables(
    "win_neighbour_bounds",
    "vehicle_id:s tune_id:s window_from:t window_to:t",
    "SELECT vehicle_id, tune_id, coalesce(lag(tuned_at) OVER w, TIMESTAMP '1970-01-01') AS window_from, "
    "coalesce(lead(tuned_at) OVER w, TIMESTAMP '9999-12-31') AS window_to FROM tune SEMI JOIN bundles USING (vehicle_id) "
    "WINDOW w AS (PARTITION BY vehicle_id ORDER BY tuned_at, tune_id)",
    lambda t: (
        lambda w: t.tune.join(t.bundles.select("vehicle_id"), "vehicle_id", "left_semi").select(
            "vehicle_id",
            "tune_id",
            F.coalesce(F.lag("tuned_at").over(w), F.lit("1970-01-01").cast("timestamp_ntz")).alias("window_from"),
            F.coalesce(F.lead("tuned_at").over(w), F.lit("9999-12-31").cast("timestamp_ntz")).alias("window_to"),
        )
    )(Window.partitionBy("vehicle_id").orderBy("tuned_at", "tune_id")),
)
on_tables(
    "win_state_runs",
    "content_root:s run:i state:i n:i",
    "SELECT content_root, min(seq) AS run, any_value(to_state) AS state, count(*) AS n FROM (SELECT *, sum(turn) OVER (PARTITION BY content_root ORDER BY seq) AS r "
    "FROM (SELECT *, CASE WHEN to_state IS NOT DISTINCT FROM lag(to_state) OVER (PARTITION BY content_root ORDER BY seq) THEN 0 ELSE 1 END AS turn FROM transition)) "
    "GROUP BY content_root, r",
    lambda t: slices.running(
        slices.neighbour(t.transition, ["content_root"], ["seq"], "seq", 65_536, ["to_state"], "p").withColumn(
            "start", F.when(~F.col("p.to_state").eqNullSafe(F.col("to_state")), F.col("seq"))
        ).drop("p"),
        ["content_root"], ["seq"], "seq", 65_536, {"run": ("last", F.col("start"))},
    )
    .groupBy("content_root", "run")
    .agg(F.min("to_state").alias("state"), F.count(F.lit(1)).alias("n")),
)
on_tables(
    "win_top_one_then_k",
    "vehicle_id:s seq:i rpm:i",
    "SELECT vehicle_id, seq, rpm FROM (SELECT *, row_number() OVER (PARTITION BY boot_id ORDER BY rpm DESC, seq) AS n FROM obd) WHERE n = 1 "
    "ORDER BY rpm DESC, seq LIMIT 10",
    lambda t: t.obd.groupBy("boot_id")
    .agg(F.max_by(F.struct("vehicle_id", "seq", "rpm"), F.struct(F.col("rpm"), -F.col("seq"))).alias("r"))
    .select("r.*")
    .orderBy(F.desc("rpm"), "seq")
    .limit(10),
)
on_tables(
    "win_row_numbers",
    "vehicle_id:s seq:i n:i",
    "SELECT vehicle_id, seq, row_number() OVER (PARTITION BY vehicle_id ORDER BY observed_at, seq) AS n FROM imu",
    lambda t: slices.row_numbers(
        t.imu.withColumn("at", millis("observed_at")), ["vehicle_id"], ["at", "seq"], "at", HOUR_MS, "n"
    ),
)
on_tables(
    "win_running",
    "device:s seq:i top:i total:i latest:i",
    "SELECT vehicle_id AS device, seq, max(battery_mv) OVER w AS top, sum(sd_free_mib) OVER w AS total, "
    "last_value(battery_mv IGNORE NULLS) OVER w AS latest FROM status WINDOW w AS (PARTITION BY vehicle_id ORDER BY seq ROWS UNBOUNDED PRECEDING)",
    lambda t: slices.running(
        t.status.withColumnRenamed("vehicle_id", "device"), ["device"], ["seq"], "seq", 1000,
        {"top": ("max", F.col("battery_mv")), "total": ("sum", F.col("sd_free_mib")), "latest": ("last", F.col("battery_mv"))},
    ),
)

# --- unions and scalars -----------------------------------------------------------------------

on_tables(
    "set_union_sources",
    "vehicle_id:s kind:s at:t",
    "SELECT vehicle_id, 'gap' AS kind, started_at AS at FROM gap UNION ALL SELECT vehicle_id, 'status', observed_at FROM status "
    "UNION ALL SELECT vehicle_id, 'transition', observed_at FROM transition",
    lambda t: t.gap.select("vehicle_id", F.lit("gap").alias("kind"), F.col("started_at").alias("at"))
    .unionByName(t.status.select("vehicle_id", F.lit("status").alias("kind"), F.col("observed_at").alias("at")))
    .unionByName(t.transition.select("vehicle_id", F.lit("transition").alias("kind"), F.col("observed_at").alias("at"))),
)
on_tables(
    "set_metric_arms",
    "vehicle_id:s metric:s value:d",
    "SELECT vehicle_id, 'rpm' AS metric, rpm AS value FROM obd WHERE rpm IS NOT NULL UNION ALL SELECT vehicle_id, 'psi', boost_psi FROM boost",
    lambda t: t.obd.where("rpm IS NOT NULL").select("vehicle_id", F.lit("rpm").alias("metric"), F.col("rpm").cast("double").alias("value")).unionByName(
        t.boost.select("vehicle_id", F.lit("psi").alias("metric"), F.col("boost_psi").alias("value"))
    ),
)
on_tables(
    "exp_scalars",
    "seq:i first_known:i no_zero:i larger:i size:i rounded:d power:d wave:d thirds:i rest:i masked:i label:s band:s inside:b differs:b "
    "at_ms:i later:t week:s month:s quarter:s year:s day:s text:s",
    "SELECT seq, coalesce(NULL, load_pct) AS first_known, nullif(load_pct, 0) AS no_zero, greatest(load_pct, throttle_pct) AS larger, "
    "abs(load_pct - throttle_pct) AS size, floor(load_pct / 7.0 * 100 + 0.5) / 100 AS rounded, sqrt(pow(load_pct, 2)) AS power, "
    "sin(radians(load_pct)) + cos(radians(load_pct)) + asin(load_pct / 101.0) AS wave, (load_pct - 50) // 3 AS thirds, load_pct % 7 AS rest, "
    "load_pct & 12 AS masked, vehicle_id || ':' || seq AS label, CASE WHEN load_pct > 66 THEN 'high' WHEN load_pct > 33 THEN 'mid' ELSE 'low' END AS band, "
    "load_pct BETWEEN 10 AND 20 AS inside, nullif(load_pct, 1) IS DISTINCT FROM nullif(throttle_pct, 1) AS differs, epoch_ms(observed_at) AS at_ms, "
    "observed_at + to_milliseconds(1500) AS later, CAST(date_trunc('week', observed_at) AS DATE) AS week, CAST(date_trunc('month', observed_at) AS DATE) AS month, "
    "CAST(date_trunc('quarter', observed_at) AS DATE) AS quarter, CAST(date_trunc('year', observed_at) AS DATE) AS year, CAST(observed_at AS DATE) AS day, "
    "CAST(load_pct AS VARCHAR) AS text FROM obd",
    lambda t: t.obd.selectExpr(
        "seq", "coalesce(NULL, load_pct) AS first_known", "nullif(load_pct, 0) AS no_zero", "greatest(load_pct, throttle_pct) AS larger",
        "abs(load_pct - throttle_pct) AS size", "floor(load_pct / 7.0D * 100 + 0.5D) / 100 AS rounded", "sqrt(pow(load_pct, 2)) AS power",
        "sin(radians(load_pct)) + cos(radians(load_pct)) + asin(load_pct / 101.0D) AS wave", "(load_pct - 50) div 3 AS thirds", "load_pct % 7 AS rest",
        "load_pct & 12 AS masked", "vehicle_id || ':' || seq AS label",
        "CASE WHEN load_pct > 66 THEN 'high' WHEN load_pct > 33 THEN 'mid' ELSE 'low' END AS band", "load_pct BETWEEN 10 AND 20 AS inside",
        "nullif(load_pct, 1) IS DISTINCT FROM nullif(throttle_pct, 1) AS differs", "unix_millis(cast(observed_at AS TIMESTAMP)) AS at_ms",
        "observed_at + INTERVAL '1.5' SECOND AS later", "cast(date_trunc('week', observed_at) AS DATE) AS week",
        "cast(date_trunc('month', observed_at) AS DATE) AS month", "cast(date_trunc('quarter', observed_at) AS DATE) AS quarter",
        "cast(date_trunc('year', observed_at) AS DATE) AS year", "cast(observed_at AS DATE) AS day", "cast(load_pct AS STRING) AS text",
    ),
)
on_tables(
    "exp_distance",
    "seq:i metres:d",
    "SELECT seq, 12742000.0 * asin(sqrt(sin(radians(36.1 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(36.1)) * sin(radians(-121.2 - lon) / 2) ** 2)) AS metres FROM position",
    lambda t: t.position.select(
        "seq", great_circle_m("lat", "lon", "36.1D", "-121.2D").alias("metres")
    ),
)
on_tables(
    "exp_content_ids",
    "content_root:s trip_id:s event_id:s",
    "SELECT content_root, substr(sha256(concat('trip-v1|', content_root)), 1, 32) AS trip_id, "
    "substr(sha256(concat('event-v1|', content_root, '|pothole_detected|7')), 1, 32) AS event_id FROM bundles",
    lambda t: t.bundles.select(
        "content_root", ids.trip_id().alias("trip_id"), ids.event_id("content_root", F.lit("pothole_detected"), F.lit("7")).alias("event_id")
    ),
)

# --- modules ----------------------------------------------------------------------------------

MODULES = [
    modules.Module(
        "fuel",
        derives=[modules.Derivation("boost.total_trim_pct", "double", "coalesce(stft_pct, 0) + coalesce(ltft_pct, 0) * 1.5")],
        metrics=[modules.Metric("total_trim", "boost", "total_trim_pct", "boot")],
    ),
    modules.Module(
        "air",
        derives=[
            modules.Derivation("boost.boost_psi", "double", "cast(map_kpa - baro_kpa as double) * 0.1450377"),
            modules.Derivation("boost.air_per_trim", "double", "CASE WHEN total_trim_pct = 0 THEN NULL ELSE trunc(maf_cgps / total_trim_pct) END"),
        ],
        metrics=[modules.Metric("pull_rpm", "v_pulls", "max_rpm", "pull")],
        requires=["boost.total_trim_pct"],
    ),
]
SHARED["boost_derived"] = (
    "SELECT *, CASE WHEN total_trim_pct <> 0 THEN trunc(maf_cgps / total_trim_pct) END AS air_per_trim FROM ("
    "SELECT *, stft_pct + ltft_pct * 1.5::DOUBLE AS total_trim_pct FROM boost)",
    ["boost"],
)
on_tables(
    "mod_derived_columns",
    "seq:i boost_psi:d total_trim_pct:d air_per_trim:d",
    "SELECT seq, boost_psi, total_trim_pct, air_per_trim FROM boost_derived",
    lambda t: modules.apply_derivations(t, MODULES).boost,
)
SHARED["module_rows"] = (
    "SELECT * FROM metric_rows UNION ALL SELECT vehicle_id, boot_id, 'pull_rpm', max_rpm, started_at FROM pulls JOIN boot_start USING (vehicle_id, boot_id) "
    "UNION ALL SELECT vehicle_id, boot_id, 'total_trim', median(total_trim_pct), started_at FROM boost_derived JOIN boot_start USING (vehicle_id, boot_id) "
    "GROUP BY vehicle_id, boot_id, started_at HAVING count(*) >= 20",
    ["metric_rows", "pulls", "boot_start", "boost_derived"],
)
on_tables(
    "mod_metric_samples",
    "vehicle_id:s boot_id:s metric:s value:d started_at:t",
    "SELECT * FROM module_rows",
    lambda t: catalog.views(t, MODULES)["v_metric_samples"],
)
on_tables(
    "mod_tune_effect",
    "vehicle_id:s tune_id:s metric:s before_n:i after_n:i after_median:d",
    "SELECT t.vehicle_id, t.tune_id, k.metric, count(*) FILTER (WHERE m.started_at < t.tuned_at AND m.started_at >= t.since) AS before_n, "
    "count(*) FILTER (WHERE m.started_at >= t.tuned_at AND m.started_at < t.until) AS after_n, "
    "median(m.value) FILTER (WHERE m.started_at >= t.tuned_at AND m.started_at < t.until) AS after_median "
    "FROM (SELECT *, coalesce(lag(tuned_at) OVER w, TIMESTAMP '1970-01-01') AS since, coalesce(lead(tuned_at) OVER w, TIMESTAMP '9999-12-31') AS until "
    "FROM tune WINDOW w AS (PARTITION BY vehicle_id ORDER BY tuned_at)) t "
    "CROSS JOIN (VALUES ('boost_psi'), ('lambda'), ('ltft_pct'), ('stft_pct'), ('pull_rpm'), ('total_trim')) k(metric) "
    "LEFT JOIN module_rows m ON m.vehicle_id = t.vehicle_id AND m.metric = k.metric GROUP BY ALL",
    lambda t: catalog.views(t, MODULES)["v_tune_effect"],
)


def _module_view(t):
    spark = t.obd.sparkSession
    catalog.views(t)["v_pulls"].createOrReplaceTempView("v_pulls")
    spark.catalog.dropTempView("mod_hard_pulls")
    view = modules.Module("pulls", views={"mod_hard_pulls": "SELECT vehicle_id, boot_id, max_rpm FROM v_pulls WHERE max_rpm > 5000"})
    modules.register_module_views(spark, [view])
    return spark.table("mod_hard_pulls")


on_tables(
    "mod_view",
    "vehicle_id:s boot_id:s max_rpm:i",
    "SELECT vehicle_id, boot_id, max_rpm FROM pulls WHERE max_rpm > 5000",
    _module_view,
)

# --- the five scan and as-of measurements -----------------------------------------------------

on_tables(
    "bench_scan_agg",
    "n:i mean_rpm:d top_speed:i",
    "SELECT count(*) AS n, avg(rpm) AS mean_rpm, max(speed_kph) AS top_speed FROM obd",
    lambda t: t.obd.agg(F.count(F.lit(1)).alias("n"), F.avg("rpm").alias("mean_rpm"), F.max("speed_kph").alias("top_speed")),
)
on_tables(
    "bench_filter_range",
    "n:i",
    "SELECT count(*) AS n FROM obd WHERE boot_id = 'veh1-b0' AND mono_ms BETWEEN 10000 AND 90000",
    lambda t: t.obd.where("boot_id = 'veh1-b0' AND mono_ms BETWEEN 10000 AND 90000").agg(F.count(F.lit(1)).alias("n")),
)
on_tables(
    "bench_group_rpm_bins",
    "rpm_bin:i n:i mean_load:d",
    "SELECT rpm // 500 * 500 AS rpm_bin, count(*) AS n, avg(load_pct) AS mean_load FROM obd GROUP BY ALL",
    lambda t: t.obd.groupBy(F.expr("rpm div 500 * 500").alias("rpm_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("load_pct").alias("mean_load")
    ),
)
FRESH = "SELECT * FROM poll_boost WHERE mono_ms - reading_ms < 1000"
on_tables(
    "bench_asof_view_agg",
    "n:i peak:d mean_stft:d",
    f"SELECT count(*) AS n, max(boost_psi) AS peak, avg(stft_pct) AS mean_stft FROM ({FRESH})",
    lambda t: engine.v_telemetry(t)
    .where("boost_age_ms < 1000")
    .agg(F.count(F.lit(1)).alias("n"), F.max("boost_psi").alias("peak"), F.avg("stft_pct").alias("mean_stft")),
)
on_tables(
    "bench_asof_group",
    "rpm_bin:i n:i peak:d",
    f"SELECT rpm // 500 * 500 AS rpm_bin, count(*) AS n, max(boost_psi) AS peak FROM ({FRESH}) GROUP BY ALL",
    lambda t: engine.v_telemetry(t)
    .where("boost_age_ms < 1000")
    .groupBy(F.expr("rpm div 500 * 500").alias("rpm_bin"))
    .agg(F.count(F.lit(1)).alias("n"), F.max("boost_psi").alias("peak")),
)
