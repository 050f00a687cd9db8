"""Sources, sinks and streams: results pass through storage and are compared like any other."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import testbed
from checks.bundles import noted
from checks.records import _offers, _updates
from checks.registry import add, on_tables
from checks.repairs import GATE_SQL, JUMPED
from checks.sql import SHARED
from odolake.functions.timecols import millis
from odolake.plans import catalog, ledger, synclog, trips
from odolake.schemas import SAMPLE_TABLES, TIME_COLUMN
from odolake.session import checkpoint_dir, settle
from odolake.sources import dimensions, records, sinks
from odolake.sources.tables import Tables, complete, scan
from odolake.streaming import carried, flows, stateful


def scratch(spark: SparkSession) -> str:
    """A folder of its own on the shared storage of the session."""
    return f"{checkpoint_dir(spark)}/odolake-{uuid.uuid4().hex}"


def batch_by_batch(rows: DataFrame, of_batch: Column, step) -> None:
    """Stream stored rows, one batch for each value of a column, into a foreachBatch function."""
    spark = rows.sparkSession
    root = scratch(spark)
    numbered = settle(rows.withColumn("_batch", of_batch))
    for r in numbered.select("_batch").distinct().orderBy("_batch").collect():
        own = numbered.where(F.col("_batch") == r[0]).drop("_batch")
        own.write.parquet(f"{root}/in/{r[0]}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in/*")
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()


# --- sources and sinks ------------------------------------------------------------------------


def _stored(t: Tables) -> Tables:
    """Every sample table, written in order and scanned again."""
    spark = t.obd.sparkSession
    root = scratch(spark)
    whole = complete({n: t[n] for n in SAMPLE_TABLES if n in t}, spark)
    sinks.write_store(Tables({n: whole[n].select(*SAMPLE_TABLES[n].fieldNames()) for n in SAMPLE_TABLES}), root)
    return scan(spark, root)


on_tables(
    "src_table_scan",
    "vehicle_id:s boot_id:s mono_ms:i seq:i speed_kph:i fuel_pressure_kpa:i observed_at:t",
    "SELECT *, NULL AS fuel_pressure_kpa FROM obd",
    lambda t: _stored(t).obd,
)
on_tables(
    "snk_ordered_store",
    "vehicle_id:s boot_id:s fixes:i top:d",
    "SELECT vehicle_id, boot_id, count(*) AS fixes, max(speed_mps) AS top FROM position WHERE mono_ms BETWEEN 20000 AND 90000 GROUP BY ALL",
    lambda t: _stored(t)
    .position.where("mono_ms BETWEEN 20000 AND 90000")
    .groupBy("vehicle_id", "boot_id")
    .agg(F.count(F.lit(1)).alias("fixes"), F.max("speed_mps").alias("top")),
)


def _months(t: Tables) -> DataFrame:
    spark = t.obd.sparkSession
    counts = []
    for name, at in TIME_COLUMN.items():
        root = scratch(spark)
        sinks.write_months(t[name], root, at, "overwrite")
        month = F.col("month").cast("string").alias("month")
        counts.append(spark.read.parquet(root).groupBy(F.lit(name).alias("kind"), month).agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, counts)


on_tables(
    "snk_months",
    "kind:s month:s n:i",
    " UNION ALL ".join(f"SELECT '{n}' AS kind, strftime({at}, '%Y-%m') AS month, count(*) AS n FROM {n} GROUP BY ALL" for n, at in TIME_COLUMN.items()),
    _months,
)


#: The column of each dated table that is out of date before bundles are replaced.
REPLACED = {
    "position": "speed_mps", "imu": "accel_rms_mg", "obd": "rpm", "boost": "map_kpa", "status": "battery_mv",
    "transition": "reason_code", "gap": "duration_ms", "wifi_scan": "flags", "wifi_ap_obs": "rssi_dbm",
}


def _replaced(t: Tables) -> DataFrame:
    """Of every dated table, half of the bundles are stored with old values, then replaced twice over by the present ones."""
    spark = t.obd.sparkSession
    number = F.expr("cast(regexp_extract(content_root, 'r([0-9]+)$', 1) AS INT)")
    stored = []
    for name, at in TIME_COLUMN.items():
        root, value = scratch(spark), REPLACED[name]
        rows = t[name]
        stale = rows.withColumn(value, F.when(number % 2 == 0, F.lit(-1).cast(rows.schema[value].dataType)).otherwise(F.col(value)))
        stale = stale.withColumn(at, F.when(number % 4 == 0, F.col(at) - F.expr("INTERVAL '60' DAY")).otherwise(F.col(at)))
        sinks.write_months(stale, root, at, "overwrite")
        for _ in range(2):
            sinks.replace_bundles(spark, root, rows.where(number % 2 == 0), at)
        month = F.col("month").cast("string").alias("month")
        stored.append(spark.read.parquet(root).select(F.lit(name).alias("kind"), "content_root", "seq", F.col(at).alias("at"), F.col(value).cast("double").alias("value"), month))
    return reduce(DataFrame.unionByName, stored)


on_tables(
    "snk_replace_bundles",
    "kind:s content_root:s seq:i at:t value:d month:s",
    " UNION ALL ".join(
        f"SELECT '{n}' AS kind, content_root, seq, {at} AS at, CAST({REPLACED[n]} AS DOUBLE) AS value, strftime({at}, '%Y-%m') AS month FROM {n}" for n, at in TIME_COLUMN.items()
    ),
    _replaced,
)


def _snapshot(t: Tables) -> DataFrame:
    spark = t.obd.sparkSession
    found = catalog.views(t)
    frames = Tables({**{n: found[n] for n in sinks.SNAPSHOT_TABLES}, "v_drive_summary": found["v_drive_summary"],
                     "v_trip_summary": trips.v_trip_summary(t)})
    return sinks.export_snapshot(frames, scratch(spark))


on_tables(
    "snk_snapshot",
    "table:s vehicle_id:s rows:i",
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", vehicle_id, count(*) AS rows FROM {n} GROUP BY ALL" for n in sinks.SNAPSHOT_TABLES
    )
    + " UNION ALL SELECT 'drive_summary', vehicle_id, count(DISTINCT boot_id) FROM obd GROUP BY ALL"
    + " UNION ALL SELECT 'trip_summary', vehicle_id, count(*) FROM trip_span GROUP BY ALL",
    _snapshot,
)


def _sliced(t: Tables) -> DataFrame:
    """The snapshot's rows, read back by vehicle, a table's odd vehicles apart from the even ones."""
    root = scratch(t.obd.sparkSession)
    found = catalog.views(t)
    sinks.export_snapshot(Tables({**{n: found[n] for n in sinks.SNAPSHOT_TABLES}, "v_drive_summary": found["v_drive_summary"],
                                  "v_trip_summary": trips.v_trip_summary(t)}), root)
    parts = []
    for name in SLICED:
        for half in (("veh0", "veh2"), ("veh1", "veh3")):
            rows = sinks.snapshot_slice(t.obd.sparkSession, root, name, half)
            at, value = F.col(TIME_COLUMN[name]).alias("at"), F.col(REPLACED[name]).cast("double").alias("value")
            parts.append(rows.select(F.lit(name).alias("kind"), F.lit(half[0]).alias("first"), "vehicle_id", "content_root", "seq", at, value))
    return reduce(DataFrame.unionByName, parts)


SLICED = [n for n in sinks.SNAPSHOT_TABLES if n in TIME_COLUMN]
on_tables(
    "snk_snapshot_slices",
    "kind:s first:s vehicle_id:s content_root:s seq:i at:t value:d",
    " UNION ALL ".join(
        f"SELECT '{n}' AS kind, CASE WHEN vehicle_id IN ('veh0', 'veh2') THEN 'veh0' ELSE 'veh1' END AS first, vehicle_id, content_root, seq, "
        f"{TIME_COLUMN[n]} AS at, CAST({REPLACED[n]} AS DOUBLE) AS value FROM {n}"
        for n in SLICED
    ),
    _sliced,
)


def _ledger_files(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark)
    rows = testbed.ledger(spark, sf)
    good = rows.select(
        F.to_json(
            F.struct(
                F.unix_millis(F.col("at_ts").cast("timestamp")).alias("utc_ms"), "event", "bundle_id", "content_root", "device_id", "reason", "bytes", "path"
            )
        ).alias("value")
    )
    broken = rows.where("event_id % 50 = 0").select(F.concat(F.lit("{torn "), "bundle_id").alias("value"))
    good.unionByName(broken).write.text(root)
    return records.read_ledger(spark, root)


add(
    "src_ledger_entries",
    "content_root:s received_at:t",
    "SELECT content_root, min(at_ts) AS received_at FROM ledger WHERE event = 'committed' GROUP BY ALL",
    lambda spark, sf: ledger.arrival_metadata(records.entries(_ledger_files(spark, sf))),
)
add(
    "src_ledger_bad_lines",
    "line:s",
    "SELECT concat('{torn ', bundle_id) AS line FROM ledger WHERE event_id % 50 = 0",
    lambda spark, sf: records.bad_lines(_ledger_files(spark, sf)),
)

AUDIT_TODAY, AUDIT_DAYS = dt.date(2024, 1, 28), 21


def _audit_files(spark: SparkSession, sf: str) -> str:
    """A file of request records for every day of the events."""
    root = scratch(spark)
    rows = testbed.read(spark, sf, "events").select(
        F.to_date("ts").alias("day"),
        F.to_json(
            F.struct(
                F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.lit("user").alias("actor_type"),
                F.col("user_id").cast("string").alias("actor_id"), F.concat(F.lit("/v1/"), "event_type").alias("route"),
                (F.col("event_id") % 5 * 100 + 100).cast("int").alias("status"), F.lit(1).alias("no_such_field"),
            )
        ).alias("value"),
    )
    rows = settle(rows.where("day IS NOT NULL"))
    for r in rows.select("day").distinct().collect():
        rows.where(F.col("day") == r.day).select("value").write.text(f"{root}/{r.day}.jsonl")
    return root


add(
    "src_audit_days",
    "ts:t actor_id:s route:s status:i device_id:s",
    f"SELECT ts, CAST(user_id AS VARCHAR) AS actor_id, '/v1/' || event_type AS route, event_id % 5 * 100 + 100 AS status, NULL AS device_id FROM events "
    f"WHERE CAST(ts AS DATE) <= DATE '{AUDIT_TODAY}' AND CAST(ts AS DATE) > DATE '{AUDIT_TODAY}' - {AUDIT_DAYS}",
    lambda spark, sf: records.read_audit(spark, _audit_files(spark, sf), AUDIT_DAYS, AUDIT_TODAY),
)


def _registry_files(spark: SparkSession, sf: str) -> DataFrame:
    """Registry documents, one for each nation's customers, with their orders as tunes; read back as vehicles."""
    root = scratch(spark)
    customers, orders = (testbed.read(spark, sf, n) for n in ("customer", "orders"))
    note = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("note")
    tune = F.struct(F.concat(F.lit("t"), "o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), note)
    tunes = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(tune).alias("tunes"))
    vehicle = F.struct(
        F.concat(F.lit("V"), "c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("engine_code"),
        F.when(F.col("c_custkey") % 7 == 0, "2024-01-01").alias("archived_at"), F.col("tunes"),
    )
    documents = customers.join(tunes, "c_custkey", "left").groupBy("c_nationkey").agg(F.collect_list(vehicle).alias("vehicles"))
    whole = documents.select("c_nationkey", F.to_json(F.struct("vehicles")).alias("value"))
    whole.repartition("c_nationkey").write.partitionBy("c_nationkey").text(root)
    return dimensions.read_registry(spark, root)


add(
    "src_registry",
    "vehicle_id:s display_name:s engine_code:s archived:b",
    "SELECT concat('v', c_custkey) AS vehicle_id, c_name AS display_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE '' END AS engine_code, "
    "c_custkey % 7 = 0 AS archived FROM customer",
    _registry_files,
)
add(
    "src_tune_records",
    "vehicle_id:s tune_id:s tuned_at:t note:s",
    "SELECT concat('v', o_custkey) AS vehicle_id, concat('t', o_orderkey) AS tune_id, date_trunc('day', o_orderdate) AS tuned_at, "
    "CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority ELSE '' END AS note FROM orders SEMI JOIN customer ON c_custkey = o_custkey",
    lambda spark, sf: dimensions.tune_rows(_registry_files(spark, sf)),
)

# --- streams ----------------------------------------------------------------------------------


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return testbed.ledger(spark, sf).where("event = 'committed'").select("content_root", F.col("at_ts").alias("received_at"))


def _taken_in(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries in three batches, the newest first, cut at about a third and two thirds of the time."""
    root = scratch(spark)
    rows = _arrivals(spark, sf)
    at = F.unix_micros(F.col("received_at").cast("timestamp"))
    cuts = rows.select(F.percentile_approx(at, [1 / 3, 2 / 3], 1000)).first()[0] or [0, 0]
    batch_by_batch(rows, -sum(F.coalesce(at > F.lit(c), F.lit(False)).cast("int") for c in cuts), flows.intake(root))
    return spark.read.parquet(f"{root}/accepted")


add("str_intake_once", "content_root:s", "SELECT DISTINCT content_root FROM ledger WHERE event = 'committed'", _taken_in)


def _samples(t: Tables) -> DataFrame:
    seen = [t[n].select("vehicle_id", "observed_at") for n in ("position", "obd", "imu")]
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


def _late(rows: DataFrame) -> Column:
    """Ten batches: one vehicle comes after the others, and every fifth sample of the others long after that."""
    first = F.pmod(F.xxhash64("vehicle_id"), F.lit(3)) == 0
    late = F.pmod(F.xxhash64("vehicle_id", "observed_at"), F.lit(5)) == 0
    part = F.pmod(F.xxhash64("observed_at"), F.lit(3)).cast("int")
    return F.when(first, part + 4).when(late, part + 7).otherwise(F.pmod(F.xxhash64("observed_at"), F.lit(4)).cast("int"))


def _in_sessions(rows: DataFrame, flow, read) -> DataFrame:
    root = scratch(rows.sparkSession)
    batch_by_batch(rows, _late(rows), flow(root))
    return read(rows.sparkSession, root)


on_tables(
    "str_outings",
    "vehicle_id:s trip_id:s started_at:t ended_at:t samples:i",
    "SELECT s.vehicle_id, concat(s.vehicle_id, ':', epoch_ms(started_at)) AS trip_id, started_at, ended_at, (SELECT count(*) FROM stamped x "
    "WHERE x.vehicle_id = s.vehicle_id AND x.observed_at >= started_at AND x.observed_at <= ended_at) AS samples FROM trip_span s",
    lambda t: _in_sessions(_samples(t), flows.outings, flows.present_outings),
)
SHARED["wheel_leg"] = (
    "SELECT vehicle_id, min(observed_at) AS started_at, max(observed_at) AS ended_at, count(*) AS samples FROM ("
    "SELECT *, sum(CASE WHEN since > 60000 THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY observed_at) AS leg FROM ("
    "SELECT *, epoch_ms(observed_at) - epoch_ms(lag(observed_at) OVER (PARTITION BY vehicle_id ORDER BY observed_at)) AS since FROM obd WHERE speed_kph > 3)) "
    "GROUP BY vehicle_id, leg",
    ["obd"],
)
on_tables(
    "str_legs",
    "vehicle_id:s started_at:t ended_at:t samples:i",
    "SELECT * FROM wheel_leg",
    lambda t: _in_sessions(t.obd.where("speed_kph > 3").select("vehicle_id", "observed_at"), flows.legs, flows.present),
)


def _alerts(t: Tables) -> DataFrame:
    spark = t.obd.sparkSession
    root = scratch(spark)
    streams = {}
    for n in ("imu", "status", "gap"):
        t[n].write.parquet(f"{root}/{n}")
        streams[n] = spark.readStream.schema(t[n].schema).parquet(f"{root}/{n}")
    out = flows.alerts(Tables(streams))
    query = (
        out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
    )
    query.awaitTermination()
    return noted(spark.read.parquet(f"{root}/out"))


on_tables(
    "str_alerts",
    "event_id:s content_root:s vehicle_id:s kind:s occurred_at:t seq:i note:s",
    "SELECT * FROM sample_event",
    _alerts,
)


def _feed(t: Tables) -> DataFrame:
    """After each batch what it changed about outings is published; the newest word on each trip counts."""
    spark = t.obd.sparkSession
    root = scratch(spark)
    rows = _samples(t)

    def describe(found: DataFrame) -> DataFrame:
        named = found.withColumn("id", F.concat_ws(":", "vehicle_id", F.col("lo").cast("string")))
        return synclog.entity_state(named, "trip", "id", "vehicle_id", ["lo", "hi"])

    outing, publish = flows.outings(f"{root}/outings"), flows.trip_feed(root, f"{root}/outings", describe)

    def step(batch: DataFrame, batch_id: int) -> None:
        outing(batch, batch_id)
        publish(batch, batch_id)

    batch_by_batch(rows, _late(rows), step)
    feed = spark.read.parquet(f"{root}/feed")
    newest = feed.groupBy("entity_id").agg(F.max_by(F.struct("entity_type", "vehicle_id", "digest", "data"), "batch").alias("x"))
    return newest.select("entity_id", "x.*").where(F.col("digest") != synclog.TOMBSTONE)


on_tables(
    "str_trip_feed",
    "entity_type:s entity_id:s vehicle_id:s digest:s data:s",
    "SELECT 'trip' AS entity_type, concat(vehicle_id, ':', epoch_ms(started_at)) AS entity_id, lower(vehicle_id) AS vehicle_id, sha256(data) AS digest, data FROM "
    "(SELECT *, CAST(to_json({lo: epoch_ms(started_at), hi: epoch_ms(ended_at)}) AS VARCHAR) AS data FROM trip_span)",
    _feed,
)


def in_ten_batches(rows: DataFrame, order: str, flow) -> DataFrame:
    """Rows dealt into ten batches along a column, through a foreachBatch function of state per key."""
    root = scratch(rows.sparkSession)
    cuts = rows.select(F.percentile_approx(order, [i / 10 for i in range(1, 10)], 1000)).first()[0] or []
    part = sum((F.coalesce(F.col(order) > F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    batch_by_batch(rows, part, flow(root))
    return carried.results(rows.sparkSession, root)


add(
    "str_counter_guard",
    "device_id:i counter:i content_root:s arrival:i verdict:s gap:i",
    "SELECT *, CASE WHEN verdict = 'new' THEN greatest(counter - high_water - 1, 0) ELSE 0 END AS gap FROM offer_verdict",
    lambda spark, sf: in_ten_batches(_offers(spark, sf), "arrival", stateful.counter_guard),
)
add(
    "str_field_revisions",
    "arrival:i status:s revision:i",
    "SELECT * FROM revision_walk",
    lambda spark, sf: in_ten_batches(_updates(spark, sf), "arrival", stateful.field_revisions).withColumn("revision", F.col("revisions")[0]),
)


def _gate(t: Tables) -> DataFrame:
    fixes = t.position.withColumn("lat", F.expr(JUMPED)).select("content_root", "seq", "mono_ms", "lat", "lon", F.lit(False).alias("is_gap"))
    gaps = t.gap.select("content_root", "seq", F.lit(True).alias("is_gap"))
    return in_ten_batches(fixes.unionByName(gaps, allowMissingColumns=True), "seq", stateful.jump_gate)


on_tables("str_jump_gate", "content_root:s seq:i lat:d lon:d", GATE_SQL, _gate)


def _standby(t: Tables) -> DataFrame:
    cols = ["content_root", "seq", "mono_ms", "region", "from_state", "to_state", "trigger_event", "reason_code"]
    return in_ten_batches(t.transition.select(*cols), "seq", stateful.standby_windows)


on_tables(
    "str_standby",
    "content_root:s enter_ms:i exit_ms:i duration_ms:i wake_reason:i unmatched:b",
    "SELECT content_root, enter_ms, exit_ms, coalesce(exit_ms - enter_ms, 0) AS duration_ms, wake_reason, exit_ms IS NULL AS unmatched FROM "
    # An entry nothing follows yet is still open.
    "(SELECT *, max(enter_ms) OVER (PARTITION BY content_root) AS newest FROM standby) WHERE exit_ms IS NOT NULL OR enter_ms < newest",
    _standby,
)
